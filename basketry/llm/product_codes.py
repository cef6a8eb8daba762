"""Product-quantisation codes, each part's nearest codebook entry found by Orchard search.

A vector is cut into equal parts and each part is replaced by the number of the nearest
entry of that part's codebook. Codebooks are trained by Lloyd rounds over all vectors, in
integers: each round reads the table once, sums up the parts by entry within a task and
moves one row per (part, entry, component) and task through the shuffle. Codebooks
(``parts * entries`` short vectors) are the only data on the driver and in broadcasts.

The nearest entry is found as follows. For every entry of a codebook all entries stand in
a list ordered by their distance to it. A search starts at some entry and walks down its
list; when it meets an entry nearer to the point it goes on with the list of that one.
Entries met before are marked and not computed again. The walk ends where the list's
distances exceed twice the point's distance to the current entry: by the triangle
inequality nothing further down can be as near. Equal distances go to the lower number.

Vectors that are null or hold null or non-finite components are left out, as are vectors
whose length is no multiple of ``parts`` or differs from that of the first vector that
remains (least id). Scaled components beyond 2^28 count as 2^28, so that distances stay
within 64 bits. A null id comes after all others; rows that repeat an id are vectors of
their own, ordered by their components among the first entries. Repeated vectors make
repeated entries; the later ones stay unused. With fewer vectors than entries the codebook
has as many entries as there are vectors. Rows without a label share one label error.
Other columns may have any names: the input row is handed on as a struct. An empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import in_worker, keep

LARGEST = 1 << 28
#: Entries tried for a start before a walk begins.
STARTS = 16


def _square(difference: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", difference, difference)


class Orchard:
    """Exact nearest entries by walks down lists ordered by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        size = len(entries)
        between = np.stack([_square(self.entries - e) for e in self.entries])
        self.order = np.argsort(between, axis=1, kind="stable")
        self.away = np.take_along_axis(between, self.order, axis=1)
        self.starts = np.unique(np.linspace(0, size - 1, min(size, STARTS)).astype(int))
        self.computed = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each point's nearest entry, and the squared distance to it."""
        size, rows = len(self.entries), np.arange(len(points))
        met = np.zeros((len(points), size), bool)
        tried = np.stack([_square(points - self.entries[s]) for s in self.starts], axis=1)
        first = tried.argmin(1)
        at, best = self.starts[first], tried[rows, first]
        met[:, self.starts] = True
        self.computed += tried.size
        step = np.zeros(len(points), np.int64)
        walking = rows
        while len(walking):
            here, position = at[walking], step[walking]
            goes_on = position < size
            goes_on &= self.away[here, np.minimum(position, size - 1)] <= 4 * best[walking]
            walking, here, position = walking[goes_on], here[goes_on], position[goes_on]
            candidate = self.order[here, position]
            step[walking] += 1
            new = ~met[walking, candidate]
            point, candidate = walking[new], candidate[new]
            met[point, candidate] = True
            self.computed += len(point)
            distance = _square(points[point] - self.entries[candidate])
            nearer = (distance < best[point]) | ((distance == best[point]) & (candidate < at[point]))
            point = point[nearer]
            at[point], best[point], step[point] = candidate[nearer], distance[nearer], 0
        return at, best


def _parts(vectors: pa.Array, parts: int) -> np.ndarray:
    """(row, part, component) of a column of integer vectors of one length."""
    return vectors.flatten().to_numpy().astype(np.int64).reshape(len(vectors), parts, -1)


def _sums(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    parts, (entries, width) = len(codebooks), codebooks[0].shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Orchard(c) for c in shared.value]
        total = np.zeros((parts, entries, width + 1), np.int64)  # the last one counts
        for batch in batches:
            if batch.num_rows:
                points = _parts(batch.column(0), parts)
                for part, search in enumerate(searches):
                    code, _ = search.nearest(points[:, part])
                    np.add.at(total[part, :, :width], code, points[:, part])
                    total[part, :, width] += np.bincount(code, minlength=entries)
        part, entry = np.nonzero(total[:, :, width])
        rows = total[part, entry]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat((part * entries + entry), width + 1)),
                pa.array(np.tile(np.arange(width + 1), len(rows))),
                pa.array(rows.reshape(-1)),
            ],
            names=["entry", "place", "total"],
        )

    partial = vectors.select("vector").mapInArrow(add_up, "entry long, place long, total long")
    # At most parts * entries * (width + 1) rows.
    table = partial.groupBy("entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, dict[int, int]] = {}
    for row in table.collect():
        found.setdefault(row["entry"], {})[row["place"]] = int(row["total"])
    after = [c.copy() for c in codebooks]
    for number, totals in found.items():
        part, entry = divmod(number, entries)
        after[part][entry] = [totals[place] // totals[width] for place in range(width)]
    return after


def encode(
    df: DataFrame,
    id_column: str,
    vector_column: str,
    label_column: str,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """(row, codes, error, label_error, codebooks_sha256): the input row as a struct and its code.

    ``codes`` has the number of the entry of each part, ``error`` the squared distances
    summed over the parts, ``label_error`` the errors summed over rows of equal label.
    """
    spark = df.sparkSession
    bad = F.exists("given", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.struct("*").alias("row"),
        F.col(id_column).alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("given"),
    ).where(F.col("given").isNotNull() & ~bad & (F.size("given") > 0) & (F.size("given") % parts == 0))
    floor = F.transform(
        "given", lambda x: F.greatest(F.least(F.floor(x * scale), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )
    rows = keep(rows.select("row", "id", "label", floor.alias("vector")), "code-vectors")
    in_order = [F.asc_nulls_last("id"), "vector"]
    first = rows.select("id", "vector").orderBy(*in_order).limit(1).collect()
    codebooks = []
    if first:
        width = len(first[0]["vector"])
        rows = rows.where(F.size("vector") == width)
        start = rows.select("id", "vector").orderBy(*in_order).limit(entries).collect()
        table = np.array([r["vector"] for r in start], np.int64).reshape(len(start), parts, -1)
        codebooks = [table[:, part] for part in range(parts)]
        for _ in range(rounds):
            codebooks = _sums(rows, codebooks)
    said = ",".join(str(x) for book in codebooks for x in book.reshape(-1).tolist())
    digest = hashlib.sha256(said.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(codebooks)

    @F.arrow_udf("struct<codes: array<int>, error: bigint>")
    def assign(vectors: pa.Array) -> pa.Array:
        kind = pa.struct([("codes", pa.list_(pa.int32())), ("error", pa.int64())])
        if not len(vectors):
            return pa.array([], kind)
        points = _parts(vectors, parts)
        searches = in_worker(("codebooks", digest), lambda: [Orchard(book) for book in shared.value])
        found = [search.nearest(points[:, part]) for part, search in enumerate(searches)]
        codes = np.stack([f[0] for f in found], axis=1).astype(np.int32)
        ends = np.arange(0, codes.size + 1, parts, dtype=np.int32)
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(codes.reshape(-1))),
                pa.array(sum(f[1] for f in found)),
            ],
            names=["codes", "error"],
        )

    coded = keep(rows.select("row", "label", assign("vector").alias("done")), "codes")
    coded = coded.select("row", "label", "done.codes", "done.error")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    done = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return done.select("row", "codes", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
