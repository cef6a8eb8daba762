"""Near duplicates among embeddings by a forest of random-projection trees.

Every tree splits recursively along random directions (one per level) at thresholds
between quantiles of the node, and a vector near a threshold goes to both sides
(spill), so two similar vectors are parted only if they differ much in the chosen
direction. Thresholds are fitted on a bounded sample; every vector is sent through
every tree. Vectors with the same label in one leaf are compared exactly; large
leaves are compared block against block, so no group is unbounded and none is
skipped. A pair that meets in several leaves is counted in the first only, which
each side can tell from the list of leaves it carries. Linked vectors are united
within leaves, then across leaves by connected components.

Equal vectors with equal labels are one class from the start; a class counts as
often as it has rows, and its copies are never compared or sent around.

Vectors that are null or zero, hold null or non-finite components or have no label
link with nothing. Vectors of different lengths are not compared. A row that repeats
id and vector counts as one more vector. Different vectors under one id are one node
whose links add up. Null ids are handed through and come after all others as
components. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import connected_components, keep

_LAST = (1 << 63) - 1


class Forest:
    """Directions by tree and level, and thresholds by tree and node (heap order)."""

    def __init__(self, sample: np.ndarray, dim: int, trees: int, depth: int, least: int, spill: float, seed: int):
        self.spill, self.depth = spill, depth
        random = np.random.default_rng(seed)
        self.directions = random.standard_normal((trees, max(depth, 1), dim))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.thresholds = np.full((trees, 1 << depth), np.nan)  # NaN: a leaf
        for tree in range(trees):
            inside = {1: sample}
            for level in range(depth):
                below = {}
                for node, rows in inside.items():
                    if len(rows) < least:
                        continue
                    at = rows @ self.directions[tree, level]
                    cut = np.quantile(at, random.uniform(0.4, 0.6))
                    self.thresholds[tree, node] = cut
                    below |= {2 * node: rows[at <= cut], 2 * node + 1: rows[at > cut]}
                inside = below

    def leaves(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; a leaf's number tells its tree, and trees come in order."""
        found_rows, found_leaves = [], []
        for tree, directions in enumerate(self.directions):
            at_level = rows @ directions.T
            row, node = np.arange(len(rows)), np.ones(len(rows), np.int64)
            for level in range(self.depth + 1):
                cut = self.thresholds[tree, node] if level < self.depth else np.full(len(row), np.nan)
                done = np.isnan(cut)
                found_rows.append(row[done])
                found_leaves.append((tree << self.depth + 2) + node[done])
                row, node, cut = row[~done], node[~done], cut[~done]
                if not len(row):
                    break
                away = at_level[row, level] - cut
                left, right = away <= self.spill, away >= -self.spill
                row = np.concatenate([row[left], row[right]])
                node = np.concatenate([2 * node[left], 2 * node[right] + 1])
        return np.concatenate(found_rows), np.concatenate(found_leaves)


def _matrix(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, in double precision."""
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _united(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index each of ``size`` nodes is connected with through pairs (a, b)."""
    low = np.arange(size)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return low


def _compare(group: pa.Table, limit: float, kind: str) -> pa.Table:
    """Links of each vector that this leaf counts, and its least neighbour in the group."""
    node = group["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    node, block = node[order], group["block"].to_numpy()[order]
    copies = group["copies"].to_numpy()[order]
    blobs, lists = group["vector"].to_pylist(), group["leaves"].to_pylist()
    rows = _matrix([blobs[i] for i in order], kind)
    leaf = group["leaf"][0].as_py()
    member = [np.frombuffer(lists[i], np.int64) for i in order]
    earlier, at = np.unique(np.concatenate(member), return_inverse=True)
    of = np.repeat(np.arange(len(node)), [len(m) for m in member])
    meets = np.zeros((len(node), len(earlier)), np.float32)
    meets[of[earlier[at] < leaf], at[earlier[at] < leaf]] = 1
    first, last = group["first"][0].as_py(), group["last"][0].as_py()
    links, left, right = np.zeros(len(node), np.int64), [], []
    ones = np.flatnonzero(block == first)
    others = ones if first == last else np.flatnonzero(block == last)
    for start in range(0, len(ones), 1024):
        part = ones[start : start + 1024]
        near = rows[part] @ rows[others].T >= limit
        if first == last:
            near &= others[None, :] > part[:, None]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        here = (meets[part] @ meets[others].T)[i, j] == 0
        i, j = part[i], others[j]
        left.append(i)
        right.append(j)
        links += np.bincount(i[here], copies[j[here]], len(node)).astype(np.int64)
        links += np.bincount(j[here], copies[i[here]], len(node)).astype(np.int64)
    if not left:
        return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
    low = _united(len(node), np.concatenate(left), np.concatenate(right))
    some = np.flatnonzero((links > 0) | (low != np.arange(len(node))))
    return pa.table({"node": node[some], "links": links[some], "least": node[low[some]]})


def near_duplicates(
    df: DataFrame,
    id_column: str,
    vector_column: str,
    label_column: str,
    limit: float = 0.98,
    trees: int = 6,
    spill: float = 0.03,
    leaf_rows: int = 4096,
    block_rows: int = 2048,
    sample_rows: int = 16_384,
    seed: int = 1,
) -> DataFrame:
    """(row, n_links, component_id, kept): the input row as a struct and its class.

    Trees are as deep as ``leaf_rows`` vectors a leaf ask for, but stop where fewer than
    16 of the ``sample_rows`` sampled vectors are left. ``spill`` is the distance from a
    threshold, for vectors of length 1, within which a vector goes to both sides.
    """
    spark = df.sparkSession
    kind = "<f4" if df.schema[vector_column].dataType.elementType.typeName() == "float" else "<f8"
    vector = F.col("vector")
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = df.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).alias("vector"),
    )
    # A null or non-finite component makes the sum null, NaN or infinite.
    rows = rows.withColumn("square", square)
    usable = rows.where("label is not null and square > 0 and square < double('Infinity')")
    classes = usable.groupBy("label", "vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    classes = keep(classes, "vectors")
    lengths = classes.groupBy(F.size("vector").alias("length")).count().collect()  # one row in sane tables

    parts = []
    for length in lengths:
        own = classes.where(F.size("vector") == length["length"])
        sample = own.select("vector").orderBy(F.xxhash64("node", "label")).limit(sample_rows).toArrow()
        sample = _matrix([np.array(v, kind).tobytes() for v in sample["vector"].to_pylist()], kind)
        depth = max(0, min(24, int(np.ceil(np.log2(max(1, length["count"] / leaf_rows))))))
        forest = spark.sparkContext.broadcast(
            Forest(sample, length["length"], trees, depth, 16, spill, seed)
        )

        def route(batches, forest=forest):
            for batch in batches:
                vectors = [np.array(v, kind).tobytes() for v in batch.column("vector").to_pylist()]
                if not vectors:
                    continue
                row, leaf = forest.value.leaves(_matrix(vectors, kind))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(len(vectors) + 1))
                lists = [leaf[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(taken),
                        pa.array(leaf),
                        batch.column("node").take(taken),
                        batch.column("copies").take(taken),
                        pa.array(vectors, pa.binary()).take(taken),
                        pa.array(lists, pa.binary()).take(taken),
                    ],
                    names=["label", "leaf", "node", "copies", "vector", "leaves"],
                )

        label = own.schema["label"].dataType.simpleString()
        routed = own.select("label", "node", "copies", "vector").mapInArrow(
            route, f"label {label}, leaf long, node long, copies long, vector binary, leaves binary"
        )
        routed = keep(routed, "leaves")
        key = ["label", "leaf"]
        sizes = routed.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
        dealt = (
            routed.join(sizes.where("blocks > 1"), key, "left")
            .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .withColumn("first", F.least("block", "other"))
            .withColumn("last", F.greatest("block", "other"))
            .drop("other", "blocks")
        )
        parts.append(
            dealt.groupBy(*key, "first", "last").applyInArrow(
                lambda group: _compare(group, limit, kind), "node long, links long, least long"
            )
        )
    if not parts:
        found = spark.createDataFrame([], "node long, links long, least long")
    else:
        found = parts[0]
        for part in parts[1:]:
            found = found.unionAll(part)
        found = keep(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    united = connected_components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    classes = classes.join(links, "node", "left").join(united, "node", "left").select(
        "label",
        "vector",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    done = rows.join(classes, ["label", "vector"], "left")
    component = F.coalesce("component", "id")
    return done.select(
        "row",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.nullif(component, F.lit(_LAST)).alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )
