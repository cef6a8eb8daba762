"""Exact top-k search by inner product in a forest of M-trees.

All vectors are dealt to trees of a few ten thousand rows each; rows close to the
same one of some sampled pivots go to the same tree as far as sizes allow. A tree is
a set of pages. Each page has a routing object, a covering radius around it and the
distance to the routing object of its parent; leaf pages hold vectors with their
distances to the page's routing object. With the query q, a page can hold no inner
product above ``q*o + |q| * radius``, where o is its routing object. Pages are
visited in descending order of this bound until it falls below the k-th best score.
Before ``q*o`` or a vector's score is computed at all, the stored distance d to the
parent p gives the bound ``q*p + |q| * (d + radius)``, which leaves most of them out.
Bounds are rounded up and ties are not left out, so results are exact.

Blocks of queries meet every tree and go down it together; each pair gives back k rows for
a query.

Vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Only vectors of the query's length are candidates. A query never finds
rows with its own id; other rows that repeat an id are candidates one by one. A query
id that occurs several times is searched once, with the least of its vectors. With
fewer than k candidates all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import keep

LEAF, FANOUT = 128, 16


def _distances(rows: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - center).astype(np.float64) ** 2).sum(1))


class Tree:
    """Pages as arrays; the children of a page, or the rows of a leaf, are consecutive."""

    def __init__(self, arrays):
        self.rows, self.ids, self.row_distance = arrays["rows"], arrays["ids"], arrays["row_distance"]
        self.center, self.radius = arrays["center"], arrays["radius"]
        self.parent_distance = arrays["parent_distance"]
        self.first, self.last, self.is_leaf = arrays["first"], arrays["last"], arrays["is_leaf"]
        self.computed = 0

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        random = np.random.default_rng(len(ids))
        pages, order, row_distance = [], [], []

        def routing(members: np.ndarray) -> int:
            """The member next to the mean."""
            inside = rows[members]
            return members[int(_distances(inside, inside.mean(0)).argmin())]

        queue = [(np.arange(len(ids)), None)]
        at = 0
        while at < len(queue):  # breadth first, so children are consecutive
            members, parent = queue[at]
            center = routing(members)
            away = _distances(rows[members], rows[center])
            page = {
                "center": center,
                "radius": away.max(),
                "parent_distance": 0.0 if parent is None else _distances(rows[[center]], rows[parent])[0],
                "is_leaf": len(members) <= LEAF,
            }
            if page["is_leaf"]:
                page["first"], page["last"] = len(order), len(order) + len(members)
                order.extend(members)
                row_distance.extend(away)
            else:
                seeds = rows[random.choice(members, FANOUT, replace=False)].astype(np.float64)
                inside = rows[members].astype(np.float64)
                nearest = ((seeds**2).sum(1)[None, :] - 2 * inside @ seeds.T).argmin(1)
                parts = [members[nearest == s] for s in range(FANOUT)]
                parts = [p for p in parts if len(p)]
                if len(parts) == 1:  # copies of one vector
                    parts = np.array_split(members, FANOUT)
                page["first"], page["last"] = len(queue), len(queue) + len(parts)
                queue.extend((p, center) for p in parts)
            pages.append(page)
            at += 1
        return {
            "rows": rows[order],
            "ids": ids[order],
            "row_distance": np.array(row_distance),
            "center": rows[[p["center"] for p in pages]],
            **{n: np.array([p[n] for p in pages]) for n in ("radius", "parent_distance", "first", "last", "is_leaf")},
        }

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, score, id) of each query's k best, ties to smaller ids.

        Queries go down the tree together: a page is visited once, for those queries
        whose bound it still reaches, pages of the highest bound first. Products are of
        whole numbers in double precision, exact below 2^53.
        """
        length = np.sqrt((queries**2).sum(1)) * (1 + 1e-9)
        best = _Best(len(queries), k)
        everyone = np.arange(len(queries))
        root = queries @ self.center[0]
        self.computed += len(queries)
        bound = root + length * self.radius[0]
        pages = [(-bound.max(), 0, everyone, root, bound)]
        while pages:
            highest, page, asking, dot, bound = heapq.heappop(pages)
            still = bound >= best.worst[asking]
            if not still.any():
                continue
            asking, dot = asking[still], dot[still]
            part = slice(self.first[page], self.last[page])
            is_leaf = self.is_leaf[page]
            reach = self.row_distance[part] if is_leaf else self.parent_distance[part] + self.radius[part]
            within = dot[:, None] + length[asking, None] * reach >= best.worst[asking, None]
            some = np.flatnonzero(within.any(0))
            if not len(some):
                continue
            within, some = within[:, some], some + part.start
            self.computed += int(within.sum())
            dots = queries[asking] @ (self.rows if is_leaf else self.center)[some].T
            if is_leaf:
                best.offer(asking, own[asking], self.ids[some], dots, within)
                continue
            bounds = dots + length[asking, None] * self.radius[some]
            near = within & (bounds >= best.worst[asking, None])
            for column in np.flatnonzero(near.any(0)).tolist():
                of = np.flatnonzero(near[:, column])
                reached = bounds[of, column]
                heapq.heappush(pages, (-reached.max(), int(some[column]), asking[of], dots[of, column], reached))
        return best.query, best.score, best.id


class _Best:
    """The k best of each query so far, and the bound a page must reach to matter."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.worst = np.full(queries, -np.inf)
        self.query, self.score, self.id = np.array([], np.int64), np.array([]), np.array([], np.int64)

    def offer(self, asking: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray, within: np.ndarray):
        row, column = np.nonzero(within & (scores >= self.worst[asking, None]) & (ids[None, :] != own[:, None]))
        if not len(row):
            return
        query = np.concatenate([self.query, asking[row]])
        score = np.concatenate([self.score, scores[row, column]])
        found = np.concatenate([self.id, ids[column]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        first = np.searchsorted(query, query)
        rank = np.arange(len(query)) - first
        keep_ = rank < self.k
        self.query, self.score, self.id = query[keep_], score[keep_], found[keep_]
        full = rank[keep_] == self.k - 1
        self.worst[self.query[full]] = self.score[full] - 1e-3


def _save(arrays: dict[str, np.ndarray]) -> bytes:
    file = io.BytesIO()
    np.savez(file, **arrays)
    return file.getvalue()


def _load(blob: bytes) -> Tree:
    with np.load(io.BytesIO(blob)) as file:
        return Tree({name: file[name] for name in file.files})


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length, whole numbers in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def top_k(
    df: DataFrame,
    id_column: str,
    vector_column: str,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    tree_rows: int = 32_768,
    block_queries: int = 1024,
    pivots: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which ``is_query`` holds.

    A component x counts as ``floor(scale * x)``; scores must stay below 2^53.
    ``pivots`` vectors are sampled to deal the rows.
    """
    spark = df.sparkSession
    bad = F.exists("given", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(vector_column).cast("array<double>").alias("given"),
        is_query.alias("asks"),
    )
    rows = rows.where(F.col("id").isNotNull() & F.col("given").isNotNull() & ~bad & (F.size("given") > 0))
    vector = F.transform("given", lambda x: F.floor(x * scale)).alias("vector")
    rows = keep(rows.select("id", vector, "asks", F.size("given").alias("length")), "search-rows")

    parts = []
    for row in rows.groupBy("length").count().collect():  # one row in sane tables
        own = rows.where(F.col("length") == row["length"])
        parts.append(_search(own, row["count"], k, tree_rows, block_queries, pivots))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, count: int, k: int, tree_rows: int, block_queries: int, pivots: int) -> DataFrame:
    spark = rows.sparkSession
    sample = rows.select("vector").orderBy(F.xxhash64("id")).limit(pivots).toArrow()
    sample = spark.sparkContext.broadcast(_matrix(sample["vector"]))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = _matrix(batch.column("vector"))
            pivot = ((sample.value**2).sum(1)[None, :] - 2 * points @ sample.value.T).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("vector"), pa.array(pivot)], names=["id", "vector", "pivot"]
            )

    trees = max(1, -(-count // tree_rows))
    # By pivot, and by id within one, so that a pivot with very many rows is split.
    dealt = (
        rows.select("id", "vector")
        .mapInArrow(near, "id long, vector array<bigint>, pivot long")
        .repartitionByRange(trees, "pivot", F.xxhash64("id"), "id")
    )

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, size = [], [], 0

        def tree() -> pa.RecordBatch:
            blob = _save(Tree.build(np.concatenate(ids), np.concatenate(points)))
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("id").to_numpy())
            points.append(_matrix(batch.column("vector")))
            size += batch.num_rows
            if size >= 2 * tree_rows:
                yield tree()
                ids, points, size = [], [], 0
        if size:
            yield tree()

    forest = keep(
        dealt.select("id", "vector").mapInArrow(plant, "blob binary").select(
            F.monotonically_increasing_id().alias("tree"), "blob"
        ),
        "forest",
    )
    queries = keep(
        rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector")).withColumnRenamed("id", "query"),
        "queries",
    )
    blocks = max(1, -(-queries.count() // block_queries))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = queries.select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"))
    # Query blocks meet trees: a join by block with the numbers of all trees.
    numbers = forest.select("tree", every)
    meeting = asked.join(numbers, "block").unionByName(forest.select("tree", every, "blob"), allowMissingColumns=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, asked, vectors = None, [], []

        def answer() -> pa.RecordBatch:
            own = np.concatenate(asked)
            query, score, found = tree.search(np.concatenate(vectors), own, k)
            asked.clear()
            vectors.clear()
            columns = [own[query], found, score.astype(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            is_tree = batch.column("query").is_null().to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(is_tree)
            for begin, end in zip([0, *starts], [*starts, batch.num_rows]):
                rows = batch.slice(begin, end - begin)
                if not rows.num_rows:
                    continue
                if is_tree[begin]:
                    if asked:
                        yield answer()
                    tree = _load(rows.column("blob")[0].as_py())
                    rows = rows.slice(1)
                if rows.num_rows:
                    asked.append(rows.column("query").to_numpy())
                    vectors.append(_matrix(rows.column("vector")))
        if asked:
            yield answer()

    return (
        meeting.repartition("tree", "block")
        .sortWithinPartitions("tree", "block", F.col("query").isNotNull())
        .mapInArrow(search, "query_id long, vec_id long, score long")
    )
