from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import queries, topk
from basketry.llm.common import prepare

VECTORS = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, every, k):
    whole = {}
    for key, vector in rows:
        good = key is not None and vector and all(x is not None and math.isfinite(x) for x in vector)
        if good:
            whole.setdefault(key, []).append([math.floor(256 * np.float32(x).astype(float)) for x in vector])
    out = []
    for q, vectors in whole.items():
        if q % every == 0:
            v = min(vectors)
            found = [
                (-sum(a * b for a, b in zip(v, w)), key)
                for key, others in whole.items() for w in others if key != q and len(w) == len(v)
            ]
            out += [(q, rank, key, -score) for rank, (score, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def got(df, every, **options):
    return sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % every == 0, **options).collect()))


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 1, 7, "x") for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("options", [{"k": 5}, {"k": 3, "tree_rows": 200, "block_queries": 8}])
def test_clusters_copies_and_ties(spark, options):
    random = np.random.default_rng(2)
    rows = []
    for i in range(900):
        center = np.random.default_rng(i % 5).standard_normal(8)
        vector = center + random.standard_normal(8) * 0.05 if i % 3 else center
        rows.append((i, [float(x) for x in vector.astype(np.float32)]))
    assert got(frame(spark, rows), 25, **options) == brute(rows, 25, options["k"])


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-0.001, 0.0]),
        (7, [1.0]), (8, []), (9, [0.0, 0.0]), (1, [1.0, 2.0]), (None, [9.0, 9.0]), (50, [-1.0, -2.0]), (100, [3.0]),
        (150, [0.5, 0.5]), (150, [0.25, 9.0]),
    ]
    assert got(frame(spark, rows), 50, k=5) == brute(rows, 50, 5)
    assert got(frame(spark, rows).where("false"), 50) == []
    assert got(frame(spark, rows), 77) == brute(rows, 77, 5)  # hardly any query


def test_bounds_save_computations():
    random = np.random.default_rng(0)
    centers = random.integers(-1000, 1000, (40, 16))
    points = (centers[random.integers(0, 40, 8000)] + random.integers(-20, 20, (8000, 16))).astype(np.int64)
    tree = topk.Tree(topk.Tree.build(np.arange(8000), points))
    asked = np.arange(0, 8000, 400)
    query, score, found = tree.search(points[asked].astype(float), asked, 5)
    for at, i in enumerate(asked):
        scores = points @ points[i]
        order = [int(j) for j in np.lexsort((np.arange(8000), -scores)) if j != i][:5]
        got = [(int(s), int(j)) for s, j in zip(score[query == at], found[query == at])]
        assert got == [(int(scores[j]), j) for j in order]
    assert tree.computed < 0.5 * 20 * 8000


def test_query_and_its_sql(spark, sample_dir):
    rows = spark.read.parquet(f"{sample_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([tuple(r) for r in rows], 50, 5)
    assert sorted(map(tuple, queries.op8_topk(spark, sample_dir).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sample_dir}/embeddings.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op8_topk"]).fetchall()) == want
