from __future__ import annotations

import duckdb
import numpy as np
import pytest

from basketry.llm import near_dedup, queries
from basketry.llm.common import prepare

VECTORS = "vec_id long, embedding array<float>, label int, node long, row string"


def brute(rows, limit=0.98):
    """(id, links, class, kept) of rows (id, vector, label) by comparing all."""
    def usable(vector, label):
        good = vector is not None and label is not None and all(x is not None for x in vector)
        return good and np.isfinite(vector).all() and np.any(vector)

    unit = [np.array(v, np.float64) if usable(v, y) else None for _, v, y in rows]
    unit = [u if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[
        i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= limit
        for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    low = [r[0] for r in rows]
    while True:
        new = [min([low[i]] + [low[j] for j, hit in enumerate(near[i]) if hit]) for i in range(len(rows))]
        if new == low:
            break
        low = new
    return sorted((r[0], sum(near[i]), low[i], r[0] == low[i]) for i, r in enumerate(rows))


def got(df, **options):
    done = near_dedup.near_duplicates(df, "vec_id", "embedding", "label", **options)
    return sorted(map(tuple, done.select("row.vec_id", "n_links", "component_id", "kept").collect()))


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(3)


def clusters(count, dim, seed):
    """Tight and loose clusters, and copies, with float32 components."""
    random = np.random.default_rng(seed)
    rows = []
    for i in range(count):
        center = np.random.default_rng(i % 7).standard_normal(dim)
        noise = random.standard_normal(dim) * (0.01, 0.08, 0.3)[i % 3]
        rows.append((i, [float(x) for x in (center + noise).astype(np.float32)], i % 2))
    return rows + [(count + i, rows[i][1], rows[i][2]) for i in range(40)]


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 32, "block_rows": 16}, {"leaf_rows": 100, "trees": 8}])
def test_clusters(spark, options):
    rows = clusters(400, 16, 1)
    want = brute(rows)
    found = got(frame(spark, rows), **options)
    assert sum(r[1] for r in found) >= 0.9 * sum(r[1] for r in want)
    assert all(f[1] <= w[1] for f, w in zip(found, want))  # none below the limit
    assert found == want


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], None), (5, None, 1),
        (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [1.0, nan], 1), (10, [inf, 1.0], 1), (11, [1.0, 0.0, 0.0], 1),
        (12, [2.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [], 1), (15, [-1.0, 0.0], 1), (2, [1.0, 0.0], 1),
    ]
    assert got(frame(spark, rows)) == brute(rows)
    assert got(frame(spark, rows).where("false")) == []


def test_null_ids_come_last(spark):
    rows = frame(spark, [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)])
    done = near_dedup.near_duplicates(rows, "vec_id", "embedding", "label").collect()
    assert sorted((r.row.vec_id is None, r.n_links, r.component_id, r.kept) for r in done) == [
        (False, 1, 1, True), (True, 1, 1, False)
    ]


def test_query_and_its_sql(spark, sample_dir):
    rows = spark.read.parquet(f"{sample_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want = brute([tuple(r) for r in rows])
    assert sorted(map(tuple, queries.op9_near_dedup(spark, sample_dir).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sample_dir}/embeddings.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op9_near_dedup"]).fetchall()) == want
