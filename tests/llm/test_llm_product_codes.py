from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from basketry.llm import product_codes, queries
from basketry.llm.common import prepare

VECTORS = "vec_id long, embedding array<float>, label int, codes long, row string"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """(id, codes, error, label error) and codebooks by comparing with every entry."""
    kept = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(point, book):
        return min((sum((a - b) ** 2 for a, b in zip(point, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for c in cut:
                of.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(of[i]) for x in zip(*of[i])] if i in of else e for i, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, y), e in zip(kept, error):
        by_label[y] = by_label.get(y, 0) + e
    done = [(i, [e for _, e in f], e, by_label[y]) for (i, _, y), f, e in zip(kept, found, error)]
    said = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(done, key=str), hashlib.sha256(said.encode()).hexdigest()


def got(df, **options):
    done = product_codes.encode(df, "vec_id", "embedding", "label", **options)
    rows = done.select("row.vec_id", "codes", "error", "label_error", "codebooks_sha256").collect()
    return sorted((tuple(r)[:4] for r in rows), key=str), {r[4] for r in rows}


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(3)


def vectors(count, dim=8, seed=1):
    random = np.random.default_rng(seed)
    rounded = np.round(random.standard_normal((count, dim)), 2).astype(np.float32)
    return [(i, [float(x) for x in v], (0, 1, None)[i % 3]) for i, v in enumerate(rounded)]


@pytest.mark.parametrize("options", [{"entries": 16}, {"entries": 5, "parts": 2, "rounds": 2}, {}])
def test_equals_comparing_all(spark, options):
    rows = vectors(300)
    want, digest = brute(rows, **options)
    assert got(frame(spark, rows), **options) == (want, {digest})


def test_awkward_rows(spark):
    rows = vectors(30)
    rows += [(40, None, 1), (41, [1.0, None] * 4, 1), (42, [math.nan] * 8, 1), (43, [math.inf] * 8, 1)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], 2), (None, rows[5][1], 1), (50, [0.0] * 8, None), (51, [-0.0] * 8, 7)]
    want, digest = brute(rows, entries=16)
    assert got(frame(spark, rows), entries=16) == (want, {digest})


def test_other_lengths_and_huge_components(spark):
    rows = vectors(20)
    odd = [(100, [1.0] * 7, 1), (101, [1.0] * 12, 1), (102, [], 1)]
    huge = [(103, [3e38, -3e38] * 4, 1)]
    found, _ = got(frame(spark, rows + odd + huge), entries=4)
    assert [r[0] for r in found if r[0] > 90] == [103]
    assert all(0 <= r[2] < 1 << 63 for r in found)


def test_empty_tables(spark):
    assert got(frame(spark, vectors(3)).where("false")) == ([], set())
    assert got(frame(spark, [(1, None, 1), (2, [], 1)])) == ([], set())


def test_one_vector_in_a_third_of_the_rows(spark):
    rows = vectors(100)
    rows += [(1000 + i, rows[7][1], 1) for i in range(50)]
    want, digest = brute(rows, entries=12)
    assert got(frame(spark, rows), entries=12) == (want, {digest})


def test_walks_leave_entries_out_and_keep_ties():
    random = np.random.default_rng(3)
    centers = random.integers(-4000, 4000, (16, 4))
    entries = np.concatenate([centers[i % 16] + random.integers(-9, 9, (1, 4)) for i in range(256)])
    entries[200] = entries[10]
    points = np.concatenate([entries[random.integers(0, 256, 500)] + random.integers(-5, 5, (500, 4)), entries])
    search = product_codes.Orchard(entries)
    code, away = search.nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == every.argmin(1)).all() and (away == every.min(1)).all()
    assert search.computed < 0.3 * every.size


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = db.sql(queries.ORACLE_SQL["op11_codes"])
    result = queries.op11_codes(spark, folder)
    assert sorted(result.columns) == sorted(want.columns)
    assert sorted(map(tuple, result.select(want.columns).collect())) == sorted(want.fetchall())
