from __future__ import annotations

import hashlib

import duckdb
import numpy as np
import pytest

from basketry.llm import line_dedup, queries
from basketry.llm.common import keep

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(rows, least=10):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)

    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc)
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == doc
        ]
        yield doc, len(lines), len(lines) - len(kept), "\n".join(kept)


def got(docs):
    done = line_dedup.dedup_lines(docs, "doc_id", "text")
    return sorted(tuple(r) for r in done.select("row.doc_id", "n_lines", "n_dropped", "kept").collect())


def test_small_documents(documents):
    docs = documents(
        "A common line here\nonly mine, really", " a COMMON line here\t\nshort", "short\nshort\nnew new new new",
        "ÄÄÄÄÄÄÄÄÄÄ\nx", "ääääääääää\nx", "ÄÄÄÄÄÄÄÄÄÄ", "twice in one doc\ntwice in one doc", "new new new new\n",
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == sorted(brute(rows))


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward) == sorted(brute(rows))
    assert got(nothing) == []


def test_repeated_rows_and_null_ids(documents):
    docs = documents("a line that repeats").unionAll(documents("a line that repeats"))
    assert got(docs) == [(1, 1, 0, "a line that repeats")] * 2
    lost = docs.unionAll(docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:]).limit(1))
    done = line_dedup.dedup_lines(lost, "doc_id", "text").where("row.doc_id is null").collect()
    assert [r.n_dropped for r in done] == [1]


def test_rows_without_an_id_do_not_gather(spark, documents, monkeypatch):
    """A third of all rows has no id: dropped lines come back row by row, probes of a common line are dealt."""
    texts = [f"the same line everywhere\nline {i} of its own only\nline {i % 90} of some of them" for i in range(300)]
    docs = documents(*texts).selectExpr("if(doc_id % 3 = 0, null, doc_id) doc_id", "text", "1 part", "2 nth")
    kept = {}
    monkeypatch.setattr(line_dedup, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    monkeypatch.setattr(line_dedup, "forget", lambda df: None)
    rows = [((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    done = line_dedup.dedup_lines(docs, "doc_id", "text")
    done = done.selectExpr("coalesce(row.doc_id, 9223372036854775807L)", "n_lines", "n_dropped", "kept")
    assert sorted(map(tuple, done.collect())) == sorted(brute(rows))
    assert max(len(r.gone) for r in kept["lines-dropped"].collect()) <= 3


def test_a_row_repeated_very_often_is_probed_by_several_tasks(spark, documents):
    docs = documents("an earlier holder of it", first=0).unionAll(
        documents(*["an earlier holder of it"] * 500).selectExpr("7L doc_id", "text", "lang", "source", "n_chars", "row", "doc", "ids")
    )
    assert [r[2] for r in got(docs)] == [0] + [1] * 500


def test_a_very_common_line_is_copied_to_several_tasks(spark, documents):
    docs = documents(*(f"the same line everywhere\nline number {i} of its own" for i in range(600)))
    assert sum(r[2] for r in got(docs)) == 599


@pytest.mark.parametrize("count", [0, 1, 2, 1000, 20_000])
def test_perfect_hash_is_minimal_and_finds_all(count):
    random = np.random.default_rng(count)
    high, low = (random.integers(0, 1 << 64, count, dtype=np.uint64) for _ in range(2))
    high[: count // 2] = high[0] if count else 0  # equal first halves do not matter
    blob = line_dedup.build_shard(high, low, np.full(count, 2), np.arange(count))
    shard = line_dedup.Shard.load(blob)
    assert sorted(shard.number(high, low)) == list(range(count))
    assert not shard.to_drop(high, low, np.arange(count)).any()
    assert shard.to_drop(high, low, np.arange(count) + 1).all()
    others = random.integers(0, 1 << 64, 1000, dtype=np.uint64)
    assert not count or shard.to_drop(others, others, np.zeros(1000)).sum() <= 1


def test_query_and_its_sql(spark, sample_dir):
    rows = spark.read.parquet(f"{sample_dir}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute(rows))
    assert sorted(map(tuple, queries.op10_line_dedup(spark, sample_dir).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sample_dir}/documents.parquet'")
    assert sorted(db.execute(queries.ORACLE_SQL["op10_line_dedup"]).fetchall()) == want
