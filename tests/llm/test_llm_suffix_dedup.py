from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from basketry.llm import queries, suffix_dedup


def brute(rows, length=100):
    """(id, bytes, removed, spans, kept) of rows (id, text) by remembering every string."""
    seen = set()
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            string = data[i : i + length]
            if string in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(string)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        yield doc, len(data), sum(gone), runs, kept


def got(docs, **options):
    done = suffix_dedup.dedup_passages(docs, "doc_id", "text", **options)
    rows = done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    return sorted((tuple(r)[:4] + (bytes(r.kept),) for r in rows), key=lambda r: (r[0] is not None, r[0]))


def want(docs, **options):
    return list(brute([(r.doc_id, r.text) for r in docs.collect()], **options))


def words(chance, count):
    return " ".join("".join(chance.choices("abcdeé", k=chance.randint(1, 7))) for _ in range(count))


def shared_passages(seed, count=40):
    """Texts with passages of others, cut anywhere, one within another, changed and repeated."""
    chance = random.Random(seed)
    passages = [words(chance, n) for n in (10, 20, 30, 60, 200)] + ["ab" * 150, "x" * 400]
    texts = []
    for _ in range(count):
        parts = []
        for _ in range(chance.randint(0, 5)):
            part = chance.choice([*passages, words(chance, 30), *(texts[-1:])])
            start = chance.randint(0, len(part) // 2)
            parts.append(part[start : start + chance.randint(50, 500)])
        texts.append(chance.choice(["", " ", "\n"]).join(parts))
    return texts


@pytest.mark.parametrize("symbols", [1, 2, 3, 200])
def test_suffix_array(symbols):
    chance = np.random.default_rng(symbols)
    for size in [*range(40)] * 4:
        text = np.r_[np.tile(chance.integers(1, symbols + 1, size), 1 + size % 3), 0]
        in_order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_dedup.suffix_array(text).tolist() == in_order


@pytest.mark.parametrize("options", [{}, {"length": 40}, {"length": 16}, {"length": 255}])
def test_equals_remembering_every_string(documents, options):
    docs = documents(*shared_passages(1))
    assert got(docs, **options) == want(docs, **options)


@pytest.mark.parametrize("group_bytes", [1, 600, 5000])
def test_large_groups_are_split(documents, group_bytes):
    chance = random.Random(7)
    line = words(chance, 14)
    texts = [f"{words(chance, 12)} {line} {words(chance, 12)}" for _ in range(150)]
    texts += shared_passages(2, 20)
    docs = documents(*texts)
    assert got(docs, group_bytes=group_bytes) == want(docs)


def test_awkward_rows(awkward, nothing, documents):
    assert got(awkward) == want(awkward)
    assert got(nothing) == []
    docs = documents("a" * 5000, "a" * 99, "a" * 100, "\x00" * 300, "é" * 70 + "ü", "ü" + "é" * 70, "🙂" * 60)
    assert got(docs) == want(docs)


def test_texts_beyond_one_piece_of_the_anchor_search(documents):
    chance = random.Random(9)
    long = words(chance, 400_000)  # over 1 MiB
    docs = documents(long, long[500_000:500_400], long[1_040_000:1_060_000])
    assert got(docs) == want(docs)
    assert sum(r[2] for r in got(docs)) >= 20_400


def test_repeated_rows_and_null_ids(spark, documents):
    text = words(random.Random(3), 60)
    docs = documents(text, text, "other")
    null_id = docs.selectExpr("if(doc_id = 2, null, doc_id) doc_id", *docs.columns[1:])
    assert [r[:3] for r in got(null_id)] == [(None, len(text.encode()), 0), (1, len(text.encode()), len(text.encode())), (3, 5, 0)]
    twice = docs.where("doc_id = 1").unionAll(docs.where("doc_id = 1"))  # one document
    assert [r[2] for r in got(twice)] == [0, 0]


def test_query_equals_sql(spark, sample_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sample_dir}/documents.parquet'")
    result = db.sql(queries.ORACLE_SQL["op12_suffix_dedup"])
    found = queries.op12_suffix_dedup(spark, sample_dir).select(result.columns).collect()
    rows = sorted(result.fetchall())
    assert sorted(map(tuple, found)) == rows
    assert sum(r[2] for r in rows) > 0
