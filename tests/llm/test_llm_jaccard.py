from __future__ import annotations

import random
import re
from itertools import combinations

from basketry.llm import jaccard, queries

UPPER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows):
    """(doc, size of its set, class) by comparing all pairs; rows with one id are one document."""
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, []).append(shingles(text))
    up = {doc: doc for doc in sets}

    def find(doc):
        while up[doc] != doc:
            doc = up[doc]
        return doc

    for a, b in combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sorted((doc, len(shingles(text)), find(doc)) for doc, text in rows)


def got(docs):
    return sorted(map(tuple, jaccard.similar_documents(docs, "doc_id", "text").collect()))


def edited(words, changes, draw):
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.random()}"
    return " ".join(words)


def test_near_copies_chains_and_shared_passages(documents):
    draw = random.Random(3)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    passage = " ".join(base[:60])
    texts = [edited(base, draw.randrange(6), draw) for _ in range(60)]
    texts += [passage + " " + " ".join(f"x{draw.random()}" for _ in range(draw.randrange(10, 40))) for _ in range(40)]
    chain = base[:50]
    for _ in range(25):  # each one like the one before, but not like the first
        chain = chain[2:] + [f"c{draw.random()}", f"d{draw.random()}"]
        texts.append(" ".join(chain))
    texts += texts[:20] + ["a b c d", "A B  C\td", "a b c", "x " * 50, "x " * 9, "a b c d e"]
    docs = documents(*texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert got(docs) == want
    assert len({c for _, _, c in want}) < len(rows) - 60


def test_the_limit_itself_links(documents):
    # 8 shingles, of which 6 are shared: 6 of 8 is 0.75; 5 of 7 is less.
    first = "a b c d e f g h i j"
    docs = documents(first, first + " k l", "q r s t u v w x y", "q r s t u v w x y z0 z1")
    assert [c for _, _, c in got(docs)] == [1, 1, 3, 4]


def test_equal_prefixes_with_different_rests(documents, monkeypatch):
    # All shingles fall into one bucket and order: groups of several sets appear.
    monkeypatch.setattr(jaccard, "_probe_length", lambda size, percent: 1)
    draw = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    docs = documents(*(edited(base, 1, draw) for _ in range(30)))
    assert len(got(docs)) == 30


def test_groups_of_a_hot_shingle_are_dealt_to_slots(documents, monkeypatch):
    """A third of the documents carries one passage: with slots of few entries, links are the same."""
    draw = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"w{i}" for i in range(60)]
    texts = [passage + " " + " ".join(f"x{draw.random()}" for _ in range(8)) for _ in range(40)]
    texts += [edited(base, draw.randrange(4), draw) for _ in range(40)]
    texts += [" ".join(f"y{draw.random()}" for _ in range(30)) for _ in range(40)]
    docs = documents(*texts)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    tables = {}
    monkeypatch.setattr(jaccard, "SLOT_ENTRIES", 5)
    entries = jaccard._entries
    monkeypatch.setattr(jaccard, "_entries", lambda *args: tables.setdefault("entries", entries(*args)))
    assert got(docs) == want
    slots = tables["entries"].groupBy("token", "slot").count().collect()
    assert max(r.slot for r in slots) > 3 and max(r["count"] for r in slots) < 40


def test_slots_are_few_at_any_size():
    counts = jaccard.np.random.default_rng(1).integers(0, 2_000_000, 1 << jaccard.SKETCH_BITS)
    counts[7] = 40 * int(counts.sum())
    slots = jaccard._slots(counts)
    assert slots[7] > 10_000 and slots.sum() - slots[7] == 0
    assert not jaccard._slots(counts // 10**9).any()


def test_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert got(awkward) == brute(rows)
    assert got(nothing) == []


def test_repeated_rows_and_null_ids(documents):
    one, two = "a b c d e f g h", "p q r s t u v w"
    docs = documents(one, two).unionAll(documents(one)).unionAll(documents(two, first=1))
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    lost = docs.selectExpr("cast(null as long) doc_id", *docs.columns[1:])
    assert {r.component_id for r in jaccard.similar_documents(lost, "doc_id", "text").collect()} == {None}


def test_prefixes_are_long_enough():
    for size in range(1, 400):
        for other in range(max(1, -(-75 * size // 100)), size + 1):  # no larger than size
            need = -(-75 * (size + other) // 175)
            assert size - need + 1 <= jaccard._probe_length(size, 75)
            assert other - need + 1 <= jaccard._index_length(other, 75)


def test_query(spark, sample_dir):
    rows = spark.read.parquet(f"{sample_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, queries.op2_jaccard(spark, sample_dir).collect())) == brute(rows)
