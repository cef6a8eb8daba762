from __future__ import annotations

import hashlib
import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        double = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    order = list(PATTERNS)
    found = [
        (*m.span(), kind) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if passes(kind, m.group())
    ]
    return sorted(found, key=lambda s: (s[0], order.index(s[2])))


TEXTS = [
    "", "no data", "a@b", "a@b.c", "x@@a.b", "a@b@c.d", "a@b.c@d.e", "me@x.y.", "é@a.b", "ü.me+1@a-b.co.uk, you@x.y",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "1.2.3", "0001.2.3.004", "4111 1111 1111 1111", "4111-1111-1111-1111 2",
    "+1 (523) 555-7040.", "+1", "+123456789", "+1 2", "+44 20 7946 0958 +1 212 555 0100", "1  2  3", "@@@@", "+" * 50 + "12345678901",
    "card 4012888888881881, ip 10.0.0.1, mail a.b@c.d, call +1 212-555-0100",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "a@" * 150_000, "1.2." * 70_000, "+1" + "(" * 300_000):
        pii.base_spans(text)
        pii.windows(text)


def test_likelihood_and_gradient_by_enumeration():
    text = "call 555 1234567 or 10.0.0.1"
    at = pii.lattice(text, 0, len(text))
    random = np.random.default_rng(0)
    kinds = len(pii.KINDS)
    model = pii.Model(
        random.standard_normal((kinds, len(pii.FEATURES))), random.standard_normal(3), random.standard_normal((kinds + 1, kinds + 1))
    )
    scores = model.segment_scores(at)

    def paths(place):
        if place == len(at.tokens):
            yield []
            return
        for rest in paths(place + 1):
            yield [(place, place + 1, 0, model.plain[at.plain[place]]), *rest]
        for (first, end), own in zip(at.segments, scores):
            if first == place:
                for kind, rest in product(range(kinds), paths(end)):
                    yield [(first, end, kind + 1, own[kind]), *rest]

    def worth(path):
        moves = zip([0, *(p[2] for p in path)], [p[2] for p in path])
        return sum(p[3] for p in path) + sum(model.move[m] for m in moves)

    every = [(worth(p), p) for p in paths(0)]
    total = np.logaddexp.reduce([w for w, _ in every])
    top, best = max(every, key=lambda e: e[0])
    assert model.best(at) == [(f, e, pii.KINDS[k - 1]) for f, e, k, _ in best if k]
    gold = {(f, e): k for f, e, k, _ in best if k}
    likelihood, step = pii._gradient(model, at, gold)
    assert likelihood == pytest.approx(top - total)
    for weight, change, place in ((model.plain, step.plain, (1,)), (model.move, step.move, (0, 0)), (model.span, step.span, (3, 0))):
        weight[place] += 1e-6
        assert (pii._gradient(model, at, gold)[0] - likelihood) / 1e-6 == pytest.approx(change[place], abs=1e-4)
        weight[place] -= 1e-6


@pytest.fixture(scope="module")
def model():
    texts = []
    for i in range(60):
        texts += [
            f"the call +1 ({200 + i}) 555-{7000 + i} of hre", f"ea of.{i}@mail{i % 9}.example.com the re",
            f"in {i}.{i * 2}.1.{i * 3} and", f"at {4403671232340900 + i} of hethst", f"the {1000 + i} and {i} en 20{i:02d}",
        ]
    return pii.train(texts)


def added(text, model):
    base, spans = pii.all_spans(text, model)
    return [(k, text[a:b]) for a, b, k in spans if (a, b, k) not in base]


def test_other_forms_are_found(model):
    assert added("please call (523) 555-7040 today", model) == [("phone", "(523) 555-7040")]
    assert added("call 523-555-7040 now", model) == [("phone", "523-555-7040")]
    assert added("reach bob.ray (at) example (dot) org please", model) == [("email", "bob.ray (at) example (dot) org")]


def test_clean_texts_are_left_alone(model):
    for text in ("in 2019 and 2020 there were 1000 2000 3000", "at noon. And so on", "id 0b96a8c8d79c4a5085c91969888f59b72ab", "meet at 12"):
        assert added(text, model) == []


def test_added_spans_are_those_that_overlap_no_base_span(model):
    text = " ".join(
        f"call ({200 + i}) 555-{1000 + i} or +1 {200 + i} 555 {2000 + i}, a{i}@b.org at 10.0.{i}.1 or 4012888888881881 5{i}"
        for i in range(150)
    )
    base, spans = pii.all_spans(text, model)
    found = []
    for start, end in pii.windows(text):
        at = pii.lattice(text, start, end)
        found += [(at.tokens[a][0], at.tokens[b - 1][1], k) for a, b, k in model.best(at)] if at.segments else []
    free = [f for f in found if all(f[1] <= s or e <= f[0] for s, e, _ in base)]
    assert free and len(free) < len(found)
    assert sorted(spans) == sorted(base + free)


def test_rare_types_are_learned_from_all_documents(spark, documents, monkeypatch):
    texts = spark.range(20_000).selectExpr(
        "id AS doc_id", "if(id = 13579, 'dial +1 523 555 7040 now', concat('ip 10.0.', id % 250, '.', id % 7)) AS text"
    )
    monkeypatch.setattr(pii, "train", lambda windows: windows)
    sample = pii.learn(texts.repartition(5), "doc_id", "text", max_windows=20)
    assert sum("+1 523" in w for w in sample) == 1
    assert len(sample) == 21 and len(set(sample)) == 21
    assert sorted(pii.learn(texts.repartition(2), "doc_id", "text", max_windows=20)) == sorted(sample)


def test_awkward_rows(awkward, nothing):
    for docs, count in ((awkward, 10), (nothing, 0)):
        own = pii.learn(docs, "doc_id", "text")
        rows = docs.select("text", pii.find(F.col("text"), own).alias("f")).select(
            "text", "f.*", pii.mask(F.col("text"), F.col("f.spans")).alias("masked")
        ).collect()
        assert len(rows) == count and all(r.base == [] and r.masked == r.text for r in rows)


def test_masking_merges_overlaps(spark, documents, model):
    text = "a 4012888888881881 b x@y.z"
    docs = documents(text).select("text", pii.find(F.col("text"), model).alias("f"))
    assert docs.select(pii.mask(F.col("text"), F.col("f.spans"))).first()[0] == "a <CARD> b <EMAIL>"


def test_query(spark, sample_dir):
    rows = {r.doc_id: r for r in queries.op3_pii(spark, sample_dir).collect()}
    texts = spark.read.parquet(f"{sample_dir}/documents.parquet").collect()
    assert len(rows) == len(texts)
    for doc in texts:
        r, base = rows[doc.doc_id], brute(doc.text or "")
        named = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[2] == k for s in base) for k in PATTERNS]
        assert set(named) <= set(r.spans.split(",")) | {""}
