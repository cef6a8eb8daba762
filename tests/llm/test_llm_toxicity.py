from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from basketry.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_finds_what_edit_distance_finds():
    terms = ("abcd", "abcde", "badabc", "cabbagecab", "dab*", "abaddc*")
    automaton, draw = toxicity.Automaton(terms), random.Random(0)

    def brute(word):
        found = []
        for number, term in enumerate(terms):
            bare = term.removesuffix("*")
            ends = [word[:n] for n in range(len(word) + 1)] if term.endswith("*") else [word]
            edits = min(distance(e, bare) for e in ends)
            if edits <= toxicity.allowed_edits(bare):
                found.append((number, edits))
        return min(found, key=lambda f: (f[1], f[0]), default=None)

    words = ["".join(draw.choice("abcde") for _ in range(draw.randint(0, 11))) for _ in range(3000)]
    words += [t.strip("*")[:i] + draw.choice("abx") + t.strip("*")[i + 1 :] for t in terms for i in range(len(t))]
    words += ["cabbagecab", "cabagecb", "badbc", "abcdef", "dabble", "abaddcxyz", "abadcxyz", ""]
    hits = [brute(w) for w in words]
    assert [automaton.match(w) for w in words] == hits
    assert sum(h is not None for h in hits) > 50


def test_quotation_is_told_from_abuse():
    scorer = toxicity.Scorer(("idiot",), (5.0,))
    assert scorer.features("you are an idiot, really")[1:3] != [0.0, 0.0]
    assert scorer.features("you are an idiot, really")[2] == 0
    for text in ('he called me "idiot" and left', "the word idiot comes from Greek"):
        assert scorer.features(text)[1] == 0 < scorer.features(text)[2]
    assert scorer.features("you idoit")[3] == 0 < scorer.features("you idiott!")[3]


@pytest.fixture
def learned(spark, documents):
    draw = random.Random(4)
    texts, labels = [], []
    for i in range(300):
        words = [f"{draw.choice('bcdfgh')}{draw.choice('aeiou')}{draw.choice('klmnp')}a" for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            words[draw.randrange(30)] = draw.choice(["rotter", "vilefool"])
        texts.append(" ".join(words))
        labels.append((i + 1, int(bad), "x"))
    docs = documents(*texts)
    table = spark.createDataFrame([*labels, (1, None, "x"), (None, 1, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    return docs, table, toxicity.learn(docs, table, "doc_id", "text", "toxic")


def scores(df, model):
    return [r[0] for r in df.select(toxicity.score(F.col("text"), model)).collect()]


def test_learning(learned, documents):
    docs, _, model = learned
    assert set(model.terms) == {"rotter", "vilefool"}
    by_doc = dict(docs.select("doc_id", toxicity.score(F.col("text"), model)).collect())
    assert all((s >= 0.5) == ((i - 1) % 5 == 0) for i, s in by_doc.items())
    low = scores(documents("plain words", "", None, "plain words"), model)
    assert len(set(low)) == 1 and low[0] < 0.5
    found, told = scores(documents("you vilefol").unionAll(documents("plain words")), model)
    assert found > told


def test_awkward_rows(learned, awkward, nothing):
    _, table, model = learned
    assert all(0 <= s <= 1 for s in scores(awkward, model))
    assert scores(nothing, model) == []
    for docs, labels in ((nothing, table), (awkward, table.where("false")), (awkward, table.where("toxic = 1"))):
        none = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
        assert none.terms == () and len(set(scores(awkward, none))) == 1


def test_query_on_the_held_out_fold(spark, sample_dir):
    folder = sample_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in queries.op5_toxicity(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert sum(rows[r.doc_id].predicted == r.toxic for r in labels) >= 0.9 * len(labels)


def test_rows_that_share_a_passage_are_all_learned_from(spark, documents):
    passage = " ".join(f"passage{chr(97 + i)}" for i in range(20))
    draw, texts = random.Random(7), []
    for i in range(160):
        own = ["".join(draw.choice("bcdfgklmnp") + draw.choice("aeiou") for _ in range(3)) for _ in range(30)]
        if i >= 120:
            own[draw.randrange(30)] = "rotter"
        texts.append(f"{passage} {' '.join(own)}")
    labels = spark.createDataFrame([(i + 1, int(i >= 120)) for i in range(160)], "doc_id long, toxic int")
    assert toxicity.learn(documents(*texts), labels, "doc_id", "text", "toxic").terms == ("rotter",)


def test_rows_go_only_for_one_of_their_label_that_is_much_alike(spark):
    text = [f"w{i}" for i in range(400)]

    def changed(count):
        return " ".join(text[: 400 - count] + [f"x{count}y{i}" for i in range(count)])

    rows = [
        (1, changed(0), False),
        (2, changed(0), False),  # a copy
        (3, changed(0), True),  # the other label
        (4, changed(30), False),  # similarity 0.86 with 1
        (5, changed(200), False),  # a shared passage: 0.33
        (6, changed(190), False),  # 0.36 with 1
    ]
    rows = spark.createDataFrame(rows, "doc long, text string, toxic boolean")
    assert {r.doc for r in toxicity.distinct_rows(rows.select("doc", "text"), rows.select("doc", "toxic")).collect()} == {1, 3, 5, 6}


def test_copies_do_not_displace_others_from_the_sample(spark, documents):
    texts = ["a rotter " * 5] * 30 + [f"vile{c} words" for c in "abcdefgh"]
    texts += [f"plain {a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    labels = spark.createDataFrame([(i + 1, int(i < 38)) for i in range(138)], "doc_id long, toxic int")
    docs = documents(*texts)
    model = toxicity.learn(docs, labels, "doc_id", "text", "toxic", max_positive=9)
    assert "vile*" in model.terms


def test_all_significant_terms_are_learned(spark, documents):
    """More beginnings of words than were once kept: 100 words of eight letters, no two alike."""
    letters = "bcdfghklmn"
    bad = [f"{a}{b}a{b}{a}o{b}{a}" for a in letters for b in letters]
    draw = random.Random(3)
    texts = [" ".join(draw.sample(bad, 10)) for _ in range(400)] + [f"plain{i}" for i in range(2000)]
    labels = spark.createDataFrame([(i + 1, int(i < 400)) for i in range(2400)], "doc_id long, toxic int")
    model = toxicity.learn(documents(*texts), labels, "doc_id", "text", "toxic")
    scorer = toxicity.Scorer(model.terms, model.worth)
    assert all(scorer.features(word)[1] for word in bad)


def test_repeated_rows_are_learned_from_once(spark, documents):
    texts = [f"{'you awful snark' if i % 3 == 0 else 'a fine day'} word{i} and thing{i * 7}" for i in range(60)]
    docs = documents(*texts)
    labels = spark.createDataFrame([(i + 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    hot = docs.where("doc_id = 2").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("copy")
    once = toxicity.learn(docs, labels, "doc_id", "text", "toxic")
    again = toxicity.learn(docs.unionAll(hot), labels, "doc_id", "text", "toxic")
    assert once.terms == again.terms and once.weights == pytest.approx(again.weights)
