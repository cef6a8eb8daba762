from __future__ import annotations

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from basketry.llm import bpe, queries


@pytest.fixture(scope="module")
def reference():
    with open(queries.RANKS, "rb") as file:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    with open(queries.RANKS, "rb") as file:
        return bpe.Encoder(file.read(), public_tokenizers.PATTERN)


def ids(encoder, text):
    data = encoder.encode(text)
    return [int.from_bytes(data[i : i + 4], "little") for i in range(0, len(data), 4)]


def test_random_texts_encode_as_with_tiktoken(encoder, reference):
    draw = random.Random(1)
    letters = "ab eé\n\t  'stre0123日本🙂 \x1c\x85.,!-_<|>Zß"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 40)))
        assert ids(encoder, text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "ab" * 4000, "aaaaaaab" * 1000, "<|endoftext|>" * 9])
def test_long_matches(encoder, reference, text):
    assert ids(encoder, text) == reference.encode_ordinary(text)


def test_neighbours_decide_like_merging_the_whole(encoder):
    for word in (" unbelievable", "antidisestablishmentarianism", "thththbleedtion", "réeuxchères"):
        data = word.encode().decode("latin-1")
        merged = [encoder.rank[p] for p in encoder.merged(data)]
        assert encoder.encode_match(word) == merged


def test_awkward_rows_round_trip(spark, awkward, nothing):
    vocabulary = bpe.Vocabulary(spark, queries.RANKS, public_tokenizers.PATTERN)
    for docs, count in ((awkward, 10), (nothing, 0)):
        coded = docs.select("text", bpe.encode(F.col("text"), vocabulary).alias("coded"))
        rows = coded.select("text", "coded", bpe.decode(F.col("coded"), vocabulary).alias("back")).collect()
        assert len(rows) == count
        assert all(bytes(r.back).decode() == (r.text or "") for r in rows)


def test_what_cannot_be_decoded_is_null(spark):
    vocabulary = bpe.Vocabulary(spark, queries.RANKS, public_tokenizers.PATTERN)
    rows = spark.createDataFrame([([1, 2],), ([],), (None,), ([1, None],), ([60_000],)], "v array<int>")
    back = [r[0] for r in rows.select(bpe.decode(F.col("v"), vocabulary)).collect()]
    assert [b is None for b in back] == [False, False, True, True, True]


def test_query(spark, sample_dir, reference):
    rows = queries.op1_bpe(spark, sample_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sample_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        expected = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
