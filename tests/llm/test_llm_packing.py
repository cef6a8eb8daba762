from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from basketry.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(queries.TOKENIZER)
    found.encode_special_tokens = True
    return found


def check(rows, texts, tokenizer, size=2048):
    """Each id lies in one piece; sequences have no gaps and hold at most ``size``."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc, text in texts.items():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : at]))
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == size or at & (at - 1) == 0  # nothing is padded


def test_query(spark, sample_dir, tokenizer):
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(queries.op4_packing(spark, sample_dir).collect(), texts, tokenizer)


def test_awkward_rows(spark, awkward, nothing, tokenizer):
    texts = {r.doc_id: r.text for r in awkward.collect()}
    check(queries.packed(spark, awkward).collect(), texts, tokenizer)
    assert queries.packed(spark, nothing).count() == 0


def test_repeated_rows_are_packed_one_by_one(spark, documents):
    docs = documents("some words here")
    rows = queries.packed(spark, docs.unionAll(docs)).collect()
    assert sum(r.length for r in rows) == 2 * rows[0].doc_tokens


def test_all_bytes_tokenize_as_the_library_does(spark, documents, tokenizer):
    text = "".join(chr(c) for c in range(1, 0x3000)) + "🙂日本 <|endoftext|>  x"
    [row] = documents(text).select(
        packing.tokenize(F.col("text"), packing.Tokens(spark, queries.TOKENIZER, public_tokenizers.PATTERN, 1)).alias("ids")
    ).collect()
    ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert bytes(row.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_costs_are_balanced():
    lengths = [900, 850, 800, 400, 400, 300, 300, 50, 40, 30, 20, 6]
    packer = packing._Packer(1024, 1.0, 1 / 1024, 0)
    placed, left = packer.fill([((i, b""), 0, n) for i, n in enumerate(lengths)], [1024] * 4)
    assert not left and sum(p[2] for p in placed) == sum(lengths) == 4096
    cost = defaultdict(float)
    for _, _, length, sequence, _ in placed:
        cost[sequence] += packer.cost(length)
    assert max(cost.values()) < 1.4 * min(cost.values())


def test_added_tokens_get_their_ids_as_by_default(spark, documents):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n y <|endoftext", "no token"]
    default = Tokenizer.from_file(queries.TOKENIZER)
    assert default.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    check(queries.packed(spark, documents(*texts)).collect(), dict(enumerate(texts, 1)), default)


def test_added_tokens_that_take_in_spaces_are_as_the_library_has_them():
    import json

    with open(queries.TOKENIZER, encoding="utf-8") as file:
        form = json.load(file)
    form["added_tokens"][0] |= {"lstrip": True, "single_word": True}
    form = json.dumps(form)
    own, default = packing._Pieces(form, public_tokenizers.PATTERN, True), Tokenizer.from_str(form)
    for text in ("a  <|endoftext|> b", "a<|endoftext|>b", " <|endoftext|>", "plain"):
        ids = default.encode(text, add_special_tokens=False).ids
        assert own.encode_all(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_unseen_words_go_to_the_model_together(tokenizer):
    from types import SimpleNamespace

    with open(queries.TOKENIZER, encoding="utf-8") as file:
        own = packing._Pieces(file.read(), public_tokenizers.PATTERN, True)
    model, calls = own.tokenizer.model, []
    own.tokenizer = SimpleNamespace(model=SimpleNamespace(tokenize=lambda word: calls.append(word) or model.tokenize(word)))
    text = " ".join("abcdefghij"[i // 100] + "klmnopqrst"[i // 10 % 10] + "uvwxyzabcd"[i % 10] * 3 for i in range(1000))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert own.encode_all(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert len(calls) < 1000 / 10


@pytest.mark.parametrize("cache_bytes", [0, 20_000, packing.CACHE_BYTES])
def test_texts_tokenised_together_are_as_the_library_has_them(cache_bytes):
    import pyarrow as pa

    with open(queries.TOKENIZER, encoding="utf-8") as file:
        form = file.read()
    own, default = packing._Pieces(form, public_tokenizers.PATTERN, True, cache_bytes), Tokenizer.from_str(form)
    texts = ["voilà là à la", "\xa0 a\xa0 b", "a \t b", "\t \tb", "a\x1c b \x1c", "  two  ", " ", "it's  a\n\n b, b. b", "日本 日本 é"]
    texts += ["", None, "x <|endoftext|>  y", *(f"common {i} words{i} common" for i in range(300))]
    for _ in range(2):
        found = list(own.encode_rows(pa.array(texts, pa.large_string())))
        for text, ids in zip(texts, found, strict=True):
            wanted = default.encode(text or "", add_special_tokens=False).ids
            assert ids == struct.pack(f"<{len(wanted)}I", *wanted), text


def test_pieces_in_use_stay_in_a_full_cache():
    import pyarrow as pa

    from basketry.llm.pieces import RowEncoder

    class Counting(RowEncoder):
        made: list[str] = []

        def encode_match(self, match):
            self.made.append(match)
            return [len(match)]

    encoder = Counting(public_tokenizers.PATTERN, 20_000)
    for i in range(200):
        list(encoder.encode_rows(pa.array([f"a common word{'x' * (i % 40)}{'y' * (i // 40)}"], pa.large_string())))
    assert encoder.old_later and encoder.made.count(" common") == 1


def test_batches_are_cut_and_joined_to_about_the_bytes_asked_for():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"document": list(range(100)), "text": ["x" * 1000] * 100})
    for enough in (1, 5_000, 250_000):
        groups = list(packing._together(iter([batch, batch.slice(0, 0), batch]), enough))
        assert [k for keys, _ in groups for k in keys.to_pylist()] == list(range(100)) * 2
        assert max(texts.nbytes for _, texts in groups) < 2 * enough + 2_100
