"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece is estimated as linear plus quadratic in its length, as
attention within a document is. Each task packs the documents it reads, window by
window: whole sequences are cut off long documents first; what remains is taken
in descending length, and each piece goes to the sequence of least cost among
those with room for it. Where none has room, the piece is cut to fill the
cheapest sequence that is not full. A window opens as many sequences as its
tokens fill and hands the rest to the next one. The last window of a task opens
sequences of decreasing powers of two for its rest, so nothing is padded at all.

No shuffle is needed and memory is bounded by a window, the texts tokenised together
(some MB of an Arrow batch or several) and the longest document.
Sequence ids hold the partition's number, so a task that runs again gives the same.

Added tokens of the tokenizer's file that stand in a text get their ids, as by the
library's default, where that is asked for; otherwise they are ordinary text.

Null or empty texts hold the end token alone. Repeated rows are packed like others,
null ids stay null. An empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from basketry.llm.common import in_worker
from basketry.llm.pieces import CACHE_BYTES, RowEncoder

#: Texts tokenised together, as repeated pieces are then looked up once.
TOGETHER_BYTES = 16 * 1024**2
#: Matches given to the tokenizer's model at once.
JOINED = 64


class _Pieces(RowEncoder):
    def __init__(self, tokenizer_file: str, pattern: str, added_tokens: bool, cache_bytes: int = CACHE_BYTES):
        super().__init__(pattern, cache_bytes)
        self.tokenizer = Tokenizer.from_str(tokenizer_file)
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        self.added = {token.content: number for number, token in added.items() if token.content}
        #: Tokens that also look at what is around them are left to the library.
        self.bare = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        # What the byte-level pre-tokenizer makes of each byte, without its own splitting.
        alphabet = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [byte for byte in range(128)]
        shown = {chr(byte): alphabet.pre_tokenize_str(chr(byte))[0][0] for byte in plain}
        for code in range(128, 2048):  # the second byte of two-byte characters gives the rest
            pair = alphabet.pre_tokenize_str(chr(code))[0][0]
            shown |= dict(zip(chr(code).encode().decode("latin-1"), pair))
        self.shown, self.space = str.maketrans(shown), shown[" "]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: What an entry may hold before a space, and a lone space.
        self.open_ends = {entry[at - 1] for entry in vocabulary for at in range(1, len(entry)) if entry[at] == self.space}
        self.open_ends |= {"", self.space}
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[number for entry, number in vocabulary.items() if entry[:1] == self.space]] = True
        model = self.tokenizer.model
        self.joins = isinstance(model, BPE) and self.space in vocabulary and not (
            model.dropout
            or model.unk_token
            or model.continuing_subword_prefix
            or model.end_of_word_suffix
            or model.ignore_merges
        )

    def encode_match(self, match: str) -> list[int]:
        """The tokenizer's model on one match; added tokens in it are ordinary text."""
        return self.ids_shown(self.show(match))

    def show(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(self.shown)

    def ids_shown(self, shown: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(shown)]

    def encode_leads(self, matches: list[str]) -> list[bytes]:
        """Ids of matches that start with a space, some matches at once.

        The model merges neighbours into entries of its vocabulary only. Where no entry holds a
        match's last byte and a space after it, merges stay within the matches.
        """
        words = self.show("".join(matches)).split(self.space)[1:]
        if not self.joins or len(words) != len(matches):
            return super().encode_leads(matches)
        found = [b""] * len(words)
        parted = []
        for i, word in enumerate(words):
            if word[-1:] in self.open_ends:
                found[i] = np.array(self.ids_shown(self.space + word), "<u4").tobytes()
            else:
                parted.append(i)
        for at in range(0, len(parted), JOINED):
            some = parted[at : at + JOINED]
            ids = np.array(self.ids_shown("".join([self.space + words[i] for i in some])), "<u4")
            data, starts = ids.tobytes(), (4 * np.flatnonzero(self.leads[ids])).tolist()
            for i, start, end in zip(some, starts, [*starts[1:], len(data)], strict=True):
                found[i] = data[start:end]
        return found

    def encode_all(self, text: str) -> bytes:
        """Ids of a text and of the added tokens in it."""
        if not any(token in text for token in self.added):
            return self.encode(text)
        if not self.bare:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = self.cut.split(text)
        plain = super().encode_rows(pa.array(parts[::2], pa.large_string()))
        tokens = [np.array([self.added[token]], "<u4").tobytes() for token in parts[1::2]]
        return b"".join(chain.from_iterable(zip_longest(plain, tokens, fillvalue=b"")))

    def encode_rows(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts and of the added tokens in them."""
        with_added = np.zeros(len(texts), bool)
        for token in self.added:
            with_added |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        if not with_added.any():
            yield from super().encode_rows(texts)
            return
        others = pc.if_else(pa.array(with_added), None, texts)
        for i, ids in enumerate(super().encode_rows(others)):
            yield self.encode_all(texts[i].as_py()) if with_added[i] else ids


def _pieces(*form) -> _Pieces:
    return in_worker(form, lambda: _Pieces(*form))


class Tokens:
    """Makes ids of texts: a file of the tokenizers library (bounded, some MB), sent to every executor once.

    ``pattern`` is the one by which that tokenizer cuts texts before merging; every text is
    followed by ``end_id``. With ``added_tokens`` the added tokens of the file get their
    ids where a text holds them, as by the library's default; without, they are ordinary
    text. ``cache_bytes`` is what a worker remembers of pieces seen: less costs time only.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        pattern: str,
        end_id: int,
        added_tokens: bool = False,
        cache_bytes: int = CACHE_BYTES,
    ):
        with open(path, encoding="utf-8") as file:
            self.file = spark.sparkContext.broadcast(file.read())
        self.pattern, self.added_tokens, self.cache_bytes = pattern, added_tokens, cache_bytes
        self.end = np.array([end_id], "<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        pieces = _pieces(self.file.value, self.pattern, self.added_tokens, self.cache_bytes)
        return (ids + self.end for ids in pieces.encode_rows(texts.cast(pa.large_string())))


def tokenize(text: Column, tokens: Tokens) -> Column:
    """Ids of a text column as binary."""

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array(tokens.encode(texts), pa.binary())

    return ids(text)


def _together(batches: Iterator[pa.RecordBatch], enough: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Keys and texts of rows that follow each other, by about ``enough`` bytes."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, batch.num_rows * enough // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            size += held[-1].nbytes
            if size >= enough:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    texts = [batch.column(1).cast(pa.large_string()) for batch in batches]
    return pa.concat_arrays([batch.column(0) for batch in batches]), pa.concat_arrays(texts)


class _Packer:
    """Pieces are (row, start, length); sequences fill up to ``size`` tokens."""

    def __init__(self, size: int, linear: float, quadratic: float, first_id: int):
        self.size, self.linear, self.quadratic = size, linear, quadratic
        self.next_id = first_id

    def cost(self, length: int) -> float:
        return self.linear * length + self.quadratic * length * length

    def whole(self, row, start: int) -> tuple:
        placed = (row, start, self.size, self.next_id, 0)
        self.next_id += 1
        return placed

    def fill(self, pieces: list[tuple], sizes: list[int]) -> tuple[list[tuple], list[tuple]]:
        """Placed pieces (row, start, length, sequence, offset), and what found no room."""
        room = np.array(sizes, np.int64)
        used = np.zeros(len(sizes), np.int64)
        cost = np.zeros(len(sizes))
        placed, left = [], []
        for row, start, length in sorted(pieces, key=lambda p: -p[2]):
            while length:
                fits = room >= length
                if not fits.any():
                    fits = room > 0
                    if not fits.any():
                        left.append((row, start, length))
                        break
                at = int(np.where(fits, cost, np.inf).argmin())
                part = min(length, int(room[at]))
                placed.append((row, start, part, self.next_id + at, int(used[at])))
                room[at] -= part
                used[at] += part
                cost[at] += self.cost(part)
                start, length = start + part, length - part
        self.next_id += len(sizes)
        return placed, left


def pack(
    df: DataFrame,
    id_column: str,
    text_column: str,
    tokens: Tokens,
    size: int = 2048,
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    window: int = 512,
    with_ids: bool = True,
    together: int = TOGETHER_BYTES,
) -> DataFrame:
    """Tokenise texts and pack them into sequences of ``size`` tokens.

    One row per piece: the id column, ``start`` (ids of the document before it),
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence
    and, unless ``with_ids`` is false, ``ids`` (binary). ``window`` is the number of
    sequences filled together, ``together`` the bytes of texts tokenised together: less costs
    time only. One Python worker per task does all, so ids of a text cross no process before
    they are packed.
    """
    kind = df.schema[id_column].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    fields = [StructField("document", kind), *(StructField(n, LongType()) for n in names)]
    schema = StructType(fields + [StructField("ids", BinaryType())] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(size, linear, quadratic, TaskContext.get().partitionId() << 33)
        waiting, held, key_type = [], 0, None

        def out(placed: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(placed), 2000):
                part = placed[i : i + 2000]
                ids = [row[1][4 * start : 4 * (start + length)] for row, start, length, _, _ in part]
                numbers = [
                    (start, length, zlib.crc32(own), len(row[1]) // 4, sequence, offset)
                    for own, (row, start, length, sequence, offset) in zip(ids, part)
                ]
                columns = [pa.array([p[0][0] for p in part], key_type)]
                columns += [pa.array(c, pa.int64()) for c in zip(*numbers)]
                columns += [pa.array(ids, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for keys, texts in _together(batches, together):
            key_type = keys.type
            ready = []
            for row in zip(keys.to_pylist(), tokens.encode(texts)):
                length = len(row[1]) // 4
                for start in range(0, length - length % size, size):
                    ready.append(packer.whole(row, start))
                if length % size:
                    waiting.append((row, length - length % size, length % size))
                    held += length % size
                if held >= window * size:
                    placed, waiting = packer.fill(waiting, [size] * (held // size))
                    held = sum(p[2] for p in waiting)
                    ready += placed
                if len(ready) >= 2000:
                    yield from out(ready)
                    ready = []
            yield from out(ready)
        if held:
            rest = held % size
            tail = [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]
            placed, _ = packer.fill(waiting, [size] * (held // size) + tail)
            yield from out(placed)

    texts = df.select(F.col(id_column).alias("document"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, schema).withColumnRenamed("document", id_column)
