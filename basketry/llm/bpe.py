"""Byte-level byte-pair encoding and decoding.

A text is cut by a pattern and each match is encoded on its own. Bytes are mapped
to the first 256 code points, so an Aho-Corasick automaton over strings finds the
longest vocabulary entry at every byte of a match. The encoder walks from longest
entry to longest entry; two neighbours are allowed only if merging their bytes by
rank gives exactly these two entries, which is remembered per pair. Where no entry
fits behind the last one, it steps back and takes a shorter one; an end from which
nothing fits is never tried again. A sequence of allowed neighbours is the result
of the merges, so the ids equal those of merging the whole match, in time that is
linear in its length (a bounded number of entries starts at each byte).

Nulls: a null text encodes as an empty one (no ids); null ids, an id outside the
vocabulary or a null among the ids decode to null; no ids decode to no bytes.
Lone surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession, functions as F

from basketry.llm.common import in_worker
from basketry.llm.pieces import PieceEncoder

#: Pairs of entries a worker remembers (some 50 MB); then it starts anew.
PAIRS = 400_000


class Encoder(PieceEncoder):
    def __init__(self, rank_file: bytes, pattern: str):
        super().__init__(pattern)
        lines = (line.split() for line in rank_file.splitlines() if line)
        self.rank = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[int, tuple[int, int]] = {}

    def merged(self, text: str) -> list[str]:
        """The plain rule: merge the neighbours of least rank until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best = min(
                (self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            )
            if best[0] == 1 << 60:
                break
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            a, b = self.token[left], self.token[right]
            known = self.pairs[pair] = self.merged(a + b) == [a, b]
        return known

    def shorter(self, rank: int) -> tuple[int, int]:
        """The longest entry that is a proper prefix of this one, and its length; (-1, 0) if there is none."""
        known = self.prefixes.get(rank)
        if known is None:
            token = self.token[rank]
            ends = (token[:n] for n in range(len(token) - 1, 0, -1))
            known = next(((self.rank[t], len(t)) for t in ends if t in self.rank), (-1, 0))
            self.prefixes[rank] = known
        return known

    def encode_match(self, match: str) -> list[int]:
        text = match.encode().decode("latin-1")
        whole = self.rank.get(text)
        if whole is not None:
            return [whole]
        longest, pairs, fits = self.automaton.iter_long, self.pairs, self.fits
        ids: list[int] = []
        dead: set[int] = set()
        at, last, size = 0, -1, len(text)
        ahead = longest(text)  # from a byte on, longest entry after longest entry
        rank, length = next(ahead)[1]
        while True:
            end = at + length
            if end not in dead:
                if last < 0:
                    fit = True
                else:
                    fit = pairs.get(last << 32 | rank)
                    if fit is None:
                        fit = fits(last, rank)
                if fit:
                    ids.append(rank)
                    if end == size:
                        return ids
                    if ahead is None:
                        ahead = longest(text, end)
                    at, last = end, rank
                    rank, length = next(ahead)[1]
                    continue
            ahead = None
            rank, length = self.shorter(rank)
            while rank < 0:  # nothing fits at this byte: a shorter entry before it
                if not ids:
                    raise ValueError("the vocabulary lacks single bytes of the text")
                dead.add(at)
                before = ids.pop()
                last = ids[-1] if ids else -1
                at -= len(self.token[before])
                rank, length = self.shorter(before)


class Decoder:
    """All entries of the vocabulary one behind the other, by rank."""

    def __init__(self, rank_file: bytes):
        lines = [line.split() for line in rank_file.splitlines() if line]
        tokens = {int(rank): base64.b64decode(token) for token, rank in lines}
        self.entries = pa.array([tokens.get(rank) for rank in range(max(tokens) + 1)], pa.large_binary())
        self.unknown = np.array([rank not in tokens for rank in range(max(tokens) + 1)])

    def decode(self, rows: pa.ListArray) -> pa.Array:
        """The bytes of each row of ids, by gathering the entries of all rows at once."""
        rows = rows.cast(pa.list_(pa.int64()))
        ids, ends = rows.flatten(), rows.value_lengths().fill_null(0).to_numpy()
        ends = np.concatenate([[0], np.cumsum(ends)])
        numbers = ids.fill_null(-1).to_numpy()
        wrong = (numbers < 0) | (numbers >= len(self.unknown))
        wrong |= self.unknown[np.where(wrong, 0, numbers)]
        taken = self.entries.take(pa.array(np.where(wrong, 0, numbers)))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][ends].copy()
        bad = np.diff(np.concatenate([[0], np.cumsum(wrong)])[ends]) > 0
        missing = pa.array(bad | ~rows.is_valid().to_numpy(zero_copy_only=False))
        texts = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), taken.buffers()[2]])
        return pc.if_else(missing, pa.scalar(None, pa.large_binary()), texts).cast(pa.binary())


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    return in_worker((rank_file, pattern), lambda: Encoder(rank_file, pattern))


class Vocabulary:
    """A rank file (bounded, some MB) and its pattern, sent to every executor once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = spark.sparkContext.broadcast(file.read())
        self.pattern = pattern


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a text column as ``array<int>``, without special tokens."""
    ranks, pattern = vocabulary.ranks, vocabulary.pattern

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        encoder = _encoder(ranks.value, pattern)
        parts = [encoder.encode(t) if t else b"" for t in texts.to_pylist()]
        offsets = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
        values = pa.py_buffer(b"".join(parts))
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, values])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return ids(text)


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Bytes of an ``array<int>`` column of ids."""
    ranks = vocabulary.ranks

    @F.arrow_udf("binary")
    def joined(rows: pa.Array) -> pa.Array:
        return in_worker(("decoder", ranks.value), lambda: Decoder(ranks.value), beside=True).decode(rows)

    return joined(ids)
