"""Dropping lines that other documents hold, by probing sharded hash arrays.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys of at least ``min_chars`` code points are hashed to 128 bits. The
distinct hashes of all documents are dealt to shards of bounded size; each shard
becomes a minimal perfect hash (a bit array per level: a key is placed on the
first level where no other key falls on its bit) that numbers its keys without
gaps, and arrays over these numbers: a fingerprint, in how many documents the key
occurs, and the least document. Documents send their hashes to the shards, each
task streams them past one shard at a time, and only what is to be dropped comes
back. Shards with more than their share of probes (a very common line) are copied
to several tasks; there can only be as many of them as shares.

Keys found in at least two documents stay only in the least document that holds
them; there, and in documents without such keys, all lines stay, in order.

Null and empty texts are one empty line, whose key is too short to go. Very long texts
are hashed line by line like others. Rows that repeat an id are one document: a key they
alone hold stays in all of them. Rows with a null id are together one document behind all
others. What is to be dropped comes back by id and hash of the text, so that no task gets
the lines of all rows with one id. Columns of the input may have any names, they travel
inside ``row``. Two different keys
with equal hashes (of 128 bits) would be taken for one; that is not to be expected
below 10^15 lines. An empty table gives no rows.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import forget, keep

#: Distinct hashes in a shard, on average.
SHARD_KEYS = 16_384
#: Bits of a level for each key that is still without a place.
BITS_PER_KEY = 2.0
_LAST = (1 << 63) - 1


def keys_of(text: str | None, min_chars: int) -> list[bytes | None]:
    """The hash of each line; None for lines too short to be dropped."""
    keys: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(b" \t\n\x0b\x0c\r").lower()  # on bytes: A-Z only
        long = len(key) >= 4 * min_chars or len(key) >= min_chars <= len(key.decode())
        keys.append(xxhash.xxh3_128_digest(key) if long else None)
    return keys


def _level_bits(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall on a level: their two halves mixed with the level's number."""
    x = high + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= low
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x % np.uint64(size)).astype(np.int64)


def build_shard(high: np.ndarray, low: np.ndarray, count: np.ndarray, least: np.ndarray) -> bytes:
    """Minimal perfect hash of distinct keys (two halves, uint64) with its arrays."""
    sizes, bits = [], []
    left_high, left_low = high, low
    while len(left_high):
        size = max(64, int(BITS_PER_KEY * len(left_high)))
        at = _level_bits(left_high, left_low, len(sizes), size)
        single = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(single)
        alone = single[at]
        left_high, left_low = left_high[~alone], left_low[~alone]
    shard = {
        "sizes": np.array(sizes, np.int64),
        "bits": np.packbits(np.concatenate(bits)) if bits else np.zeros(0, np.uint8),
    }
    number = Shard(shard).number(high, low)
    shard["prints"] = np.zeros(len(high), np.uint32)
    shard["counts"] = np.zeros(len(high), np.uint32)
    shard["least"] = np.zeros(len(high), np.int64)
    shard["prints"][number] = low.astype(np.uint32)
    shard["counts"][number] = np.minimum(count, (1 << 32) - 1)
    shard["least"][number] = least
    file = io.BytesIO()
    np.savez(file, **shard)
    return file.getvalue()


class Shard:
    """A shard in memory, asked for many keys at once."""

    def __init__(self, arrays):
        self.sizes = arrays["sizes"]
        self.bits = np.unpackbits(arrays["bits"])[: int(self.sizes.sum())].astype(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.arrays = arrays

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        with np.load(io.BytesIO(blob)) as file:
            return cls({name: file[name] for name in file.files})

    def number(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for some that are not in the shard (others get any number)."""
        found = np.full(len(high), -1, np.int64)
        left, start = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = start + _level_bits(high[left], low[left], level, int(size))
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left, start = left[~hit], start + int(size)
            if not len(left):
                break
        return found

    def to_drop(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether each key is held by another document before ``doc``."""
        number = self.number(high, low)
        known = number >= 0
        number[~known] = 0
        known &= self.arrays["prints"][number] == low.astype(np.uint32)
        return known & (self.arrays["counts"][number] >= 2) & (self.arrays["least"][number] != doc)


def _uint64(column: pa.Array) -> np.ndarray:
    return column.to_numpy().view(np.uint64)  # fails rather than rounds if there are nulls


def _document_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, part, high, low): the distinct keys of each row (doc, part, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys_out = [], []
            for text in batch.column("text").to_pylist():
                keys = {key for key in keys_of(text, min_chars) if key}
                counts.append(len(keys))
                keys_out += keys
            halves = np.frombuffer(b"".join(keys_out), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(c).to_numpy(), counts)) for c in ("doc", "part")]
                + [pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc", "part", "high", "low"],
            )

    return docs.mapInArrow(run, "doc long, part long, high long, low long")


def _shards(distinct: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): one row for each shard."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        blob = build_shard(
            _uint64(group["high"].combine_chunks()),
            _uint64(group["low"].combine_chunks()),
            group["docs"].to_numpy(),
            group["least"].to_numpy(),
        )
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([blob], pa.binary())})

    dealt = distinct.withColumn("shard", F.expr(f"pmod(high, {shards}L)"))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, blob binary")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, its arrays first: give back the keys to drop."""
    shard, number = None, None
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        blobs = batch.column("blob")
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(shards)]):
            if start == end:
                continue
            if number != shards[start]:
                shard, number = Shard.load(blobs[int(start)].as_py()), shards[start]
            part = batch.slice(start, end - start)
            part = part.filter(part.column("blob").is_null())  # its copies' arrays are the same
            high, low = _uint64(part.column("high")), _uint64(part.column("low"))
            doc = part.column("doc").to_numpy()
            drop = shard.to_drop(high, low, doc)
            keys = np.stack([high[drop], low[drop]], 1).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[drop]),
                    part.column("part").filter(pa.array(drop)),
                    pa.array([keys[i : i + 16] for i in range(0, len(keys), 16)], pa.binary()),
                ],
                names=["doc", "part", "key"],
            )


def _without(texts: pa.Array, dropped: pa.Array, min_chars: int) -> pa.Array:
    rows = []
    for text, gone in zip(texts.to_pylist(), dropped.to_pylist()):
        lines = (text or "").split("\n")
        kept = lines
        if gone:
            gone = set(gone)
            kept = [line for line, key in zip(lines, keys_of(text, min_chars)) if key not in gone]
        rows.append({"kept": "\n".join(kept), "n_lines": len(lines), "n_dropped": len(lines) - len(kept)})
    kind = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    return pa.array(rows, kind)


def dedup_lines(df: DataFrame, id_column: str, text_column: str, min_chars: int = 10) -> DataFrame:
    """(row, kept, n_lines, n_dropped): the input row as a struct and what became of its text."""
    docs = df.select(
        F.struct("*").alias("row"),
        F.coalesce(F.col(id_column).cast("long"), F.lit(_LAST)).alias("doc"),
        # What goes from a row follows from its document and text: rows of one id (or none)
        # are told apart by a hash of the text, so they never gather by their id.
        F.xxhash64(text_column).alias("part"),
        F.col(text_column).alias("text"),
    )
    keys = keep(_document_keys(docs.select("doc", "part", "text"), min_chars), "line-keys")
    distinct = keep(
        keys.groupBy("high", "low")
        .agg(F.count("*").alias("docs"), F.min("doc").alias("least"), F.max("doc").alias("most"))
        .select("high", "low", F.expr("if(least = most, 1L, docs)").alias("docs"), "least", F.col("docs").alias("probes")),
        "lines",
    )
    n_keys, n_probes = distinct.agg(F.count("*"), F.sum("probes")).first()
    shards = max(1, -(-n_keys // SHARD_KEYS))
    # A share is the probes of an average task; at most that many shards exceed one.
    shares = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = max(1.0, (n_probes or 0) / shares)
    by_shard = F.expr(f"pmod(high, {shards}L)").alias("shard")
    heavy = (
        distinct.groupBy(by_shard)
        .agg(F.ceil(F.sum("probes") / F.lit(share)).alias("copies"))
        .where("copies > 1")
    )
    copies = F.coalesce("copies", F.lit(1))
    # Broadcast: at most ``shares`` rows, whatever the input.
    heavy = F.broadcast(heavy)
    arrays = (
        _shards(distinct, shards)
        .join(heavy, "shard", "left")
        .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), "blob")
    )
    probes = (
        keys.select("doc", "part", "high", "low", by_shard, F.monotonically_increasing_id().alias("nth"))
        .join(heavy, "shard", "left")
        .select("shard", F.pmod(F.xxhash64("nth"), copies).alias("copy"), "doc", "part", "high", "low")
    )
    dropped = (
        arrays.unionByName(probes, allowMissingColumns=True)
        .repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", F.col("blob").isNull())
        .mapInArrow(_probe, "doc long, part long, key binary")
    )
    # A set holds the lines of one text, however many rows repeat it.
    per_text = keep(dropped.groupBy("doc", "part").agg(F.collect_set("key").alias("gone")), "lines-dropped")
    forget(keys)
    forget(distinct)

    @F.arrow_udf("struct<kept: string, n_lines: bigint, n_dropped: bigint>")
    def without(texts: pa.Array, gone: pa.Array) -> pa.Array:
        return _without(texts, gone, min_chars)

    result = docs.join(per_text, ["doc", "part"], "left").select("row", without("text", "gone").alias("done"))
    return result.select("row", "done.kept", "done.n_lines", "done.n_dropped")
