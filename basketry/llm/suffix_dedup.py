"""Repeated passages removed by suffix arrays, built by linear grouping construction.

Every byte covered by a string of ``length`` bytes that also starts earlier goes. Equal
strings are found by sorting suffixes, but only where a string can repeat at all:

1. Every string of ``length`` bytes has an anchor: among the shorter grams in it the one of
   least hash (the first of equals). Strings that are equal have equal anchors at equal
   places. An anchor that occurs once in the corpus belongs to no repeated string.
2. Strings that follow each other with one anchor make a context. Contexts go to groups by
   the bytes that all of their strings share at their place of the anchor. Contexts that are
   equal are one, of which the first place is remembered; all other places repeat.
3. Groups are gathered to texts of some ten thousand symbols, in which one symbol stands for
   the bytes a group shares; the suffix array of such a text puts equal strings side by
   side. The first of them stays, the others repeat.
4. A group too large for that is split by more of the anchor's surroundings, if need be up
   to whole strings, of which equal ones are one already. So no task takes an unbounded
   group, and none is skipped.

The suffix array is built as follows. Suffixes begin as groups by their first symbol.
Groups are processed in descending order; the context of a group is the Lyndon prefix
its suffixes share. For each suffix of the group the last earlier suffix of a smaller
group is noted (its previous smaller one, found by following such pointers), and these
earlier suffixes are moved into new groups right above the rest of theirs, by how many
members of the group follow them. In the end the order within groups is emitted: going
through the array from its least suffix, the suffix before each one, and those its
pointers lead to, take the next free places of their groups. Both passes are linear and
never rename.

Ids are ordered with null first. Rows that repeat an id are ordered by a hash of their
texts; rows that repeat id and text are one document, each handed through with the same
result. A null text is empty. Texts shorter than ``length`` are kept whole. Texts are
handled whole, whatever their length. Other columns may have any names: the input row
is handed on as a struct. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basketry.llm.common import collect_garbage, forget, keep

#: Symbols sorted together, and the most bytes a group may have before it is split.
SHARD_BYTES = 64 * 1024
_BITS = 20
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in ascending order. The last symbol must be the least and occur once."""
    size = len(symbols)
    by_symbol = np.argsort(symbols, kind="stable")
    ordered = symbols[by_symbol]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    lengths = np.diff(np.r_[first, size])
    groups = np.empty(size, np.int64)
    groups[by_symbol] = np.repeat(first, lengths)
    places = np.empty(size, np.int64)
    places[by_symbol] = np.arange(size)
    counts = np.zeros(size, np.int64)
    counts[first] = lengths
    order, group, place, members = by_symbol.tolist(), groups.tolist(), places.tolist(), counts.tolist()
    smaller = [-1] * size  # the previous smaller suffix

    end = size
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            suffix = order[start]
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = smaller[before]
            smaller[suffix] = before
            end = start
            if before >= 0 and members[of := group[before]] > 1:  # to a group of its own, above the rest
                last = of + members[of] - 1
                other, here = order[last], place[before]
                order[here], place[other] = other, here
                order[last], place[before] = before, last
                members[of] -= 1
                members[last] = 1
                group[before] = last
            continue
        followers: dict[int, int] = {}
        for suffix in sorted(order[start:end]):
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = smaller[before]
            smaller[suffix] = before
            if before >= 0:
                followers[before] = followers.get(before, 0) + 1
        end = start
        times = 1
        moving = list(followers)
        while moving:
            together: dict[int, list[int]] = {}
            for suffix in moving:
                together.setdefault(group[suffix], []).append(suffix)
            for of, some in together.items():
                rest = members[of] - len(some)
                if not rest:
                    continue
                last = of + members[of] - 1
                for suffix in some:
                    other, here = order[last], place[suffix]
                    order[here], place[other] = other, here
                    order[last], place[suffix] = suffix, last
                    last -= 1
                members[of] = rest
                above = of + rest
                members[above] = len(some)
                for suffix in some:
                    group[suffix] = above
            times += 1
            moving = [suffix for suffix in moving if followers[suffix] >= times]

    result, free, done = [0] * size, list(range(size)), bytearray(size)
    result[0] = size - 1
    done[size - 1] = 1
    for i in range(size):
        suffix = result[i] - 1
        while suffix >= 0 and not done[suffix]:
            of = group[suffix]
            result[free[of]] = suffix
            free[of] += 1
            done[suffix] = 1
            suffix = smaller[suffix]
    return np.array(result)


class Context(NamedTuple):
    """Strings that follow each other: ``width + 1`` of them, with ``low`` to ``high`` bytes
    before their anchor, as the bytes before and after those that all of them share.
    """

    low: int
    high: int
    left: bytes
    right: bytes
    width: int


def first_places(
    contexts: list[Context], groups: list[int], orders: list[tuple[int, int]]
) -> list[tuple[int, int, int]]:
    """(context, first, last): strings of the contexts that no earlier place holds, as runs.

    All contexts have the same bounds. ``groups`` tells which share the bytes between their
    sides, ``orders`` what their strings are ordered by: document and place.
    """
    length = contexts[0].high - contexts[0].low + 1  # of a string, with its shared bytes as one symbol
    sizes = np.array([len(c.left) + 1 + len(c.right) for c in contexts])
    begins = np.r_[0, np.cumsum(sizes + 1)]
    whole = b"".join(b"%s\0%s\0" % (c.left, c.right) for c in contexts)
    text = np.r_[np.frombuffer(whole, np.uint8).astype(np.int64) + 2, 0]
    text[begins[1:] - 1] = 1
    lefts = np.array([len(c.left) for c in contexts])
    text[begins[:-1] + lefts] = 258 + np.array(groups)
    at = suffix_array(text)
    owner = np.minimum(np.searchsorted(begins, at, side="right") - 1, len(contexts) - 1)
    offset = at - begins[owner]
    string = offset <= np.array([c.width for c in contexts])[owner]
    string &= at < begins[-1]
    at, owner, offset = at[string], owner[string], offset[string]
    strings = np.lib.stride_tricks.sliding_window_view(text.astype(np.int32), length)[at]
    kind = np.cumsum(np.r_[False, (strings[1:] != strings[:-1]).any(1)])
    document, place = np.array(orders, np.int64)[owner].T
    ranked = np.lexsort((place + offset, document, kind))
    firsts = ranked[np.r_[True, kind[ranked][1:] != kind[ranked][:-1]]]
    owner, offset = owner[firsts], offset[firsts]
    ranked = np.lexsort((offset, owner))
    owner, offset = owner[ranked], offset[ranked]
    breaks = np.flatnonzero((np.diff(owner) != 0) | (np.diff(offset) != 1))
    heads, tails = np.r_[0, breaks + 1], np.r_[breaks, len(owner) - 1]
    return list(zip(owner[heads].tolist(), offset[heads].tolist(), offset[tails].tolist()))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; ``gram`` is a power of two."""
    values = data.astype(np.uint64)
    step = 1
    while step < gram:
        ahead = values[step:]
        values = values[:-step] * _ODD[step.bit_length() % 3] + (ahead ^ (ahead >> np.uint64(29)))
        step *= 2
    values ^= values >> np.uint64(32)
    values *= _ODD[0]
    return values ^ (values >> np.uint64(29))


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor's gram, its hash) of every string of ``length`` bytes."""
    places, hashes = [], []
    most, wide = 1 << _BITS, length - gram + 1
    for begin in range(0, len(data) - length + 1, most - length + 1):
        values = _grams(data[begin : begin + most], gram)
        low = np.uint64(most - 1)
        least = (values & ~low) | np.arange(len(values), dtype=np.uint64)
        step = 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if wide > step:
            least = np.minimum(least[: step - wide], least[wide - step :])
        place = (least & low).astype(np.int64)
        places.append(place + begin)
        hashes.append(values[place])
    if not places:
        return np.array([], np.int64), np.array([], np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first string, last string, place in the first string, hash) of each anchor."""
    sizes = np.array([len(t) for t in texts])
    begins = np.r_[0, np.cumsum(sizes)]
    place, value = anchors(np.frombuffer(b"".join(texts), np.uint8), length, gram)
    string = np.arange(len(place))
    text = np.searchsorted(begins, string, side="right") - 1
    inside = string + length <= begins[text + 1]
    string, text, place, value = string[inside], text[inside], place[inside], value[inside]
    head = np.r_[True, np.diff(place) != 0] if len(place) else np.array([], bool)
    tail = np.r_[head[1:], True] if len(place) else head
    text = text[head]
    return text, string[head] - begins[text], string[tail] - begins[text], place[head] - string[head], value[head]


_CONTEXT = "key0 long, key1 long, shape long, sides binary, at long, start long"


class _Found(dict):
    """Contexts (key, shape and sides as bytes), each once with its first place."""

    def add(self, key: bytes, context: Context, at: int, start: int) -> None:
        low, high, left, right, width = context
        of = key + _shape(low, high, len(left), width) + left + right
        place = (at << 40) + start
        if self.setdefault(of, place) > place:
            self[of] = place

    def flush(self) -> pa.RecordBatch:
        fixed = np.frombuffer(b"".join([of[:24] for of in self]), "<i8").reshape(-1, 3).T.copy()
        sides = pa.array([of[24:] for of in self], pa.binary())
        places = [pa.array([p >> 40 for p in self.values()]), pa.array([p & (1 << 40) - 1 for p in self.values()])]
        self.clear()
        names = ["key0", "key1", "shape", "sides", "at", "start"]
        return pa.RecordBatch.from_arrays([*map(pa.array, fixed), sides, *places], names=names)


def _shape(low: int, high: int, left: int, width: int) -> bytes:
    return (low << 24 | high << 16 | left << 8 | width).to_bytes(8, "little")


def _context(shape: int, sides: bytes) -> Context:
    left = shape >> 8 & 255
    return Context(shape >> 24, shape >> 16 & 255, sides[:left], sides[left:], shape & 255)


def _narrowed(context: Context, key: bytes, low: int, high: int) -> tuple[int, bytes, Context] | None:
    """(first string, key, context) of the strings with ``low`` to ``high`` bytes before the anchor."""
    before = context.low + len(context.left)  # the anchor, in the first string
    first, last = max(0, before - high), min(context.width, before - low)
    if first > last:
        return None
    stop = len(context.left) - (low - context.low)
    skip = context.high - high
    end = len(context.right) - (context.width - last)
    key = xxhash.xxh3_128_digest(key + context.left[stop:] + context.right[:skip], low << 8 | high)
    return first, key, Context(low, high, context.left[first:stop], context.right[skip:end], last - first)


def _distinct(contexts: DataFrame) -> DataFrame:
    """Each context once, with its first place: the least document, and the least start there."""
    # One number for both, as minima of numbers need no sort.
    place = F.expr("cast(at as decimal(19, 0)) * 1099511627776bd + cast(start as decimal(13, 0))")
    first = contexts.groupBy("key0", "key1", "shape", "sides").agg(F.min(place).alias("place"))
    return first.select(
        "key0", "key1", "shape", "sides",
        F.expr("cast(place div 1099511627776bd as long)").alias("at"),
        F.expr("cast(place % 1099511627776bd as long)").alias("start"),
    )


def _removed(size: int, spans: list[int], stay: list[dict], length: int) -> np.ndarray:
    """Which bytes of a text go: those in repeated strings."""
    repeated = np.zeros(max(0, size - length + 1) + 1, np.int8)
    for span in spans:
        start, width = span >> 16, span >> 8 & 255
        repeated[start : start + width + 1] = 1
    for run in stay:
        repeated[run["first"] : run["last"] + 1] = 0
    edges = np.diff(repeated, prepend=0)
    gone = np.zeros(size, bool)
    for start, end in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        gone[start : end + length - 1] = True
    return gone


def dedup_passages(
    df: DataFrame, id_column: str, text_column: str, length: int = 100, group_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(row, kept, n_bytes, n_removed, n_spans): the input row as a struct and what stays of its text.

    ``kept`` is binary, as a passage may begin or end within a character. ``length`` is 16
    to 255 bytes.
    """
    if not 16 <= length <= 255:
        raise ValueError("length must be 16 to 255 bytes")
    spark = df.sparkSession
    gram = 1 << (length // 3).bit_length() - 1
    docs = df.select(
        F.struct("*").alias("row"),
        F.col(id_column).cast("long").alias("doc"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            text, first, last, before, value = _runs(texts, length, gram)
            value = value.view(np.int64)
            _, number, times = np.unique(value, return_inverse=True, return_counts=True)
            sure = times[number] > 1
            heads = np.zeros(len(times), bool)
            heads[number[sure]] = True
            known = np.zeros(len(times), np.int64)
            known[number] = value
            # An anchor that repeats here needs no counting: its places are spread, and one row speaks for it.
            spread = np.where(sure, value ^ (np.arange(len(value)) * 0x5851F42D4C957F2D), value)
            taken = pa.array(text)
            n = int(heads.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[spread, known[heads]]),
                    pa.array(np.r_[np.where(sure, 0, 1), np.full(n, 2)].astype(np.int8)),
                    pa.concat_arrays([batch.column("doc").take(taken), pa.nulls(n, pa.int64())]),
                    pa.concat_arrays([batch.column("hash").take(taken), pa.nulls(n, pa.int64())]),
                    pa.array(np.r_[first << 16 | (last - first) << 8 | before, np.full(n, -1)]),
                ],
                names=["anchor", "weight", "doc", "hash", "span"],
            )

    found = docs.select("doc", "hash", "text").mapInArrow(
        find, "anchor long, weight byte, doc long, hash long, span long"
    )
    times = F.expr("sum(weight) OVER (PARTITION BY anchor)")
    repeated = found.withColumn("times", times).where("span >= 0 and (weight = 0 or times > 1)")
    spans = repeated.groupBy("doc", "hash").agg(F.collect_set("span").alias("spans"))
    # Documents with repeated anchors, numbered in order of their ids.
    spans = spans.repartitionByRange("doc", "hash").sortWithinPartitions("doc", "hash")
    spans = keep(spans.withColumn("at", F.monotonically_increasing_id()), "spans")
    collect_garbage(spark)

    def same(left: DataFrame, right: DataFrame):
        return left["doc"].eqNullSafe(right["doc"]) & (left["hash"] == right["hash"])

    third = (length - gram) // 3
    bounds = [(0, third), (third + 1, 2 * third + 1), (2 * third + 2, length - gram)]
    kinds = [(low, high, low << 8 | high) for low, high in bounds if low <= high]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            found = _Found()
            for text, spans, at in zip(*(batch.column(n).to_pylist() for n in ("text", "spans", "at"))):
                document = at << 40
                for span in spans:
                    start = span >> 16
                    end, anchor = start + (span >> 8 & 255), start + (span & 255)
                    for low, high, seed in kinds:
                        first = max(start, anchor - high)
                        width = min(end, anchor - low) - first
                        if width >= 0:
                            head, tail = anchor - low, anchor + length - high
                            of = digest(text[head:tail], seed) + _shape(low, high, head - first, width)
                            of += text[first:head] + text[tail : first + width + length]
                            if found.setdefault(of, document + first) > document + first:
                                found[of] = document + first
                    if len(found) > 100_000:
                        yield found.flush()
            if found:
                yield found.flush()

    texts = docs.select("doc", "hash", "text").join(spans, same(docs, spans)).select("text", "spans", "at")
    level = keep(_distinct(texts.mapInArrow(gather, _CONTEXT)), "contexts")
    collect_garbage(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _Found()
            for r in batch.to_pylist():
                context = _context(r["shape"], r["sides"])
                key = np.array([r["key0"], r["key1"]], "<i8").tobytes()
                middle = (context.low + context.high) // 2
                for low, high in ((context.low, middle), (middle + 1, context.high)):
                    if part := _narrowed(context, key, low, high):
                        first, key_of, inner = part
                        found.add(key_of, inner, r["at"], r["start"] + first)
            if found:
                yield found.flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}  # whole groups, by their bounds
        sizes: dict[tuple[int, int], int] = {}
        out: list[tuple[int, int, int]] = []

        def array(bounds: tuple[int, int]) -> None:
            sizes[bounds] = 0
            groups, orders, contexts = zip(*waiting.pop(bounds))
            for i, first, last in first_places(contexts, groups, orders):
                out.append((orders[i][0], orders[i][1] + first, orders[i][1] + last))

        def close(group: list[tuple[int, int, int, bytes]]) -> None:
            if len(group) == 1:
                [(at, start, shape, _)] = group
                out.append((at, start, start + (shape & 255)))
                return
            bounds = group[0][2] >> 24, group[0][2] >> 16 & 255
            inside = waiting.setdefault(bounds, [])
            number = inside[-1][0] + 1 if inside else 0
            inside += [(number, (at, start), _context(shape, sides)) for at, start, shape, sides in group]
            sizes[bounds] = sizes.get(bounds, 0) + sum(len(r[3]) + 2 for r in group)
            if sizes[bounds] >= SHARD_BYTES:
                array(bounds)

        def table() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[], [], []])]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["at", "first", "last"])

        group: list[tuple[int, int, int, bytes]] = []
        key = None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key0", "key1", "at", "start", "shape", "sides")]
            for key0, key1, *row in zip(*columns):
                if (key0, key1) != key:
                    if group:
                        close(group)
                    group, key = [], (key0, key1)
                group.append(tuple(row))
            yield table()
        if group:
            close(group)
        for bounds in list(waiting):
            array(bounds)
        yield table()

    stay = []
    while True:
        large = level.groupBy("key0", "key1").agg(F.sum(F.octet_length("sides")).alias("bytes"), F.count("*").alias("n"))
        large = keep(large.where(F.col("bytes") > group_bytes).where("n > 1").select("key0", "key1"), "large-groups")
        some_large = not large.isEmpty()
        small = level.join(large, ["key0", "key1"], "left_anti") if some_large else level
        in_groups = small.repartition("key0", "key1").sortWithinPartitions("key0", "key1")
        stay.append(keep(in_groups.mapInArrow(sort, "at long, first long, last long"), "first-places"))
        if not some_large:
            break
        parts = level.join(large, ["key0", "key1"]).select(*level.columns).mapInArrow(split, _CONTEXT)
        after = keep(_distinct(parts), "contexts")
        forget(level)
        level = after
    forget(level)
    every = stay[0]
    for one in stay[1:]:
        every = every.unionAll(one)
    by_text = every.groupBy("at").agg(F.collect_list(F.struct("first", "last")).alias("stay"))
    marked = spans.join(by_text, "at", "left").select("doc", "hash", "spans", "stay")

    @F.arrow_udf("struct<kept: binary, n_bytes: bigint, n_removed: bigint, n_spans: bigint>")
    def rest(texts: pa.Array, spans: pa.Array, stay: pa.Array) -> pa.Array:
        rows = []
        for text, some, firsts in zip(texts.to_pylist(), spans.to_pylist(), stay.to_pylist()):
            removed = runs = 0
            kept = text
            if some:
                gone = _removed(len(text), some, firsts or [], length)
                removed = int(gone.sum())
                runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((kept, len(text), removed, runs))
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 4, kinds)]
        return pa.StructArray.from_arrays(columns, names=["kept", "n_bytes", "n_removed", "n_spans"])

    done = docs.join(marked, same(docs, marked), "left").select("row", rest("text", "spans", "stay").alias("done"))
    return done.select("row", "done.kept", "done.n_bytes", "done.n_removed", "done.n_spans")
