"""Documents linked by the Jaccard similarity of their word shingles.

Grouped prefix join. The shingles of a document are ordered by a rough count of how
often they occur (counts of hash buckets, over all documents; a table of fixed size)
and then by hash, rarest first. Two similar sets share a shingle among their first
ones (the prefix), and a shorter prefix will do for the smaller set. Documents with
identical prefixes and sizes are one group; only groups are joined, and only where
sizes, positions and the number of shingles prefixes share allow enough overlap. Group pairs are then expanded to pairs of
distinct sets, and these are compared in full. Equal sets are one class all along.

The result needs the components of the links, not each link. So the join runs twice.
First every group is paired with two others with which it shares most prefix shingles:
one of those before it, and one of the most central (with fewest shingles of their own,
like the origin of many copies): this connects most of a large group of near copies
with two comparisons each. Then all pairs that prefixes, sizes and
positions leave are compared, except those within a component. A shingle whose groups
all belong to one component drops out before the join, and of a shingle's largest
component only pairs with others are formed. So nothing that could connect two
components is left out, and the pairs within a large class are not formed.

Words are separated by ASCII white space, A-Z count as a-z. A document with fewer
words than a shingle has is one shingle; without words (or null) its set is empty, it
links with nothing and is its own component. Shingles are compared by 64-bit hashes,
equal sets by 128-bit hashes. Rows that repeat an id are one document: links of any
of them count for all. Rows with a null id take no part and have a null component.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from basketry.llm.common import connected_components, forget, keep

#: Hash buckets whose counts order the shingles (as a power of two), a table of 2 MB.
SKETCH_BITS = 18
#: A shingle in a bucket with more than this many, and more than 16 times the mean, is dealt to slots.
SLOT_ENTRIES = 200_000
#: Hash buckets that tell which documents a comparison needs, a bit each.
FILTER_BITS = 22


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    parts = text.encode().lower().split() if text else []  # on bytes: ASCII only
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(parts), 1)], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    count = len(parts) - words + 1
    mixed = hashed[:count].copy()
    for i in range(1, words):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += hashed[i : i + count]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _set_hash(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def _probe_length(size: np.ndarray, percent: int) -> np.ndarray:
    return size + (-percent * size) // 100 + 1


def _index_length(size: np.ndarray, percent: int) -> np.ndarray:
    """Prefix that is long enough for the smaller set of a pair."""
    return size + (-2 * percent * size) // (100 + percent) + 1


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc, set) of the rows (doc, text) of a batch."""
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield doc, shingles(text.as_py(), words)


def _buckets(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _profiles(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc, size) and rows of counts by bucket (bucket, count)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)

        def rows(doc, size, bucket, count) -> pa.RecordBatch:
            columns = [pa.array(doc, pa.int64()), pa.array(size, pa.int64())]
            columns += [pa.array(bucket, pa.int64()), pa.array(count, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["doc", "size", "bucket", "count"])

        for batch in batches:
            found = list(_sets(batch, words))
            if found:
                counts += np.bincount(_buckets(np.concatenate([v for _, v in found])), minlength=len(counts))
            nothing = [None] * len(found)
            yield rows([doc for doc, _ in found], [len(v) for _, v in found], nothing, nothing)
        some = np.flatnonzero(counts)
        for start in range(0, len(some), 10_000):
            part = some[start : start + 10_000]
            yield rows([None] * len(part), [None] * len(part), part, counts[part])

    return docs.mapInArrow(run, "doc long, size long, bucket long, count long")


def _prefixes(docs: DataFrame, words: int, percent: int, counts) -> DataFrame:
    """(doc, size, high, low, grp, prefix) of documents with shingles; prefix is binary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, values in _sets(batch, words):
                if doc is None or not len(values):
                    continue
                often = counts.value[_buckets(values)]
                length = int(_probe_length(len(values), percent))
                prefix = values[np.argsort(often, kind="stable")[:length]].tobytes()
                high, low = np.frombuffer(_set_hash(values), np.int64).tolist()
                group = xxhash.xxh3_64_intdigest(prefix, len(values)) - (1 << 63)
                out.append((doc, len(values), high, low, group, prefix))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc", "size", "high", "low", "grp", "prefix"],
            )

    return docs.mapInArrow(run, "doc long, size long, high long, low long, grp long, prefix binary")


def _slots(counts: np.ndarray) -> np.ndarray:
    """In how many slots the groups of a bucket's shingles are dealt; 0: together.

    A slot has about as many entries as 16 buckets, so there are at most 16,384 of them
    beyond one per bucket, and a task's slot is a small part of any large table.
    """
    most = max(SLOT_ENTRIES, 16 * int(counts.sum()) // len(counts))
    return np.where(counts > most, -(-counts // most), 0)


def _entries(groups: DataFrame, slots) -> DataFrame:
    """(token, grp, size, pos, slot): a row for each shingle of a group's prefix.

    Slot 0 is that of all shingles which are not very frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column("prefix").to_pylist()
            lengths = np.array([len(p) // 8 for p in prefixes], np.int64)
            tokens = np.frombuffer(b"".join(prefixes), np.int64)
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            pos = np.arange(len(tokens)) - starts
            grp = np.repeat(batch.column("grp").to_numpy(), lengths)
            size = np.repeat(batch.column("size").to_numpy(), lengths)
            dealt = slots.value[_buckets(tokens.view(np.uint64))]
            slot = np.where(dealt > 0, 1 + grp % np.maximum(dealt, 1), 0)
            for at in range(0, len(tokens), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[part]) for x in (tokens, grp, size, pos, slot)],
                    names=["token", "grp", "size", "pos", "slot"],
                )

    return groups.mapInArrow(run, "token long, grp long, size long, pos long, slot long")


def _index_column(size: str, percent: int) -> Column:
    return F.expr(f"{size} - ({2 * percent} * {size} + {99 + percent}) div {100 + percent} + 1")


def _prefix_column(size: str, percent: int) -> Column:
    return F.expr(f"{size} - ({percent} * {size} + 99) div 100 + 1")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether entries of a set ``a`` and a set ``b`` that is no larger leave room for enough overlap."""
    need = f"(({percent} * ({a}size + {b}size) + {99 + percent}) div {100 + percent})"
    return F.expr(
        f"100 * {b}size >= {percent} * {a}size and least({a}size - {a}pos, {b}size - {b}pos) >= {need}"
    )


def _shared(entries: DataFrame, percent: int) -> DataFrame:
    """Entries whose shingle several groups have, with the indexed group before (``ahead``).

    Groups of a very frequent shingle are looked at slot by slot, so no task gets all of
    them: ``ahead`` is then the one before in the slot, and an entry alone in its slot stays.
    Both only tell the first round what to try; the second finds all links whatever they are.
    """
    order = Window.partitionBy("token", "slot").orderBy("size", "grp")
    entry = F.when(F.col("pos") < _index_column("size", percent), F.struct("grp", "size", "pos"))
    rows = entries.select(
        "*",
        F.last(entry, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("p"),
        F.lag("grp").over(order).alias("before"),
        F.lead("grp").over(order).alias("after"),
    )
    ahead = F.when(_fits("", "p.", percent), F.col("p.grp")).alias("ahead")
    return rows.where("before is not null or after is not null or slot > 0").select("token", "grp", "size", "pos", ahead)


def _linked(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (a, a_high, b, b_high) of sets that are similar enough.

    Sets are made again from the texts of the documents that pairs name. A table of
    bits of fixed size keeps most others from being hashed and sent.
    """
    spark = docs.sparkSession
    pairs = keep(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("doc"), F.col("a_high").alias("high")).unionAll(pairs.select("b", "b_high"))
    ends = ends.distinct()
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    words_of_bits = (
        ends.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc), 64) as int))").alias("bits"))
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .collect()
    )
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words_of_bits:
        table[row["at"]] = row["bits"]
    table = spark.sparkContext.broadcast(table)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at, bit = batch.column("at").to_numpy(), batch.column("bit").to_numpy()
            wanted = np.flatnonzero(table.value[at] >> bit & 1)
            docs, texts = batch.column("doc"), batch.column("text")
            for i in wanted.tolist():
                values = shingles(texts[i].as_py(), words)
                if len(values):
                    high = int(np.frombuffer(_set_hash(values)[:8], np.int64)[0])
                    out.append((docs[i].as_py(), high, values.tobytes()))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))],
                names=["doc", "high", "values"],
            )

    hashed = docs.where("doc is not null").select(
        "doc", "text", F.shiftright(bit, 6).alias("at"), F.expr("pmod(xxhash64(doc), 64)").alias("bit")
    )
    sets = hashed.mapInArrow(make, "doc long, high long, values binary")
    # Rows that repeat a document give its set once. Both joins read the same shuffle.
    sets = sets.repartition("doc", "high").groupBy("doc", "high").agg(F.first("values").alias("values"))
    both = pairs
    for side in "ab":
        own = sets.select(
            F.col("doc").alias(side), F.col("high").alias(f"{side}_high"), F.col("values").alias(f"{side}_values")
        )
        both = both.join(own, [side, f"{side}_high"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for a, b in zip(batch.column("a_values"), batch.column("b_values")):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                similar.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    links = both.select("a", "b", "a_values", "b_values").mapInArrow(compare, "a long, b long")
    links = keep(links, "links")
    forget(pairs)
    return links


def _promising(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """(x_grp, y_grp) of the pairs whose prefixes have enough shingles in common.

    Of the sets' shingles up to the end of the prefix that ends first, all common ones
    are seen; behind it there can be no more than that set has left.
    """
    left = F.expr(
        f"greatest(({percent} * x_size + 99) div 100, ({percent} * y_size + 99) div 100) - 1"
    )
    need = F.expr(f"({percent} * (x_size + y_size) + {99 + percent}) div {100 + percent}")
    x = shared.select(F.col("grp").alias("x_grp"), "token", F.col("size").alias("x_size"))
    y = shared.select(F.col("grp").alias("y_grp"), "token", F.col("size").alias("y_size"))
    common = pairs.join(x, "x_grp").join(y, ["y_grp", "token"]).groupBy("x_grp", "y_grp", "x_size", "y_size").count()
    return common.where(F.col("count") + left >= need).select("x_grp", "y_grp")


def similar_documents(
    df: DataFrame, id_column: str, text_column: str, words: int = 5, percent: int = 75
) -> DataFrame:
    """(doc, n_shingles, component_id) for each row: its id, the size of its set, its class."""
    spark = df.sparkSession
    docs = df.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))

    profiles = keep(_profiles(docs, words), "shingle-counts")
    buckets = profiles.where("bucket is not null").groupBy("bucket").agg(F.sum("count").alias("count"))
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    found = buckets.toArrow()  # at most 2^18 rows, whatever the input
    counts[found["bucket"].to_numpy()] = found["count"].to_numpy()
    slots = spark.sparkContext.broadcast(_slots(counts))
    counts = spark.sparkContext.broadcast(counts)

    prefixes = keep(_prefixes(docs, words, percent, counts), "prefixes")
    classes = prefixes.groupBy("high", "low").agg(
        F.min("doc").alias("cls"), F.first("grp").alias("grp"), F.first("size").alias("size")
    )
    classes = keep(classes, "classes")
    groups = classes.groupBy("grp").agg(F.min(F.struct("cls", "high")).alias("lead"))
    lead = groups.select("grp", F.col("lead.cls").alias("doc"), F.col("lead.high").alias("high"))
    chosen = (
        prefixes.select("doc", "high", "grp", "size", "prefix")
        .join(lead, ["doc", "high", "grp"], "left_semi")
        .dropDuplicates(["doc", "high", "grp"])
    )
    shared = keep(_shared(_entries(chosen.select("grp", "size", "prefix"), slots), percent), "entries")

    # First round: each group with the one before it and the most central one among
    # those it shares shingles with, and each set of a group with its first. Central is
    # a group that has few shingles to itself, as the origin of copies has.
    alone = shared.groupBy("grp").agg(F.count("*").alias("common"), F.first("size").alias("size"))
    alone = alone.select("grp", (_prefix_column("size", percent) - F.col("common")).alias("alone"))
    entry = F.when(F.col("pos") < _index_column("size", percent), F.struct("alone", "grp"))
    central = shared.join(alone, "grp").groupBy("token").agg(F.min(entry).alias("hub"))
    hubs = shared.join(central, "token").where("hub.grp <> grp").select("grp", F.col("hub.grp").alias("with"))
    ahead = shared.where("ahead is not null").select("grp", F.col("ahead").alias("with"))

    def most_shared(votes: DataFrame) -> DataFrame:
        counted = votes.groupBy("grp", "with").count()
        best = counted.groupBy("grp").agg(F.max_by("with", F.struct("count", "with")).alias("with"))
        return best.select(F.greatest("grp", "with").alias("x_grp"), F.least("grp", "with").alias("y_grp"))

    near = _promising(most_shared(hubs).unionAll(most_shared(ahead)).distinct(), shared, percent)
    first = lead.select("grp", F.col("doc").alias("a"), F.col("high").alias("a_high"))
    other = lead.select(F.col("grp").alias("y_grp"), F.col("doc").alias("b"), F.col("high").alias("b_high"))
    near = near.join(first.withColumnRenamed("grp", "x_grp"), "x_grp").join(other, "y_grp")
    near = near.select("a", "a_high", "b", "b_high")
    inside = classes.join(first, "grp").where("cls <> a or high <> a_high")
    inside = inside.select("a", "a_high", F.col("cls").alias("b"), F.col("high").alias("b_high"))
    links = _linked(docs, near.unionAll(inside), words, percent)
    united = keep(connected_components(links), "united")

    # Second round: what may connect two components.
    placed = classes.join(united, F.col("cls") == F.col("node"), "left").select(
        "grp", "cls", "high", F.coalesce("component", "cls").alias("comp")
    )
    placed = keep(placed, "placed")
    parts = placed.select("grp", "comp").distinct()
    entries = shared.select("token", "grp", "size", "pos").join(parts, "grp")
    by_comp = entries.groupBy("token", "comp").count()
    mixed = by_comp.groupBy("token").agg(
        F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps")
    )
    entries = keep(entries.join(mixed.where("comps > 1").select("token", "main"), "token"), "mixed")
    one = entries.where("comp <> main").select([F.col(c).alias(f"x_{c}") for c in entries.columns])
    two = entries.select([F.col(c).alias(f"y_{c}") for c in entries.columns])
    x_larger = F.expr("x_size > y_size or x_size = y_size and x_grp > y_grp")
    larger_x = x_larger & (F.col("y_pos") < _index_column("y_size", percent)) & _fits("x_", "y_", percent)
    larger_y = ~x_larger & (F.col("x_pos") < _index_column("x_size", percent)) & _fits("y_", "x_", percent)
    crossing = (
        one.join(
            two,
            (F.col("x_token") == F.col("y_token"))
            & F.expr("x_comp <> y_comp and (y_comp = y_main or x_comp < y_comp)")
            & F.expr(f"100 * least(x_size, y_size) >= {percent} * greatest(x_size, y_size)")
            & (larger_x | larger_y),
        )
        .select("x_grp", "x_comp", "y_grp", "y_comp")
        .distinct()
    )
    crossing = keep(crossing, "crossing")
    enough = _promising(crossing.select("x_grp", "y_grp").distinct(), shared, percent)
    crossing = crossing.join(enough, ["x_grp", "y_grp"]).select("x_grp", "x_comp", "y_grp", "y_comp")
    within = parts.select(F.col("grp").alias("x_grp"), F.col("comp").alias("x_comp")).join(
        parts.select(F.col("grp").alias("y_grp"), F.col("comp").alias("y_comp")),
        F.expr("x_grp = y_grp and x_comp < y_comp"),
    )
    crossing = crossing.unionAll(within.select("x_grp", "x_comp", "y_grp", "y_comp"))
    x = placed.select(
        F.col("grp").alias("x_grp"), F.col("comp").alias("x_comp"), F.col("cls").alias("a"), F.col("high").alias("a_high")
    )
    y = placed.select(
        F.col("grp").alias("y_grp"), F.col("comp").alias("y_comp"), F.col("cls").alias("b"), F.col("high").alias("b_high")
    )
    pairs = crossing.join(x, ["x_grp", "x_comp"]).join(y, ["y_grp", "y_comp"])
    more = _linked(docs, pairs.select("a", "a_high", "b", "b_high").distinct(), words, percent)

    # A document whose rows hold different sets connects their classes.
    member = prefixes.select("doc", "high", "low").join(classes.select("high", "low", "cls"), ["high", "low"])
    member = keep(member.select("doc", "cls").distinct(), "members")
    split = member.groupBy("doc").agg(F.min("cls").alias("b"), F.max("cls").alias("most")).where("b <> most")
    split = split.join(member, "doc").select(F.col("cls").alias("a"), "b")
    edges = united.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more).unionAll(split)
    components = connected_components(edges)
    component = F.min(F.coalesce("component", "cls")).alias("component")
    of_doc = member.join(components, F.col("cls") == F.col("node"), "left").groupBy("doc").agg(component)

    sizes = profiles.where("bucket is null").select("doc", F.col("size").alias("n_shingles"))
    return sizes.join(of_doc, "doc", "left").select(
        "doc", "n_shingles", F.coalesce("component", "doc").alias("component_id")
    )
