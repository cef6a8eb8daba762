"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation has role initials ``(s?(ua)+)?``: maybe a system turn, then user
and assistant in turn. The cheapest edits are found over four states: nothing said yet,
after the system turn, after a user turn, after an assistant turn. Each turn of the input
is an element that leads from state to state at some cost (kept, given another role or
deleted, after none, one or two inserted turns).

Edits are recovered in linear space: the costs of reaching each state at the middle (four
numbers, from the front) and of ending from there (four, from the back) meet, the state of
least total cost is crossed, and both halves are solved alike. Among states of equal cost
the one whose audit is ASCII-least is taken; the forward vector carries that order as a
rank. Two audits that consume the same turns are never each other's beginning, as both
end in the letter of the last turn, so ranks decide whatever follows.

A conversation is cut into blocks of at most ``block_rows`` turns and ``block_bytes`` of
text, wherever its turns lie; a block is itself an element with costs and ranks from state
to state. The same division over a conversation's blocks (one short row for each) tells
where each block starts and ends, then blocks are solved in parallel. A conversation with
a third of all turns is thus spread like all others. Only its digest, which SHA-256 allows
in order alone, and its audit, which is one value, are put together by one task that
streams its blocks.

Null roles and texts count as one space. A role that begins with none of s, u, a cannot
be kept, an empty one included. Turns of equal number are ordered by role and a digest of
the text; equal rows stand together, so all but the first are duplicates. A null turn comes
first. A null conversation id is a conversation of its own. Extra columns, whatever their
names, are left out. Texts are handled whole, whatever their length. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from basketry.llm.common import keep

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SPACES = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 60

#: An element: for each state the (state, cost, tag) it can lead to, one for each state;
#: tags order the audits of one state.
Element = list[list[tuple[int, int, object]]]


def _next(state: int) -> int:
    """The state after a user or assistant turn, of which one only is allowed."""
    return ASSISTANT if state == USER else USER


def _turn(initial: str, fault: str) -> Element:
    """What can be done with a turn; tags are audits."""
    element: Element = []
    extra = TRUNCATED if fault == "truncated" else 0
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        at = state
        for inserted in range(3):
            options = [(at, DELETE, "D")]
            if fault not in ("blank", "duplicate"):
                options.append((_next(at), REROLE + extra, "R"))
                if initial == "s" and at == START:
                    options.append((SYSTEM, KEEP + extra, "K"))
                if initial == {USER: "u", ASSISTANT: "a"}[_next(at)]:
                    options.append((_next(at), KEEP + extra, "K"))
            for to, cost, letter in options:
                option = (INSERT * inserted + cost, "I" * inserted + letter)
                best[to] = min(option, best.get(to, option))
            at = _next(at)
        element.append([(to, cost, audit) for to, (cost, audit) in sorted(best.items())])
    return element


TURNS = {(i, f): _turn(i, f) for i in ("s", "u", "a", "") for f in FAULTS}
#: Turns to be inserted at the end of a conversation.
TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _forward(elements: list[Element], lo: int, hi: int, start: int) -> tuple[list[int], list[int]]:
    """Cost of reaching each state from ``start``, and the order of the audits that do."""
    costs, ranks = [_NEVER] * 4, [0] * 4
    costs[start] = 0
    for i in range(lo, hi):
        best: list[tuple | None] = [None] * 4
        for state, ways in enumerate(elements[i]):
            cost = costs[state]
            if cost < _NEVER:
                rank = ranks[state]
                for to, more, tag in ways:
                    option = (cost + more, rank, tag)
                    if best[to] is None or option < best[to]:
                        best[to] = option
        order = sorted((b[1], b[2], to) for to, b in enumerate(best) if b)
        costs = [b[0] if b else _NEVER for b in best]
        for rank, (_, _, to) in enumerate(order):
            ranks[to] = rank
    return costs, ranks


def _backward(elements: list[Element], lo: int, hi: int, end: int) -> list[int]:
    """Cost of reaching ``end`` from each state."""
    costs = [_NEVER] * 4
    costs[end] = 0
    for i in range(hi - 1, lo - 1, -1):
        costs = [min([_NEVER, *(more + costs[to] for to, more, _ in ways)]) for ways in elements[i]]
    return costs


def crossings(elements: list[Element], start: int, end: int) -> list[int]:
    """The states before the first and after each element on the audit-least cheapest way."""
    states = [start] * len(elements) + [end]
    parts = [(0, len(elements), start, end)]
    while parts:
        lo, hi, enter, leave = parts.pop()
        if hi - lo < 2:
            continue
        middle = (lo + hi) // 2
        costs, ranks = _forward(elements, lo, middle, enter)
        rest = _backward(elements, middle, hi, leave)
        state = min(STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
        states[middle] = state
        parts += [(lo, middle, enter, state), (middle, hi, state, leave)]
    return states


def last_state(elements: list[Element]) -> int:
    """The state in which the cheapest way ends, before turns are inserted at the end."""
    costs, ranks = _forward(elements, 0, len(elements), START)
    return min(STATES, key=lambda s: (costs[s] + INSERT * len(TAIL[s]), ranks[s]))


def _block(roles: list[str], faults: list[int]) -> list[Element]:
    return [TURNS[r[:1] if r[:1] in ("s", "u", "a") else "", FAULTS[f]] for r, f in zip(roles, faults)]


def _whole(elements: list[Element]) -> tuple[list[int], list[int]]:
    """Costs and ranks from each state to each, row by row."""
    ways = [_forward(elements, 0, len(elements), start) for start in STATES]
    return [c for costs, _ in ways for c in costs], [r for _, ranks in ways for r in ranks]


def _as_element(costs: list[int], ranks: list[int]) -> Element:
    return [
        [(to, costs[4 * s + to], ranks[4 * s + to]) for to in STATES if costs[4 * s + to] < _NEVER] for s in STATES
    ]


def _edit(block: dict, enter: int, leave: int, tail: str) -> tuple[int, str, list[str], list[str]]:
    """Cost, audit and the repaired turns of a block."""
    elements = _block(block["roles"], block["faults"])
    states = crossings(elements, enter, leave)
    total, audit, roles, texts = 0, [], [], []

    def insert(state: int, letters: str) -> int:
        for _ in letters:
            state = _next(state)
            roles.append(ROLES[state])
            texts.append("")
        return state

    for i, element in enumerate(elements):
        _, cost, done = next(way for way in element[states[i]] if way[0] == states[i + 1])
        total += cost
        audit.append(done)
        state = insert(states[i], done[:-1])
        if done[-1] != "D":
            roles.append(block["roles"][i] if done[-1] == "K" else ROLES[_next(state)])
            texts.append(block["texts"][i])
    insert(leave, tail)
    return total + INSERT * len(tail), "".join(audit) + tail, roles, texts


def _illegal(roles: list[str]) -> int:
    return sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))


def damage(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows (conversation, turn, role, text) with faults that a hash of id and turn deals out."""

    def said(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", said(conversation), said(turn)).cast("binary")) % 20
    rows = df.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).cast("long").alias("turn"),
        said(role).alias("role"),
        said(text).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conversation", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


class Repair:
    """Repaired conversations.

    ``rows``: (conversation, block, place, role, text), in order of block and place within
    a conversation. ``summary``: a row for each conversation with counts of faults, cost,
    audit and the digest of the repaired turns.
    """

    def __init__(self, rows: DataFrame, summary: DataFrame):
        self.rows, self.summary = rows, summary


def repair(
    df: DataFrame,
    conversation: str,
    turn: str,
    role: str,
    text: str,
    block_rows: int = 4096,
    block_bytes: int = 4 * 1024**2,
) -> Repair:
    """Repair all conversations of a table of turns.

    Delete costs 2, another role 1, an inserted turn 5, a truncated turn that stays 5.
    Blank and repeated turns are deleted.
    """
    given = df.select(
        F.col(conversation).alias("conversation"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("digest", F.sha2("text", 256))
    key = given.schema["conversation"].dataType
    # By more than the conversation, so that a long one lies in many partitions.
    order = ["conversation", "turn", "role", "digest", "row"]
    ordered = given.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = keep(ordered.drop("row").withColumn("at", F.monotonically_increasing_id()), "turns")
    firsts = ordered.groupBy("conversation", "role", "digest").agg(F.min("at").alias("at"))
    # ``at`` is unique on both sides.
    marked = ordered.drop("digest").join(firsts.select("at", F.lit(True).alias("first")), "at", "left")
    marked = marked.repartitionByRange("at").sortWithinPartitions("at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                names = ("conversation", "at", "role", "text", "first")
                yield from zip(*(batch.column(n).to_pylist() for n in names))

        def block(inside: list[tuple]) -> dict:
            conversation, at, _, _, _ = inside[0]
            roles, texts, firsts = [list(c) for c in list(zip(*inside))[2:]]
            faults = []
            for said, first in zip(texts, firsts):
                end = said.rstrip(SPACES)[-1:]
                faults.append(1 if not end else 2 if not first else 3 if end not in ".!?" else 0)
            costs, ranks = _whole(_block(roles, faults))
            return {
                "conversation": conversation, "at": at, "roles": roles, "texts": texts, "faults": faults,
                "costs": costs, "ranks": ranks,
            }

        for _, turns in groupby(rows(), key=lambda r: (r[0] is None, r[0])):
            inside, size = [], 0
            for each in turns:
                if inside and (len(inside) == block_rows or size + len(each[3]) > block_bytes):
                    yield _batch([block(inside)], block_kind)
                    inside, size = [], 0
                inside.append(each)
                size += len(each[3])
            yield _batch([block(inside)], block_kind)

    block_type = StructType([StructField("conversation", key)]).simpleString()[7:-1] + (
        ", at: bigint, roles: array<string>, texts: array<string>, faults: array<int>,"
        " costs: array<bigint>, ranks: array<int>"
    )
    block_kind = _arrow(block_type)
    blocks = keep(marked.mapInArrow(cut, _ddl(block_type)), "blocks")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                names = ("conversation", "at", "costs", "ranks")
                yield from zip(*(batch.column(n).to_pylist() for n in names))

        for _, inside in groupby(rows(), key=lambda r: (r[0] is None, r[0])):
            inside = [(at, _as_element(costs, ranks)) for _, at, costs, ranks in inside]
            elements = [e for _, e in inside]
            end = last_state(elements)
            states = crossings(elements, START, end)
            tails = [""] * (len(inside) - 1) + [TAIL[end]]
            found = zip((at for at, _ in inside), states, states[1:], tails)
            yield _batch([dict(zip(("at", "enter", "leave", "tail"), f)) for f in found], way_kind)

    way_type = "at: bigint, enter: int, leave: int, tail: string"
    way_kind = _arrow(way_type)
    ways = (
        blocks.select("conversation", "at", "costs", "ranks")
        .repartition("conversation")
        .sortWithinPartitions("conversation", "at")
        .mapInArrow(cross, _ddl(way_type))
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                cost, audit, roles, texts = _edit(b, b["enter"], b["leave"], b["tail"])
                counts = {name: b["faults"].count(i) for i, name in enumerate(FAULTS) if name}
                yield _batch(
                    [{
                        "conversation": b["conversation"], "at": b["at"], "opening": b["roles"][0][:1],
                        "closing": b["roles"][-1][:1], **counts, "illegal": _illegal(b["roles"]),
                        "cost": cost, "audit": audit, "roles": roles, "texts": texts,
                    }],
                    solved_kind,
                )

    key_type = block_type.split(",")[0]
    numbers = "blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, cost: bigint, audit: string"
    solved_type = (
        f"{key_type}, at: bigint, opening: string, closing: string, {numbers},"
        " roles: array<string>, texts: array<string>"
    )
    solved_kind = _arrow(solved_type)
    solved = keep(
        blocks.drop("costs", "ranks").join(ways, "at").mapInArrow(solve, _ddl(solved_type)), "blocks-repaired"
    )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):  # one block at a time
                    yield batch.slice(i, 1).to_pylist()[0]

        for _, inside in groupby(rows(), key=lambda b: (b["conversation"] is None, b["conversation"])):
            digest, audit, before, begun = hashlib.sha256(), [], None, False
            total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
            for b in inside:
                for name in total:
                    total[name] += b[name]
                if before is not None:
                    total["illegal"] += before + b["opening"] not in ("su", "ua", "au")
                before = b["closing"]
                audit.append(b["audit"])
                for said in map(":".join, zip(b["roles"], b["texts"])):
                    digest.update((("\n" if begun else "") + said).encode())
                    begun = True
            done = {"conversation": b["conversation"], **total, "audit": "".join(audit), "digest": digest.hexdigest()}
            yield _batch([done], total_kind)

    total_type = f"{key_type}, {numbers}, digest: string"
    total_kind = _arrow(total_type)
    totals = (
        solved.repartition("conversation")
        .sortWithinPartitions("conversation", "at")
        .mapInArrow(add_up, _ddl(total_type))
    )
    turns = ordered.groupBy("conversation", "turn").agg(F.lit(1).alias("one"))
    turns = turns.groupBy(F.col("conversation").alias("of")).agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")
    )
    summary = totals.join(turns, F.col("conversation").eqNullSafe(F.col("of")), "left").select(
        "conversation",
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "digest",
    )
    rows = solved.select(
        "conversation", F.col("at").alias("block"), F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "turn")
    ).select("conversation", "block", "place", F.col("turn.roles").alias("role"), F.col("turn.texts").alias("text"))
    return Repair(rows, summary)


def _ddl(fields: str) -> str:
    return fields.replace(": ", " ")


def _arrow(fields: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(_ddl(fields)))


def _batch(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, kind)
