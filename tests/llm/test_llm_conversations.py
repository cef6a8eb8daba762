from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from basketry.llm import conversations, queries
from basketry.llm.common import prepare

TURNS = "conv_id long, turn long, role string, text string, row int, at string, conversation string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        said = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(said.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def cheapest(turns):
    """Least (cost, audit) and repaired turns by search over all edits; turns are (role, text, fault)."""
    open_, seen = [(0, "", 0, "", ())], set()
    while open_:
        cost, audit, at, state, done = heapq.heappop(open_)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(turns) and state in ("", "a"):
            return cost, audit, done
        nexts = [r for r in ("user", "assistant") if r[0] == ("a" if state == "u" else "u")]
        for r in nexts:
            heapq.heappush(open_, (cost + 5, audit + "I", at, r[0], (*done, (r, ""))))
        if at == len(turns):
            continue
        role, text, fault = turns[at]
        heapq.heappush(open_, (cost + 2, audit + "D", at + 1, state, done))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if (role[:1] == "s" and state == "") or role[:1] in [r[0] for r in nexts]:
            heapq.heappush(open_, (cost + more, audit + "K", at + 1, role[0], (*done, (role, text))))
        for r in nexts:
            heapq.heappush(open_, (cost + more + 1, audit + "R", at + 1, r[0], (*done, (r, text))))


def brute(rows):
    of = {}
    for conv, *_ in rows:
        of[conv] = []
    for conv, *turn in damaged(rows):
        of[conv].append(turn)
    for conv, turns in of.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).hexdigest()))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        seen, marked = set(), []
        for _, role, text in turns:
            end = text.strip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
            marked.append((role, text, fault))
            seen.add((role, text))
        faults = [f for _, _, f in marked]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, done = cheapest(marked)
        said = "\n".join(f"{r}:{t}" for r, t in done)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        yield (conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(said.encode()).hexdigest())


def frame(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], TURNS).repartition(3)


def got(df, **options):
    names = ("conv_id", "turn", "role", "text")
    turns = conversations.damage(df, *names)
    done = conversations.repair(turns, "conversation", "turn", "role", "text", **options)
    return sorted(map(tuple, done.summary.collect()), key=str), done


def with_turns(rows):
    """Conversations of which a turn is left after damage."""
    left = {conv for conv, *_ in damaged(rows)}
    return sorted((r for r in brute(rows) if r[0] in left), key=str)


def made(count, seed, turns=9):
    chance = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "sys"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "End. \t", "other words."]
    return [
        (conv, chance.choice([turn, turn, turn + 1, None]), chance.choice(roles), chance.choice(texts) if chance.random() < 0.6 else f"{conv} {turn}.")
        for conv in range(count) for turn in range(chance.randint(1, turns))
    ]


@pytest.mark.parametrize("options", [{}, {"block_rows": 1}, {"block_rows": 3}, {"block_bytes": 8}])
def test_equals_search_over_all_edits(spark, options):
    rows = made(150, 5)
    assert got(frame(spark, rows), **options)[0] == with_turns(rows)


def test_division_takes_the_least_audit():
    chance = random.Random(2)
    for size in [*range(12)] * 30:
        turns = [(chance.choice("suax"), "t", chance.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(size)]
        elements = [conversations.TURNS[r if r in "sua" else "", f] for r, _, f in turns]
        end = conversations.last_state(elements)
        states = conversations.crossings(elements, 0, end)
        steps = [next(w for w in e[a] if w[0] == b) for e, a, b in zip(elements, states, states[1:])]
        audit = "".join(s[2] for s in steps) + conversations.TAIL[end]
        cost = sum(s[1] for s in steps) + 5 * len(conversations.TAIL[end])
        assert (cost, audit) == cheapest(turns)[:2]


def test_one_conversation_with_most_rows_is_spread(spark):
    chance = random.Random(4)
    rows = [(7, i, chance.choice(["user", "assistant"]), chance.choice(["Hello.", f"{i}.", "cut"])) for i in range(3000)]
    rows += made(40, 6)
    found, done = got(frame(spark, rows), block_rows=64)
    assert found == with_turns(rows)
    long = done.rows.where("conversation = 7")
    assert long.select("block").distinct().count() > 40
    turns = long.orderBy("block", "place").collect()
    said = "\n".join(f"{r.role}:{r.text}" for r in turns)
    assert [hashlib.sha256(said.encode()).hexdigest()] == [r[-1] for r in found if r[0] == 7]


def test_awkward_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, None, "user", "a."),
        (2, 5, "assistant", "x" * 300_000), (2, 9, "user", "y" * 300_000 + "." + " " * 300_000), (3, 1, "", "empty role."),
        (4, 2, "user", "same."), (4, 2, "user", "same."), (4, 2, "user", "same."), (4, 2, "assistant", "é\x00\x85."),
    ]
    rows += [(10 + i, 0, "system", "Only system.") for i in range(40)]
    assert got(frame(spark, rows))[0] == with_turns(rows)
    assert got(frame(spark, rows).where("false"))[0] == []


def test_query_returns_every_conversation(spark, tmp_path):
    rows = made(60, 8) + [(1000 + i, 0, "user", "alone.") for i in range(60)]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    want = sorted(brute(rows), key=str)
    assert any(r[-1] == EMPTY and r[7] == "" for r in want)
    assert sorted(map(tuple, queries.op13_conversations(spark, str(tmp_path)).collect()), key=str) == want


def test_query_on_the_sample(spark, sample_dir):
    rows = spark.read.parquet(f"{sample_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = sorted(map(tuple, queries.op13_conversations(spark, sample_dir).collect()))
    assert found == sorted(brute([tuple(r) for r in rows]))
