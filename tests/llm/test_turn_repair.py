"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from quillmark.llm import turn_repair
from quillmark.llm.queries import QUERIES
from tests.oracle import DATA

SCHEMA = "conv_id long, turn long, role string, text string, cost int, `left` string, part string"


def damage(rows):
    """Each conversation's rows after damage, in order; rows are (conv_id, turn, role, text)."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        some = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{some(conv)}:{some(turn)}".encode()) % 20
        role, text = some(role), some(text)
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def brute(conv, rows):
    """One result row, by the least (cost, edits) of every rest from every state."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = re.sub("[\x20\x09-\x0d]", "", text)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    def step(state, x):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, x))

    best = [{} for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        now = dict.fromkeys(["", "a"], (0, "", ())) if i == len(rows) else {}
        if i < len(rows):
            _, role, text = rows[i]
            for s in ("", "s", "u", "a"):
                ways = []
                c, a, t = best[i + 1][s]
                ways.append((c + 4, "D" + a, t))
                if faults[i] not in ("b", "d"):
                    more = 3 * (faults[i] == "t")
                    for x, name, cost, letter in ((role[:1], role, 0, "K"), ("u", "user", 3, "R"), ("a", "assistant", 3, "R")):
                        if (to := step(s, x)) and to in best[i + 1]:
                            c, a, t = best[i + 1][to]
                            ways.append((c + cost + more, letter + a, ((name, text), t)))
                now[s] = min(ways, key=lambda w: w[:2])
        for _ in range(4):  # inserts before this row
            for s in ("", "s", "u", "a"):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if (to := step(s, x)) and to in now:
                        c, a, t = now[to]
                        now[s] = min(now.get(s, (1 << 60, "")), (c + 3, "I" + a, ((name, ""), t)), key=lambda w: w[:2])
        best[i] = now
    cost, audit, chain = best[0][""]
    lines = []
    while chain:
        (role, text), chain = chain
        lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def compare(found, rows):
    want = {c: brute(c, v) for c, v in damage(rows).items()}
    got = {r.conv_id: r.asDict() for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    for c, w in want.items():
        assert got[c] == w, c


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(QUERIES["op12_turn_repair"](spark, DATA).collect(), rows)


def made(rng, conv, n):
    texts = ["Yes.", "No", "Why?", " \t", "", "a. ", "Ends ok!", "…", None, "Yes.\v"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    return [(conv, rng.choice([None, *range(n)]) if rng.random() < 0.3 else t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.7 else f"Number {t}{rng.choice('.!? ')}") for t in range(n)]


def test_odd_conversations_ties_and_repeated_rows(spark):
    rng = random.Random(1)
    rows = [r for c in [None, *range(150)] for r in made(rng, c, rng.randrange(1, 12))]
    rows += rows[:200]  # repeated rows
    rows += [(1000, 0, "user", "x" * 1_300_000 + "."), (1000, 1, "assistant", "y " * 600_000)]
    rows += [(2000, -(1 << 60), "user", "a."), (2000, 1 << 60, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    compare(turn_repair.repair(turn_repair.damaged(df)).collect(), rows)


def test_conversation_of_many_pieces_that_holds_most_rows(spark):
    rng = random.Random(2)
    rows = made(rng, 7, 3000) + [r for c in range(20, 40) for r in made(rng, c, 9)] + [(8, t, "system", f"S{t}.") for t in range(500)] + [(9, t, "user", "same.") for t in range(700)] + [(10, 3, "user", "again.")] * 600
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    compare(turn_repair.repair(turn_repair.damaged(df)).collect(), rows)


def test_gaps_beyond_a_long_are_null(spark):
    rows = [(1, -(1 << 63), "user", "a."), (1, (1 << 63) - 1, "assistant", "b.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    assert [(r.gaps, r.audit) for r in turn_repair.repair(df).collect()] == [(None, "KK")]


def test_empty_table_and_conversations_without_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(turn_repair.damaged(empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "x", "y")], SCHEMA)
    (row,) = turn_repair.repair(turn_repair.damaged(df)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("seed", range(40))
def test_pieces_of_any_size_give_what_the_whole_gives(seed):
    rng = random.Random(seed)
    turns = [(rng.choice("suaaux"), rng.random() < 0.3) for _ in range(rng.randrange(1, 40))]
    rows = [(x, f"{i}{'' if cut else '.'}", rng.randrange(1, 4), turn_repair.TRUNCATED if cut else turn_repair.FINE, rng.random() < 0.9) for i, (x, cut) in enumerate(turns)]
    ends = [0, turn_repair.NEVER, turn_repair.NEVER, 0]
    whole = turn_repair.Repaired()
    whole.take(rows, turn_repair.edits(rows, ends, [0])[0][0])
    cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(5))})
    pieces = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    left = [ends]
    for p in reversed(pieces):
        costs = turn_repair.between(p)
        now = [min(turn_repair.NEVER, *(costs[4 * s + t] + left[-1][t] for t in range(4))) for s in range(4)]
        left.append([c - min(now) for c in now])
    parts = turn_repair.Repaired()
    for p, end in zip(pieces, reversed(left[:-1]), strict=True):
        parts.take(p, turn_repair.edits(p, end, [0, 1, 2, 3])[0][parts.state])
    assert parts.row(1) == whole.row(1)


