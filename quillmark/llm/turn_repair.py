"""Conversation structure repair: the cheapest edits to a legal order of roles, found in layers of increasing cost.

A layer holds, for each turn, the set of grammar states (four bits) from which the rest of the
conversation can be made legal at this cost; layers are made from the ones 0, 3, 4 and 6 below.
The first layer that holds the begin state gives the cost, and a walk through the layers' bits the
edits. Long conversations are cut in pieces: each piece's costs between states are found by
itself, a pass over these small tables says what is left to pay behind each piece, and the
pieces' edits are found in parallel again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import stored

#: Turns of a piece, and characters of their texts at about which it ends.
PIECE = 128
CHARS = 1 << 20
#: What it costs to change a role, to delete and insert a turn, and to keep a truncated one.
RERUN, DELETE, INSERT, CUT = 3, 4, 3, 3
#: More than anything costs.
NEVER = 1 << 60
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A conversation may end in 0 and 3.
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}  # by an inserted turn or one of a new role
ENDS = 0b1001
NAMES = {2: "user", 3: "assistant"}


def _before(step: dict[int, int]) -> list[int]:
    """For each set of states, the set of those from which one step leads into it."""
    return [sum(1 << s for s, t in step.items() if mask >> t & 1) for mask in range(16)]


KEEP = {initial: _before(step) for initial, step in STEP.items()}
NONE = [0] * 16
ANY = _before(NEXT)
GOOD = {"su", "ua", "au"}
FINE, TRUNCATED, BLANK = 0, 1, 2


class Layers:
    """Sets of states before each live turn, and after the last one, by what the rest may cost at most."""

    def __init__(self, turns: list[tuple[str, bool]], ends: list[int]):
        """turns: initial of the role, and whether the text is truncated. ends: what is left to pay behind the turns, for each state."""
        self.turns, self.ends, self.table = turns, ends, []

    def grow(self) -> list[int]:
        """The next layer."""
        table, m = self.table, len(self.turns)
        cost = len(table)
        empty = [0] * (m + 1)
        one, four, six, last = (table[cost - k] if cost >= k else empty for k in (INSERT, DELETE, RERUN + CUT, 1))
        now = sum(1 << s for s, left in enumerate(self.ends) if left <= cost) | ANY[one[m]]
        layer = [0] * m + [now]
        for i in range(m - 1, -1, -1):
            initial, truncated = self.turns[i]
            keep = KEEP.get(initial, NONE)
            if truncated:
                now = keep[one[i + 1]] | ANY[six[i + 1]]
            else:
                now = keep[now] | ANY[one[i + 1]]
            now |= four[i + 1] | ANY[one[i]] | last[i]
            layer[i] = now
        table.append(layer)
        return layer

    def costs(self, states: Iterable[int]) -> list[int]:
        """What the whole costs from each of the states; layers grow until they hold them all."""
        out = []
        for s in states:
            c = 0
            while not (self.table[c] if c < len(self.table) else self.grow())[0] >> s & 1:
                c += 1
            out.append(c)
        return out

    def walk(self, state: int, cost: int) -> tuple[list[str], int]:
        """The least edits in ASCII order at this cost: those before and at each turn, then those behind the last; and the state reached."""
        out, here, i, m = [], "", 0, len(self.turns)

        def holds(c: int, i: int, s: int) -> int:
            return c >= 0 and self.table[c][i] >> s & 1

        while i < m or cost < self.ends[state]:
            other = NEXT[state]
            if i < m and holds(cost - DELETE, i + 1, state):
                edit, cost = "D", cost - DELETE
            elif holds(cost - INSERT, i, other) or i == m:
                here, cost, state = here + "I", cost - INSERT, other
                continue
            else:
                initial, truncated = self.turns[i]
                kept, more = STEP.get(initial, {}).get(state), CUT * truncated
                if kept is not None and holds(cost - more, i + 1, kept):
                    edit, cost, state = "K", cost - more, kept
                else:
                    edit, cost, state = "R", cost - more - RERUN, other
            out.append(here + edit)
            here, i = "", i + 1
        return [*out, here], state


Row = tuple[str, str, int, int, bool]  # role, text, copies, fault, whether it is the first of its role and text


def live(rows: list[Row]) -> tuple[list[tuple[str, bool]], list[int]]:
    """The turns that may stay, and how many rows must go before each of them and behind the last."""
    turns, gaps = [], [0]
    for role, _, copies, fault, first in rows:
        if fault != BLANK and first:
            turns.append((role[:1], fault == TRUNCATED))
            gaps.append(copies - 1)
        else:
            gaps[-1] += copies
    return turns, gaps


def edits(rows: list[Row], ends: list[int], states: list[int]) -> tuple[list[str], list[int]]:
    """From each of the states: the edits' letters of all rows, and the state reached."""
    turns, gaps = live(rows)
    layers = Layers(turns, ends)
    letters, reached = [], []
    for s, cost in zip(states, layers.costs(states), strict=True):
        own, end = layers.walk(s, cost)
        letters.append("".join("D" * gap + x for gap, x in zip(gaps, own, strict=True)))
        reached.append(end)
    return letters, reached


def between(rows: list[Row]) -> list[int]:
    """The least cost from each state to each state over the rows, 16 numbers."""
    turns, gaps = live(rows)
    out = [[NEVER] * 4 for _ in range(4)]
    for end in (2, 3):
        for s, cost in enumerate(Layers(turns, [0 if t == end else NEVER for t in range(4)]).costs(range(4))):
            out[s][end] = cost
    out[0][0] = out[1][1] = DELETE * len(turns)  # nothing comes back to these two: all turns go, or all but a kept system turn
    if kept := [CUT * truncated for initial, truncated in turns if initial == "s"]:
        out[0][1] = DELETE * (len(turns) - 1) + min(kept)
    return [min(NEVER, c + DELETE * sum(gaps)) for row in out for c in row]


class Repaired:
    """One conversation's results, piece by piece."""

    def __init__(self):
        self.state, self.audit, self.digest, self.cost, self.illegal, self.last = 0, [], hashlib.sha256(), 0, 0, None
        self.blank = self.duplicate = self.truncated = self.lines = 0

    def say(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1

    def insert(self) -> None:
        self.state, self.cost = NEXT[self.state], self.cost + INSERT
        self.say(NAMES[self.state], "")

    def take(self, rows: list[Row], letters: str) -> None:
        at = 0
        for role, text, copies, fault, first in rows:
            initial = role[:1]
            self.illegal += (self.last is not None and self.last + initial not in GOOD) + copies - 1  # equal rows follow each other
            self.last = initial
            stays = fault != BLANK and first
            self.blank += copies * (fault == BLANK)
            self.duplicate += (copies - first) * (fault != BLANK)
            self.truncated += stays and fault == TRUNCATED
            while stays:
                letter, at = letters[at], at + 1
                if letter == "I":
                    self.insert()
                    continue
                if letter == "D":
                    self.cost += DELETE
                else:
                    self.state = STEP[initial][self.state] if letter == "K" else NEXT[self.state]
                    self.cost += RERUN * (letter == "R") + CUT * (fault == TRUNCATED)
                    self.say(role if letter == "K" else NAMES[self.state], text)
                break
            gone = copies - stays
            self.cost += DELETE * gone
            at += gone
        for _ in letters[at:]:
            self.insert()
        self.audit.append(letters)

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


RESULT = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PIECES = "conv_id long, part int, seq long, costs array<long>, roles array<string>, texts array<string>, copies array<long>, faults array<int>, firsts array<boolean>"


def _types(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = _types(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.types, strict=True)], schema=types)


def _batched(rows: Iterator[tuple], schema: str, most: int = 64) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, PIECE):
            yield from zip(*(c.to_pylist() for c in b.slice(at, PIECE).columns), strict=True)


BOTH = RESULT + ", " + PIECES[len("conv_id long, ") :]


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of a partition as results of whole conversations, and as pieces of those that are long or may go on in other partitions."""
    part = TaskContext.get().partitionId()

    def found() -> Iterator[tuple]:
        rows: list[Row] = []
        conv, chars, seq, begun, opening = None, 0, 0, False, True

        def piece() -> tuple:
            return (conv, *[None] * 7, part, seq, between(rows), *map(list, zip(*rows, strict=True)))

        for own, *row in _rows(batches):
            if begun and (own != conv or len(rows) == PIECE or chars >= CHARS):
                # a conversation that ends inside the partition, with all its rows here, is whole
                if own != conv and not opening:
                    done = Repaired()
                    done.take(rows, edits(rows, [0, NEVER, NEVER, 0], [0])[0][0])
                    yield (*done.row(conv), *[None] * 8)
                else:
                    yield piece()
                    seq += 1
                opening = own == conv
                rows, chars = [], 0
            conv, begun = own, True
            rows.append(tuple(row))
            chars += len(row[1])
        if rows:
            yield piece()

    yield from _batched(found(), BOTH)


def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left to pay behind each piece, by state, less the least; pieces of a conversation come last to first."""

    def found() -> Iterator[tuple]:
        conv, left, begun = None, [], False
        for own, part, seq, costs in _rows(batches):
            if not begun or own != conv:
                conv, left, begun = own, [0, NEVER, NEVER, 0], True
            yield part, seq, left
            now = [min(NEVER, *(costs[4 * s + t] + left[t] for t in range(4))) for s in range(4)]
            least = min(now)
            left = [min(NEVER, c - least) for c in now]

    yield from _batched(found(), "part int, seq long, left array<long>", 1024)


OPTIONS = PIECES + ", letters array<string>"


def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece with its edits from every state that it may be entered in."""

    def found() -> Iterator[tuple]:
        for *piece, left in _rows(batches):
            rows = list(zip(*piece[4:], strict=True))
            yield (*piece, edits(rows, left, [0, 1, 2, 3])[0])

    yield from _batched(found(), OPTIONS)


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose pieces come first to last; of each only its running digest and its edits are held."""

    def found() -> Iterator[tuple]:
        conv, done = None, None
        for own, _, _, _, *lists, letters in _rows(batches):
            if done is None or own != conv:
                if done is not None:
                    yield done.row(conv)
                conv, done = own, Repaired()
            done.take(list(zip(*lists, strict=True)), letters[done.state])
        if done is not None:
            yield done.row(conv)

    yield from _batched(found(), RESULT)


def collapsed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies, fault, first): equal rows of a turn as one; column copies says how often each row stands."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = turns.where("copies > 0").groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("fault", F.when(blank, BLANK).when(whole, FINE).otherwise(TRUNCATED)).withColumn("key", F.md5(F.col("text").cast("binary")))
    rows, _ = stored(rows)
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = rows.groupBy(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("key").alias("__k")).agg(F.min(when).alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    same = rows["conv_id"].eqNullSafe(again["__c"]) & (rows["role"] == again["__r"]) & (rows["key"] == again["__k"])
    first = F.col("__n").isNull() | when.eqNullSafe(F.col("__least"))
    return rows.join(again, same, "left").select("conv_id", "turn", "role", "text", "copies", "fault", first.alias("first"))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of turns (conv_id, turn, role, text, copies).

    Rows of a conversation are taken by turn (nulls first), role and text; a row stands `copies`
    times, and one of 0 copies only names its conversation. A null role or text is one space, null
    conv_id is a conversation, and equal rows are repeated ones. Blank rows and later ones of the
    same role and text must go (cost 4); any other may go too, be kept where its role's first
    letter fits (0) or become user or assistant (3); empty turns may be put anywhere (3); a kept
    truncated one costs 3 more. gaps is null where no long holds it. Other columns are ignored.
    """
    text = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text, F.col("copies").cast("long").alias("copies"))
    each = rows.groupBy("conv_id", "turn").agg(F.max(F.col("copies") > 0).alias("there"))
    known = F.when(F.col("there"), F.col("turn"))
    wide = lambda c: c.cast("decimal(20,0)")
    spans = each.groupBy("conv_id").agg((wide(F.max(known)) - wide(F.min(known)) + 1 - F.count(known)).alias("gaps"), F.count(known).alias("known"))
    gaps = F.when(F.col("known") == 0, F.lit(0).cast("long")).otherwise(F.col("gaps").try_cast("long"))
    ordered = collapsed(rows).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    table, _ = stored(ordered.select("conv_id", "role", "text", "copies", "fault", "first").mapInArrow(cut, BOTH))
    pieces = table.where("part is not null").select(*[f.split(" ")[0] for f in PIECES.split(", ")])
    small = pieces.select("conv_id", "part", "seq", "costs").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    left = small.mapInArrow(behind, "part int, seq long, left array<long>")
    ways = pieces.join(left, ["part", "seq"]).select(*pieces.columns, "left").mapInArrow(options, OPTIONS)
    long = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(joined, RESULT)
    results = table.where("part is null").select(*long.columns).unionByName(long).withColumnRenamed("conv_id", "__conv")
    all_ids = spans.select("conv_id", gaps.alias("gaps"))
    out = all_ids.join(results, all_ids["conv_id"].eqNullSafe(results["__conv"]), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", "gaps", *map(count, ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in, by a checksum of conv_id and turn; copies says how often a row stands afterwards."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text: Column = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    return conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
