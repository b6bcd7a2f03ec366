"""Mixing sources to target weights: Pfair release times and deadlines, served earliest deadline first."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import stored, with_position

#: Rows of a source that are scheduled together.
BLOCK = 16
#: Slots of the schedule that are built at a time.
PERIOD = 2048
#: Binary digits of times after the point, and how many of them tell a time from a whole slot.
DIGITS, TELLING = 96, 48
#: With so many sources at most, their names and their cells' counts are sent to every task; beyond, Spark joins them as it sees fit.
SOURCES = 256
#: Default weights are row counts to this power.
TEMPERATURE = 0.5
CELLS = 1024


def shares(weights: dict[int, float], period: int = PERIOD) -> dict[int, int]:
    """Whole slots of a period, for a schedule that has to repeat; mix() goes by exact weights. In proportion to its weight by largest remainder, one at least; they add up to period."""
    total = sum(weights.values())
    exact = {i: w / total * (period - len(weights)) for i, w in weights.items()}
    out = {i: 1 + int(x) for i, x in exact.items()}
    for i in sorted(weights, key=lambda i: (int(exact[i]) - exact[i], i))[: period - sum(out.values())]:
        out[i] += 1
    return out


def schedule(blocks: dict[int, int], weights: dict[int, float]) -> Iterator[int]:
    """The source of each slot until all blocks have one.

    In the fluid schedule every source with something left gets its exact weight's part of each slot, and the others
    share the weight of one that has ended. Block j of a source may run from the floor of the time when the fluid
    schedule starts it (j / w until a source ends) and must before the ceiling of the time when that ends it ((j + 1) / w).
    Serving the earliest deadline first meets them all, so each source is always less than one block from the fluid
    schedule. Weights are the rational numbers that they are written as, so no error adds up with the slots.
    """
    left = {i: n for i, n in blocks.items() if n}
    exact = {i: Fraction(str(weights[i])) for i in left}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    size = {i: int(x * scale) for i, x in exact.items()}
    rest = total = sum(size.values())

    # virtual time runs like time until a source ends, then faster; from each end on: virtual time, time, weight left
    begin, time, weight = [0], [0], [total]
    for end, i in sorted(((n * total << DIGITS) // size[i], i) for i, n in left.items()):
        time.append(time[-1] + (end - begin[-1]) * rest // total)
        begin.append(end)
        rest -= size[i]
        weight.append(rest)

    def reached(i: int, j: int) -> int:
        v = (j * total << DIGITS) // size[i]
        k = max(0, bisect_left(begin, v) - 1)
        return time[k] + (v - begin[k]) * weight[k] // total

    close = 1 << (DIGITS - TELLING)
    done, ends = dict.fromkeys(left, 0), {i: reached(i, 1) for i in left}
    later = [(0, i) for i in sorted(left)]
    ready: list[tuple[int, int]] = []
    for slot in range(sum(left.values())):
        while later and (later[0][0] <= slot or not ready):
            _, i = heapq.heappop(later)
            heapq.heappush(ready, (-((close - ends[i]) >> DIGITS), i))
        _, i = heapq.heappop(ready)
        yield i
        done[i] += 1
        if done[i] < left[i]:
            heapq.heappush(later, ((ends[i] + close) >> DIGITS, i))
            ends[i] = reached(i, done[i] + 1)


def serve(share: dict[int, int], period: int = PERIOD) -> list[int]:
    """The source of each slot of a period in which each source has its share."""
    return list(islice(schedule(share, share), period))


def phases(blocks: dict[int, int], weights: dict[int, float], period: int = PERIOD) -> Iterator[tuple[int, int, int, int, int, int, list[int]]]:
    """Rows (source, first block, blocks, blocks, first slot, period, slots after the first) of each stretch of `period` slots, built one at a time."""
    order, at, done = schedule(blocks, weights), 0, dict.fromkeys(blocks, 0)
    while some := list(islice(order, period)):
        slots: dict[int, list[int]] = defaultdict(list)
        for slot, i in enumerate(some):
            slots[i].append(slot)
        for i, where in slots.items():
            yield i, done[i], len(where), len(where), at, period, where
            done[i] += len(where)
        at += len(some)


def planned(spark: SparkSession, blocks: dict[int, int], weights: dict[int, float], period: int = PERIOD) -> DataFrame:
    """(__i, __block, __slot) of every block, as a table: one task carries the state from stretch to stretch and keeps none of them."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            found, n = [], 0
            for i, first, many, _, at, _, where in phases(blocks, weights, period):
                found.append((np.full(many, i), first + np.arange(many), at + np.array(where)))
                n += many
                if n >= 1 << 16:
                    yield pd.DataFrame(dict(zip(("__i", "__block", "__slot"), map(np.concatenate, zip(*found, strict=True)), strict=True)))
                    found, n = [], 0
            if found:
                yield pd.DataFrame(dict(zip(("__i", "__block", "__slot"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return stored(spark.range(0, 1, 1, 1).mapInPandas(rows, "__i int, __block long, __slot long"))[0]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """Every row of docs with its block (of its source), slot (of the schedule, one block each) and place (in the block).

    Order by slot and place. weights: of sources by name, any positive numbers; sources without
    one are one source together. By default every source has its own weight, its row count to the
    power TEMPERATURE. The plan is made from one entry for each source. Null is a source like others. A
    source's rows come in order of a hash of doc_id and text. The last block of a source may be short.
    Columns named block, slot and place are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "slot", "place")
    known = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        named = [r.source for r in known.orderBy(F.desc("n"), F.asc_nulls_last("source")).collect()]
    else:
        if min(weights.values(), default=1) <= 0:
            raise ValueError("weights must be positive")
        named = list(weights)
    rest = len(named)
    few = rest <= SOURCES
    strata = spark.createDataFrame(pd.DataFrame({"__source": pd.Series(named, dtype=object), "__stratum": np.arange(rest, dtype=np.int32)}), "__source string, __stratum int")
    at = F.broadcast(strata) if few else strata
    pick = F.coalesce(F.col("__stratum"), F.lit(rest))
    sizes = known.join(at, known["source"].eqNullSafe(at["__source"]), "left").groupBy(pick.alias("i")).agg(F.sum("n").alias("n"))
    rows = {r.i: r.n for r in sizes.collect()}
    if weights is None:
        wanted = {i: n**TEMPERATURE for i, n in rows.items()}
    else:
        wanted = {i: weights[named[i]] if i < rest else min(weights.values(), default=1.0) for i in rows}
    plan = planned(spark, {i: -(-n // block) for i, n in rows.items()}, wanted, period)
    dealt = docs.join(at, docs["source"].eqNullSafe(at["__source"]), "left").withColumn("__stratum", pick).drop("__source")
    dealt = dealt.withColumn("__h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))).withColumn("__cell", (F.col("__h") % CELLS).cast("int"))
    placed = with_position(dealt, "__stratum", "__cell", ["__h", "doc_id"], "__at", bounded=few)  # SOURCES strata of CELLS cells
    placed = placed.withColumn("block", F.floor(F.col("__at") / block).cast("long")).withColumn("place", (F.col("__at") % block).cast("int"))
    # grows with the blocks, so Spark chooses how to join; a block has few rows
    placed = placed.join(plan, (F.col("__stratum") == F.col("__i")) & (F.col("block") == F.col("__block")))
    return placed.withColumn("slot", F.col("__slot")).select(*docs.columns, "block", "slot", "place")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs in mixed order: partition by partition, and in each row by row.

    Slots run gapless from 0, so partitions take equal ranges of them without a sample of the rows.
    """
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("__row"), "doc_id", "source", F.xxhash64("text").alias("text"))
    rows = mix(whole, weights)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("n")).agg(F.sum("n")).first()[0] or 1
    # strata may share a source's last block, so there are `last` slots at most
    part = F.least(F.lit(n - 1), F.floor(F.col("slot") * n / last)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("slot", "place").select("__row.*")


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).select("doc_id", "source", "block", "slot", "place")
