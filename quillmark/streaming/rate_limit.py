"""Requests limited per client: a window opens with a client's first request and lasts `seconds`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.sources.store import written

#: Windows' widths that are sorted together.
STRETCH = 64
SCHEMA = "client string, ts timestamp, n long, allowed boolean"


def client(forwarded: str, address: str):
    """The first hop of a forwarded address, else the address itself."""
    return F.coalesce(F.trim(F.split_part(F.col(forwarded), F.lit(","), F.lit(1))), F.col(address), F.lit("unknown"))


def _counted(times: list, opened: float | None, n: int, limit: int, seconds: int) -> tuple[list[tuple[int, bool]], float | None, int]:
    out = []
    for t in times:
        now = t.timestamp()
        if opened is None or now > opened + seconds:
            opened, n = now, 0
        n += 1
        out.append((n, n <= limit))
    return out, opened, n


def _along(rows: DataFrame, value: Column, name: str, order: list[Column], backwards: bool = False) -> DataFrame:
    """The last value that isn't null in each row's client up to the row, in order: found stretch by stretch, then across stretches.

    rows: with client, stretch and what order names; of backwards rows later stretches come first.
    A client's rows are sorted one stretch of time at a time, so a busy client is many tasks' work.
    """
    here = Window.partitionBy("client", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("__v", value).withColumn("__here", F.last("__v", ignorenulls=True).over(here))
    per = found.groupBy("client", "stretch").agg((F.min if backwards else F.max)("__v").alias("__s"))
    before = Window.partitionBy("client").orderBy(F.desc("stretch") if backwards else F.col("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.last("__s", ignorenulls=True).over(before)).drop("__s")
    return found.join(per, ["client", "stretch"]).withColumn(name, F.coalesce("__here", "__before")).drop("__v", "__here", "__before")


def openings(times: DataFrame, width: int) -> DataFrame:
    """(client, opened): where windows of `width` microseconds begin, for different times (client, at).

    A request later than a pause of more than a window begins one in any case. From there each
    window's successor is the first request behind its end: these pointers are doubled, so after k
    rounds all windows within 2 ** k of such a beginning are known, and it ends with the first round that finds none.
    """
    stretch = lambda c: F.floor(c / (STRETCH * width)).alias("stretch")
    # the first time behind the end of a window that would begin at each time
    asked = times.select("client", (F.col("at") + width).alias("pos"), F.lit(0).alias("kind"), stretch(F.col("at") + width))
    there = times.select("client", F.col("at").alias("pos"), F.lit(1).alias("kind"), stretch(F.col("at")))
    time = F.when(F.col("kind") == 1, F.col("pos"))
    later = _along(asked.unionByName(there), time, "next", [F.desc("pos"), F.col("kind")], backwards=True)
    jumps = later.where("kind = 0 and next is not null").select("client", (F.col("pos") - width).alias("at"), "next")
    jumps = written(jumps, "jumps")
    # a pause before a time: the time before it, in its stretch or the one before, is more than a window's width away
    earlier = F.lag("pos").over(Window.partitionBy("client", "stretch").orderBy("pos"))
    first = there.withColumn("prev", earlier)
    edges = there.groupBy("client", "stretch").agg(F.max("pos").alias("__last")).withColumn("__prev", F.lag("__last").over(Window.partitionBy("client").orderBy("stretch"))).drop("__last")
    first = first.join(edges, ["client", "stretch"]).withColumn("prev", F.coalesce("prev", "__prev"))
    found = written(first.where(F.col("prev").isNull() | (F.col("pos") > F.col("prev") + width)).select("client", F.col("pos").alias("at")), "openings")
    n = found.count()
    while True:
        grown = written(found.unionByName(found.join(jumps, ["client", "at"]).select("client", F.col("next").alias("at"))).distinct(), "openings")
        now = grown.count()
        if now == n:
            return grown.select("client", F.col("at").alias("opened"))
        found, n = grown, now
        far = jumps.select("client", F.col("at").alias("next"), F.col("next").alias("far"))
        jumps = written(jumps.join(far, ["client", "next"]).select("client", "at", F.col("far").alias("next")), "jumps")


def limited(requests: DataFrame, limit: int = 20, seconds: int = 60) -> DataFrame:
    """Each request (client, ts) with its number n in the client's window and whether it is allowed. A batch query.

    Requests of equal times count in any order. A null client is "unknown"; a null time has no number, and allowed is null.
    """
    width = seconds * 1_000_000
    rows = requests.select(F.coalesce("client", F.lit("unknown")).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    timed = rows.where("ts is not null").withColumn("at", F.unix_micros("ts"))
    times = timed.select("client", "at").distinct()
    opened = openings(times, width).select("client", F.col("opened").alias("at"), F.lit(True).alias("opens"))
    marked = times.join(opened, ["client", "at"], "left").withColumn("stretch", F.floor(F.col("at") / (STRETCH * width)))
    inside = _along(marked, F.when(F.col("opens"), F.col("at")), "opened", [F.col("at")]).select("client", "at", "opened")
    n = F.row_number().over(Window.partitionBy("client", "opened").orderBy("at")).cast("long")
    counted = timed.join(inside, ["client", "at"]).withColumn("n", n).select("client", "ts", "n", (F.col("n") <= limit).alias("allowed"))
    none = rows.where("ts is null").select("client", "ts", F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("allowed"))
    return counted.unionByName(none)


def limited_stream(requests: DataFrame, limit: int = 20, seconds: int = 60) -> DataFrame:
    """The same over a stream; a client's state goes when its window has passed by the processing time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values("ts", kind="stable")
        got, opened, n = _counted(list(pdf["ts"]), opened, n, limit, seconds)
        state.update((opened, n))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield pd.DataFrame({"client": key[0], "ts": pdf["ts"].to_numpy(), "n": [g[0] for g in got], "allowed": [g[1] for g in got]})

    rows = requests.select(F.coalesce("client", F.lit("unknown")).alias("client"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("client").applyInPandasWithState(update, SCHEMA, "opened double, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def aligned(requests: DataFrame, limit: int = 20, width: str = "1 minute") -> DataFrame:
    """(client, opened, n, rejected) of windows that start with the clock's minute: other limits than limited()'s, but plain SQL."""
    counts = requests.groupBy("client", F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("client", F.col("w.start").alias("opened"), "n", F.greatest(F.lit(0), F.col("n") - limit).alias("rejected"))
