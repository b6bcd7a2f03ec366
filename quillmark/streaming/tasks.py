"""States of queued analyses: queued, processing, done or error, until they expire."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a finished task is kept, and that a done one is kept after each time it is read.
KEPT, READ = 600, 60
SECOND = 1_000_000
#: Reads of one task are looked through in stretches of so many seconds.
STRETCH = 3600
#: transformWithState needs this state store: spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def expiries(done: DataFrame, reads: DataFrame) -> DataFrame:
    """(task_id, expires): when a done task (task_id, since) goes that is read at times (task_id, at), all in microseconds.

    Each read that still finds the task sets its end anew, to READ seconds later. The end is found
    stretch by stretch, so a task that is read all the time isn't one task's work.
    """
    after = reads.join(done, "task_id").where("at >= since").select("task_id", "since", "at").distinct()
    after = after.withColumn("stretch", F.floor(F.col("at") / (STRETCH * SECOND)))
    before = F.lag("at").over(Window.partitionBy("task_id", "stretch").orderBy("at"))
    late = after.withColumn("before", before).withColumn("end", F.when(F.col("at") - F.col("before") > READ * SECOND, F.col("before") + READ * SECOND))
    each = late.groupBy("task_id", "since", "stretch").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.min("end").alias("end"))
    limit = F.coalesce(F.lag("last").over(Window.partitionBy("task_id").orderBy("stretch")) + READ * SECOND, F.col("since") + KEPT * SECOND)
    ends = each.withColumn("limit", limit).withColumn("end", F.when(F.col("first") > F.col("limit"), F.col("limit")).otherwise(F.col("end")))
    return ends.groupBy("task_id").agg(F.coalesce(F.min("end"), F.max("last") + READ * SECOND).alias("expires"))


def status(events: DataFrame, now: object) -> DataFrame:
    """(task_id, state, since, expires, found) at a time, from events (task_id, ts, kind) of kinds queued, processing, done, error and read.

    The latest event that is no read makes the state, of equal times the greater kind. A finished
    task is kept for KEPT seconds; each read of a done one that finds it sets its end to READ
    seconds later, sooner or later than before. Reads of other tasks change nothing, and an
    unfinished task has no end. Events without task, time or kind are left out.
    """
    when = F.unix_micros(F.lit(now).cast("timestamp"))
    rows = events.select("task_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind").where("task_id is not null and kind is not null").where(F.col("at") <= when)
    latest = rows.where("kind <> 'read'").groupBy("task_id").agg(F.max(F.struct("at", "kind")).alias("s")).select("task_id", F.col("s.at").alias("since"), F.col("s.kind").alias("state"))
    read = expiries(latest.where("state = 'done'").select("task_id", "since"), rows.where("kind = 'read'").select("task_id", "at"))
    out = latest.join(read, "task_id", "left").withColumn("expires", F.when(F.col("state").isin("done", "error"), F.coalesce("expires", F.col("since") + KEPT * SECOND)))
    return out.select("task_id", "state", F.timestamp_micros("since").alias("since"), F.timestamp_micros("expires").alias("expires"), (F.col("expires").isNull() | (F.col("expires") >= when)).alias("found"))


class Task(StatefulProcessor):
    """One task's state. Events wait until the watermark has passed them, so that they count in order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, since long, expires long")
        self.waiting = handle.getListState("waiting", "at long, kind string")

    def timer(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def row(self, key: tuple, state: str, since: int, expires: int | None, at: int) -> pd.DataFrame:
        times = {n: pd.Series(pd.to_datetime([v], unit="us")) for n, v in (("since", since), ("expires", expires), ("at", at))}
        return pd.DataFrame({"task_id": [key[0]], "state": [state], **times})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for at, kind in zip(pdf["at"].tolist(), pdf["kind"], strict=True):
                self.waiting.appendValue((at, kind))
                self.timer(at)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = 1000 * expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.waiting.get()) if self.waiting.exists() else []
        # at equal times a read comes last, as it finds the state that others have made
        due = sorted((e for e in held if e[0] <= now), key=lambda e: (e[0], e[1] == "read", e[1]))
        state, since, expires = self.now.get() if self.now.exists() else (None, None, None)
        changed = None
        for at, kind in due:
            if expires is not None and at > expires:
                yield self.row(key, "expired", since, expires, expires)
                state = since = expires = None
            if kind != "read":
                state, since, expires = kind, at, at + KEPT * SECOND if kind in ("done", "error") else None
                changed = at
            elif state == "done":
                expires, changed = at + READ * SECOND, at
        if changed is not None:
            if state is not None:
                yield self.row(key, state, since, expires, changed)
            if expires is not None:
                self.timer(expires + 1)
        if expires is not None and now > expires:
            yield self.row(key, "expired", since, expires, expires)
            state = None
        if len(due) < len(held):
            self.waiting.put([e for e in held if e[0] > now])
        elif held:
            self.waiting.clear()
        if state is None:
            self.now.clear()
        elif changed is not None:
            self.now.update((state, since, expires))

    def close(self) -> None:
        pass


def status_stream(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(task_id, state, since, expires, at): every change of a task's state, with the time that it changed at; state expired once it is gone.

    The rules of status(), by the events' own times: a change comes out once the watermark, `late`
    behind the latest event, has passed it, and events may arrive in any order until then. A
    finished task's state goes when its timer fires. In append mode, on the state store STORE.
    """
    rows = events.select("task_id", F.col("ts").cast("timestamp").alias("ts"), "kind").where("task_id is not null and ts is not null and kind is not null")
    rows = rows.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    schema = "task_id long, state string, since timestamp, expires timestamp, at timestamp"
    return rows.groupBy("task_id").transformWithStateInPandas(Task(), schema, "append", "EventTime")
