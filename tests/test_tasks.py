"""States of tasks in batch and stream against a plain walk through the events."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quillmark.streaming import tasks

START = dt.datetime(2024, 1, 1)
SCHEMA = "task_id long, ts timestamp, kind string, state string"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def table(spark, events):
    return spark.createDataFrame([(i, None if s is None else at(s), k, "x") for i, s, k in events], SCHEMA)


def walk(events, now):
    """{task: (state, since, expires, found)}, seconds."""
    out = {}
    for i in {i for i, s, k in events if None not in (i, s, k)}:
        own = sorted(((s, k == "read", k) for j, s, k in events if j == i and s is not None and k is not None and s <= now))
        state = since = expires = None
        for s, read, k in own:
            if not read:
                state, since, expires = k, s, s + 600 if k in ("done", "error") else None
            elif state == "done" and s <= expires:
                expires = s + 60
        if state:
            out[i] = (state, since, expires, expires is None or now <= expires)
    return out


def seconds(t):
    return None if t is None else (t - START).total_seconds()


def batch(spark, events, now):
    return {r.task_id: (r.state, seconds(r.since), seconds(r.expires), r.found) for r in tasks.status(table(spark, events), at(now)).collect()}


POLLED = [(1, 0, "queued"), *((1, s, "read") for s in range(1, 200)), (1, 50, "done")]
JUDGED = [(2, 0, "queued"), (2, 1, "read"), (2, 10, "done"), (2, 11, "read")]
OTHERS = [(3, 0, "done"), (3, 590, "read"), (4, 0, "error"), (4, 10, "read"), (5, 0, "processing"), (5, 5, "read"), (6, 3, "read"), (7, 0, "done"), (7, 10, "read"), (7, 100, "read"), (7, 101, "read"), (None, 0, "done"), (8, None, "done"), (8, 0, None)]


@pytest.mark.parametrize(("now", "want"), [(70, True), (71, True), (71.5, False), (120, False)])
def test_a_read_of_a_done_task_sets_its_end(spark, now, want):
    assert batch(spark, JUDGED, now)[2] == ("done", 10, 71, want)


def test_batch_equals_the_walk(spark):
    events = POLLED + JUDGED + OTHERS
    for now in (5, 240, 259, 260, 600, 650, 651):
        assert batch(spark, events, now) == walk(events, now)
    assert batch(spark, events, 258)[1] == ("done", 50, 259, True)  # polled each second until 199
    rng = random.Random(1)
    made = [(rng.randrange(30), rng.randrange(9000) * 5, rng.choice(["queued", "processing", "done", "error", *["read"] * 60])) for _ in range(9000)]
    made += [(99, 0, "done"), *((99, s, "read") for s in range(30, 20_000, 55))]  # over several stretches
    for now in (9000, 19_000, 30_000, 50_000):
        assert batch(spark, made, now) == walk(made, now)


def test_empty_table(spark):
    assert batch(spark, [], 10) == {}


def test_stream_equals_the_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", tasks.STORE)
    # each batch's events arrive in any order; the last ones push the watermark on
    batches = [[(1, 5, "read"), (1, 0, "queued"), (2, 0, "queued"), (2, 1, "read"), (3, 3, "done"), (4, 0, "error")], [(2, 11, "read"), (2, 10, "done"), (1, 9, "processing"), (5, 8, "processing")], [(9, 100, "queued"), (3, 90, "read")], [(1, 101, "done"), (3, 149, "read"), *((1, s, "read") for s in range(102, 130))], [(9, 5000, "queued")], [(9, 9000, "queued")]]
    try:
        for some in batches:
            table(spark, some).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            write = lambda b, _: b.write.mode("append").parquet(str(tmp_path / "out"))
            tasks.status_stream(stream).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = [(r.task_id, r.state, seconds(r.since), seconds(r.expires), seconds(r["at"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    events = [e for some in batches for e in some]
    for now in (0, 5, 10, 50, 71, 72, 120, 160, 189, 190, 210, 700, 4000):
        want = walk(events, now)
        found = {}
        for i, state, since, expires, when in sorted(rows, key=lambda r: (r[4], r[1] == "expired")):
            if when <= now and not (state == "expired" and now <= expires):
                found[i] = (state, since, expires)
        live = {i: v for i, v in found.items() if v[0] != "expired"}
        assert live == {i: w[:3] for i, w in want.items() if w[3]}, now
    assert {i for i, state, *_ in rows if state == "expired"} == {1, 2, 3, 4}
