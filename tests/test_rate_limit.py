"""Fixed windows against a walk through each client's requests."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

from quillmark.streaming import rate_limit

START = dt.datetime(2024, 1, 1)


def walk(rows, limit, seconds):
    """(client, time, n, allowed) of each request, seconds as floats."""
    out, opened, n = [], {}, {}
    for c, s in sorted(rows, key=lambda r: (r[0] or "unknown", r[1])):
        c = c or "unknown"
        if c not in opened or s > opened[c] + seconds:
            opened[c], n[c] = s, 0
        n[c] += 1
        out.append((c, s, n[c], n[c] <= limit))
    return Counter(out)


def found(spark, rows, limit, seconds):
    df = spark.createDataFrame([(c, START + dt.timedelta(seconds=s), 1) for c, s in rows], "client string, ts timestamp, n int")
    return Counter((r.client, (r.ts - START).total_seconds(), r.n, r.allowed) for r in rate_limit.limited(df, limit, seconds).collect())


def test_windows_of_any_requests(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(40_000) / 4) for _ in range(1500)]
    rows += [("edge", s) for s in (0, 60, 60, 120, 120.25, 180, 181, 300, 100_000, 100_060, 100_061)] + [("a", 7.0)] * 9
    assert found(spark, rows, 3, 60) == walk(rows, 3, 60)


def test_a_client_with_a_third_of_all_requests_and_no_pause(spark):
    rows = [("hot", s) for s in range(0, 30_000, 7)] + [(f"c{i % 900}", i * 3.5) for i in range(8000)]
    assert found(spark, rows, 5, 60) == walk(rows, 5, 60)


def test_null_times_and_empty_tables(spark):
    schema = "client string, ts timestamp"
    assert rate_limit.limited(spark.createDataFrame([], schema)).collect() == []
    rows = rate_limit.limited(spark.createDataFrame([("a", None), ("a", START)], schema)).collect()
    assert sorted((r.client, r.n, r.allowed) for r in rows if r.n) == [("a", 1, True)] and len(rows) == 2
