"""The result store: rows that replace each other, and a writer that dies."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest

from quillmark.operators import citations
from quillmark.plans import analyze as P
from quillmark.sources.store import ResultStore

SCHEMA = "file_hash string, paper_id long, state string, analyzed_at timestamp"


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def put(store, spark, rows):
    store.upsert(spark.createDataFrame([(h, i, s, at(t)) for h, i, s, t in rows], SCHEMA))


def held(store):
    return {r.file_hash: (r.state, r.analyzed_at) for r in store.rows().collect()}


def files(spark, path):
    return {r.f for r in spark.read.parquet(path).selectExpr("input_file_name() AS f").distinct().collect()}


def test_placeholder_result_and_error_replace_each_other(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/s", buckets=4)
    put(store, spark, [(k, i, "pending", 0) for i, k in enumerate("abcd")])
    put(store, spark, [("a", 0, "done", 1), ("b", 1, "error", 1), (None, 9, "done", 9), ("e", 4, "done", 5), ("e", 4, "pending", 5)])
    assert {k: s for k, (s, _) in held(store).items()} == {"a": "done", "b": "error", "c": "pending", "d": "pending", "e": "done"}
    put(store, spark, [("b", 1, "done", 2), ("a", 0, "pending", 0)])  # an older row changes nothing
    assert {k: s for k, (s, _) in held(store).items()} == {"a": "done", "b": "done", "c": "pending", "d": "pending", "e": "done"}


def test_a_batch_twice_changes_nothing_and_other_buckets_stay(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = ResultStore(spark, path, buckets=16)
    put(store, spark, [(f"k{i}", i, "pending", 0) for i in range(60)])
    before, old = held(store), files(spark, path)
    batch = [("k1", 1, "done", 3), ("new", 99, "done", 3)]
    put(store, spark, batch)
    once = held(store)
    assert once == before | {"k1": ("done", at(3)), "new": ("done", at(3))}
    assert len(old - files(spark, path)) <= 2  # files of two buckets at most went
    put(store, spark, batch)
    assert held(store) == once


def test_a_writer_that_dies_is_made_good(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store = ResultStore(spark, path, buckets=4)
    put(store, spark, [(k, 0, "pending", 0) for k in "abcdefgh"])
    new = spark.createDataFrame([(k, 0, "done", at(1)) for k in "abcdefgh"], SCHEMA).withColumn("bucket", store.bucket(P.F.col("file_hash")))
    new.write.partitionBy("bucket").parquet(store.staged)  # it was written as a whole ...
    for p in (tmp_path / "s").glob("bucket=*"):
        shutil.rmtree(p)  # ... and the old buckets are gone
        break
    assert {s for s, _ in held(ResultStore(spark, path, buckets=4)).values()} == {"done"} and len(held(store)) == 8
    new.limit(1).write.partitionBy("bucket").parquet(store.staged)
    (tmp_path / "s-staged" / "_SUCCESS").unlink()  # this one wasn't
    assert len(held(store)) == 8 and not store.exists(store.staged)


def test_unsettled_reads_only_the_buckets_of_its_keys(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}/s", buckets=16)
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("x", 4)], "file_hash string, paper_id long")
    assert store.unsettled(asked).count() == 4
    put(store, spark, [("a", 1, "done", 0), ("b", 2, "rejected", 0), ("c", 3, "error", 0), *((f"k{i}", 9, "done", 0) for i in range(99))])
    left = store.unsettled(asked)
    assert sorted(r.file_hash for r in left.collect()) == ["c", "x"]
    plan = left._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1][:40]


@pytest.fixture
def small(spark):
    text = "Abstract\n" + "This study measures what papers say about the data that they use. " * 12
    papers = [(1, "a.txt", text), (2, "copy.txt", text), (3, "short.txt", "Too short."), (4, "b.txt", text + "More of it follows here.")]
    corpus = spark.createDataFrame([(0, "T", "one two three four", "c"), (1, "U", "one two five six", "c")], "item_id long, title string, text string, corpus string")
    works = citations.noticed(spark.createDataFrame([], "doi string, title string, year int, abstract string, refs array<string>, update_to array<struct<type string, label string, year int>>"))
    retractions = spark.createDataFrame([], "doi string, retraction_date string, reason string, notice_type string")
    return spark.createDataFrame(papers, "paper_id long, filename string, full_text string"), corpus, works, retractions


def test_a_stream_of_papers_leaves_results_and_rejections(spark, tmp_path, small, monkeypatch):
    papers, *rest = small
    papers.coalesce(1).write.parquet(str(tmp_path / "in"))
    path = f"file://{tmp_path}/out"

    def run(state):
        stream = spark.readStream.schema(papers.schema).parquet(str(tmp_path / "in"))
        P.score_stream(stream, path, str(tmp_path / state), *rest).awaitTermination(300)

    def fails(*_, **__):
        return real(*_, **__).withColumn("verdict", P.F.raise_error(P.F.lit("no registry")))

    real = P.analyze
    monkeypatch.setattr(P, "analyze", fails)
    with pytest.raises(Exception, match="no registry"):
        run("state1")
    rows = {r.paper_id: r for r in ResultStore(spark, path).rows().collect()}
    assert {i: r.state for i, r in rows.items()} == {1: "error", 3: "rejected", 4: "error"} and "no registry" in rows[1].error
    monkeypatch.setattr(P, "analyze", real)
    run("state1")
    rows = {r.paper_id: r for r in ResultStore(spark, path).rows().collect()}
    assert {i: r.state for i, r in rows.items()} == {1: "done", 3: "rejected", 4: "done"}
    assert rows[3].error and rows[1].error is None and rows[1].verdict not in (None, "pending")
    run("state2")  # the same papers once more
    assert {r.paper_id: r for r in ResultStore(spark, path).rows().collect()} == rows
