"""Sharding, packing, mixing, quotation linking and the pipeline."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quillmark.llm import length_buckets, ngram_join, pfair_mix, quote_threads, virtual_slots
from quillmark.llm.common import stored
from quillmark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, duck_rows, ordered, spark_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long, slot string, shard string, block string, bucket int, n string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "a", "b", "c", 1, None) for i, t, s in rows], DOCS)


ODD = [(None, "x", None), (None, "x", None), (1, None, "a"), (2, "", "a"), (3, "long " * 40_000, "b"), (3, "long " * 40_000, "b")]


def test_shards(spark):
    rows = [(i, f"text {i}", "s") for i in range(10, 600)] + ODD
    found = virtual_slots.shard(docs(spark, rows), 8).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.law == "key" and (r.grown_shard == r.shard or r.grown_shard == 8)
    assert len({(r.doc_id, r.shard) for r in found}) == len({r.doc_id for r in found})
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.slot)
    assert all(sorted(v) == [*range(len(v))] for v in places.values()) and len(places) == 8
    by = {(r.doc_id, r.size): r for r in found}
    assert by[1, 1].text_crc32 == 0 and by[10, 8].text_crc32 == zlib.crc32(b"text 10")
    part = {r.doc_id: r.shard for r in virtual_slots.shard(docs(spark, rows[:50]), 8).collect()}
    assert all(by[i, len(t) + 1].shard == part[i] for i, t, _ in rows[:50])
    assert virtual_slots.shard(docs(spark, []), 8).count() == 0


def test_slot_map_grows_rebalances_and_is_stored(spark, tmp_path):
    m = virtual_slots.SlotMap.of(8)
    sizes = Counter(m.versions[-1])
    assert max(sizes.values()) - min(sizes.values()) <= 1
    before = m.versions[-1]
    m.grow()
    assert all(a == b or b == 8 for a, b in zip(before, m.versions[-1], strict=True))
    bytes_ = {s: 1 + (s % 50) ** 2 for s in range(virtual_slots.SLOTS)}
    m.rebalance(bytes_)
    load = Counter()
    for s, k in enumerate(m.versions[-1]):
        load[k] += bytes_[s]
    assert max(load.values()) - min(load.values()) <= 0.02 * sum(load.values()) / 9
    m.save(spark, f"file://{tmp_path}/map")
    assert virtual_slots.SlotMap.load(spark, f"file://{tmp_path}/map").versions == m.versions


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = np.random.default_rng(seed)
    longest = np.sort(rng.choice(np.arange(1, 60), 9, replace=False))
    counts = rng.integers(1, 30, 9)
    best = min(sum(int(c) * next(e for e in (*ends, longest[-1]) if e >= x) for x, c in zip(longest, counts, strict=True)) for ends in itertools.combinations(longest[:-1].tolist(), 2))
    found = length_buckets.boundaries(longest, counts, 3)
    assert len(found) == 3 and sum(int(c) * next(e for e in found if e >= x) for x, c in zip(longest, counts, strict=True)) == best


@pytest.mark.parametrize(("n", "buckets"), [(1, 3), (4, 9), (400, 6), (30_000, 12)])
def test_boundaries_of_many_long_lengths_are_optimal(n, buckets):
    rng = np.random.default_rng(n)
    lengths = np.sort(rng.choice(np.arange(1, 1_000_000), n, replace=False)).tolist()
    counts = rng.integers(1, 1000, n).tolist()
    found = length_buckets.boundaries(lengths, counts, buckets)
    total = sum(c * found[bisect.bisect_left(found, x)] for x, c in zip(lengths, counts, strict=True))
    assert len(found) == min(n, buckets) and found[-1] == lengths[-1]
    if n <= 400:  # every way
        before = np.concatenate(([0], np.cumsum(counts)))
        cost = [x * int(before[j + 1]) for j, x in enumerate(lengths)]
        for _ in range(1, buckets):
            cost = [min([cost[j], *(cost[i] + x * int(before[j + 1] - before[i + 1]) for i in range(j))]) for j, x in enumerate(lengths)]
        assert total == cost[-1]
    else:  # no boundary can be moved for the better
        for b in range(len(found) - 1):
            at = bisect.bisect_left(lengths, found[b])
            for other in lengths[max(0, at - 3) : at] + lengths[at + 1 : at + 4]:
                moved = sorted({*found[:b], other, *found[b + 1 :]})
                assert total <= sum(c * moved[bisect.bisect_left(moved, x)] for x, c in zip(lengths, counts, strict=True))


def test_shards_equal_a_plain_count(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    maps = virtual_slots.SlotMap.of(8)
    old = maps.versions[-1]
    maps.grow()
    want, held = {}, {}
    for r in docs:
        text = (r.text or "").encode()
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % virtual_slots.SLOTS
        want[r.doc_id] = (len(text) + 1, zlib.crc32(text), "key", old[slot], maps.versions[-1][slot])
        held.setdefault(old[slot], []).append((slot, r.doc_id, zlib.crc32(text)))
    place = {i: n for rows in held.values() for n, (_, i, _) in enumerate(sorted(rows))}
    found = QUERIES["op7_virtual_slots"](spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in found} == want
    assert {r.doc_id: r.slot for r in found} == place


@pytest.mark.parametrize("name", ["op7_virtual_slots", "op9_length_buckets"])
def test_layout_equals_sql(spark, name):
    found = spark_rows(QUERIES[name](spark, DATA))
    assert found == duck_rows(ORACLE_SQL[name]) and len(found[1]) == spark.read.parquet(f"{DATA}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op7_virtual_slots", "op9_length_buckets"])
@pytest.mark.parametrize("rows", [[], [*ODD, (4, "é\u2003ü\n\tx ", "a")], [(i, "w " * (i % 61), "s") for i in range(10, 300)] + ODD])
def test_layout_of_odd_rows_equals_sql(spark, tmp_path, name, rows):
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = spark_rows(QUERIES[name](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    done = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in done.description)
    at = [[d[0] for d in done.description].index(n) for n in names]
    assert found == (names, ordered([tuple(r[i] for i in at) for r in done.fetchall()]))


def test_batches(spark):
    rows = [(i, "w " * (i % 97), "s") for i in range(10, 500)] + ODD
    found = length_buckets.pack_documents(docs(spark, rows), 5, 300).collect()
    assert len(found) == len(rows)
    batches = defaultdict(list)
    for r in found:
        assert r.length <= r.padded
        batches[r.bucket, r.batch].append(r)
    for (bucket, batch), rs in batches.items():
        assert sorted(r.place for r in rs) == [*range(len(rs))]
        assert len(rs) * rs[0].padded <= 300 or len(rs) == 1
        assert batch == 0 or (bucket, batch - 1) in batches
    assert length_buckets.pack_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("weights", [{0: 0.5, 1: 0.3, 2: 0.2}, {0: 1, 1: 1, 2: 1, 3: 7}, {0: 5}])
def test_schedule_stays_within_a_block(weights):
    share = pfair_mix.shares(weights, 200)
    done = Counter()
    for t, i in enumerate(pfair_mix.serve(share, 200), 1):
        done[i] += 1
        assert all(abs(done[j] - share[j] * t / 200) < 1 for j in share)
    assert done == share


@pytest.mark.parametrize("weights", [{0: 0.7, 1: 0.3}, {0: 0.9, **{i: 0.002 for i in range(1, 51)}}, {0: 1, 1: 2.5, 2: 1e-4}])
def test_schedule_stays_within_a_block_of_the_weights_over_many_periods(weights):
    exact = {i: Fraction(str(w)) / sum(Fraction(str(v)) for v in weights.values()) for i, w in weights.items()}
    done, t, slots = Counter(), 0, {}
    for i, first, many, each, at, period, where in pfair_mix.phases(dict.fromkeys(weights, 400_000), weights):
        if at >= 60 * pfair_mix.PERIOD:
            break
        slots.update((at + b // each * period + where[b % each], i) for b in range(many))
    for t in range(60 * pfair_mix.PERIOD):
        done[slots[t]] += 1
        w = exact[slots[t]]
        assert abs(done[slots[t]] * w.denominator - w.numerator * (t + 1)) < w.denominator
        if t % 97 == 0:
            assert all(abs(done[j] - w * (t + 1)) < 1 for j, w in exact.items())


def test_sources_that_end_leave_the_others_within_a_block():
    blocks = {i: 1 + (i * 7919) % 400 for i in range(60)}
    weights = {i: 1 + i % 7 for i in blocks}
    fluid, done = dict.fromkeys(blocks, Fraction(0)), Counter()
    for i in pfair_mix.schedule(blocks, weights):
        done[i] += 1
        over = Fraction(1)
        while over:  # one slot of the fluid schedule
            on = [j for j in blocks if fluid[j] < blocks[j]]
            total = sum(weights[j] for j in on)
            step = min(over, *((blocks[j] - fluid[j]) * total / weights[j] for j in on))
            for j in on:
                fluid[j] += step * weights[j] / total
            over -= step
        assert all(abs(done[j] - fluid[j]) < 1 for j in blocks)
        if sum(done.values()) == 1500:
            break


def test_phases_hold_each_block_once():
    blocks = {0: 5000, 1: 17, 2: 1, 3: 333}
    seen, slots = defaultdict(list), []
    for i, first, many, each, at, period, where in pfair_mix.phases(blocks, {i: n**0.5 for i, n in blocks.items()}, 128):
        for b in range(many):
            seen[i].append(first + b)
            slots.append(at + b // each * period + where[b % each])
    assert {i: sorted(v) for i, v in seen.items()} == {i: [*range(n)] for i, n in blocks.items()}
    assert sorted(slots) == [*range(sum(blocks.values()))]


def test_mix(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else f"small{i % 2}") for i in range(10, 900)] + ODD
    found = pfair_mix.mix(docs(spark, rows), block=4, period=64).collect()
    assert len(found) == len(rows)
    assert len({(r.slot, r.place) for r in found}) == len(rows)
    assert {r.slot for r in found} == set(range(max(r.slot for r in found) + 1))
    assert all(len({r.source for r in g}) == 1 for g in [[r for r in found if r.slot == s] for s in range(0, 200, 7)])
    named = pfair_mix.mix(docs(spark, rows), {"big": 1, "small0": 3}, block=4, period=64).where("slot < 40").collect()
    assert len({r.slot for r in named if r.source == "small0"}) > 1.5 * len({r.slot for r in named if r.source == "big"})
    assert pfair_mix.mix(docs(spark, [])).count() == 0 and pfair_mix.mixed(docs(spark, [])).count() == 0


def test_each_of_many_sources_has_its_own_weight(spark):
    rows = [(i, f"t{i}", None if i % 400 == 7 else f"s{i % 400}") for i in range(4000)] + [(9000 + i, "x", "big") for i in range(1000)]
    found = pfair_mix.mix(docs(spark, rows), block=1).select("source", "block", "slot").collect()
    total = 400 * 10**0.5 + 1000**0.5
    assert len(found) == len({r.slot for r in found}) == len(rows) == max(r.slot for r in found) + 1
    assert {r.source for r in found if r.block == 0} == {r.source for r in found} and sum(r.block == 0 for r in found) == 401
    for t in (500, 2000, 4000):
        done = Counter(r.source for r in found if r.slot < t)
        assert all(abs(done[s] - t * (1000 if s == "big" else 10) ** 0.5 / total) < 1 for s in {r.source for r in found})
    weights = {f"s{i}": 1 + i % 3 for i in range(300)}
    assert pfair_mix.mix(docs(spark, rows), weights, block=1).count() == len(rows)


def test_mixed_rows_keep_their_columns_and_order(spark):
    rows = [(i, f"t{i}", f"s{i % 5}") for i in range(300)]
    d = docs(spark, rows)
    got = pfair_mix.mixed(d)
    assert got.columns == d.columns
    order = [r.doc_id for r in got.collect()]
    want = [r.doc_id for r in pfair_mix.mix(d.select("doc_id", "source", "text").withColumn("text", __import__("pyspark").sql.functions.xxhash64("text"))).orderBy("slot", "place").collect()]
    assert order == want


CHAT = [
    (1, 0, "a", "Hello there. How are the orders today?"),
    (1, 1, "b", "> Hello there. How are the\n> orders today?\nThey are fine."),
    (1, 2, "a", "Something else entirely."),
    (1, 3, "a", "On Monday b wrote:\n> > Hello there. How are the orders today?\n> They are fine.\nGood."),
    (1, 4, "c", "> never said by anyone\nWhat?"),
    (1, 5, "c", "> Something ELSE entirely\nYes"),
    (2, 0, "a", None), (None, 1, "a", "> x"), (2, None, None, ""), (2, 0, "a", None),
]


def test_quotes_are_linked_and_removed(spark):
    table = spark.createDataFrame([(*r, "x", 1) for r in CHAT], "conv_id long, turn long, role string, text string, message string, level int")
    found = {(r.conv_id, r.turn): r for r in quote_threads.thread(table).collect()}
    assert quote_threads.thread(table).count() == len(CHAT)
    assert [found[1, t].reply_to for t in range(6)] == [None, 0, None, 1, None, 2]
    assert [found[1, t].thread for t in range(6)] == [0, 0, 2, 0, 4, 2]
    assert [found[1, t].position for t in (0, 1, 3, 2, 5, 4)] == [*range(6)]
    assert found[1, 1].text == "They are fine." and found[1, 3].text == "Good." and found[1, 3].quote_depth == 2
    assert (found[1, 3].n_quotes, found[1, 3].n_linked, found[1, 4].n_linked) == (2, 2, 0)
    assert found[2, 0].text == "" and found[None, 1].reply_to is None
    assert quote_threads.thread(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs_ = spark.read.parquet(f"{DATA}/documents.parquet")
    toxic, near, mixed, packed = (f for _, f in corpus_pipeline.STAGES)
    kept, _ = stored(toxic(spark, docs_, DATA))
    assert kept.columns == docs_.columns and kept.join(docs_, docs_.columns).count() == kept.count() > 0.5 * docs_.count()
    one, _ = stored(near(spark, kept, DATA))
    lead = {r.class_id for r in ngram_join.classes(kept).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(lead)
    order, _ = stored(mixed(spark, one, DATA))
    assert sorted(map(tuple, order.collect())) == sorted(map(tuple, one.collect()))
    rows = packed(spark, order, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lead)
    assert QUERIES["op9_length_buckets"](spark, DATA).count() == docs_.count()


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "length", "bucket", "padded", "batch", "place"]
