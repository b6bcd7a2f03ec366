"""Nearest neighbours and exact top-k against brute force."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from quillmark.llm import bitsliced, lsh_search
from quillmark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import DATA, duck_rows, spark_rows

SCHEMA = "vec_id long, embedding array<double>, score string, rank int, part string"
ODD = [(None, [1.0, 2.0], "x", 1, "y"), (2, None, "x", 1, "y"), (4, [0.0, 0.0], None, None, None), (6, [float("nan"), 1.0], "x", 1, "y"), (8, [1.0, None], "x", 1, "y"), (10, [float("inf"), 0.0], "x", 1, "y")]


def vectors(spark, x, odd=()):
    rows = [(i, [float(c) for c in v], "x", 1, "y") for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *odd], SCHEMA)


def brute(x, every, k):
    out = {}
    for i in range(0, len(x), every):
        s = (x[i] * x).sum(axis=1)
        s[i] = -np.inf
        order = np.lexsort((np.arange(len(x)), -s))[: min(k, len(x) - 1)]
        out[i] = [(int(j), s[j]) for j in order]
    return out


@pytest.mark.parametrize(("n", "dims"), [(12, 4), (3000, 32)])
def test_nearest_neighbours_have_recall(spark, n, dims):
    x = np.random.default_rng(1).standard_normal((n, dims))
    found = {}
    for r in lsh_search.search(vectors(spark, x, [(1000 * n + o[0] if o[0] else None, *o[1:]) for o in ODD])).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(x, 20, 20)
    assert found.keys() == want.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, rows in found.items():
        assert all(abs(s - (x[q] * x[i]).sum()) < 1e-12 for i, s in rows)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
    if n <= 20:  # all candidates, exactly
        assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_nearest_neighbours_of_the_given_table(spark):
    rows = QUERIES["op1_lsh_search"](spark, DATA).collect()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in table], dtype=np.float64)
    want = brute(x, 20, 20)
    assert sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in rows) >= 0.9 * sum(map(len, want.values()))


def test_few_rows_are_candidates_and_fewer_of_a_larger_table(spark):
    share = []
    for n in (2000, 10_000):
        x = np.random.default_rng(6).standard_normal((n, 48))
        found, asked = {}, {}
        for r in lsh_search.search(vectors(spark, x)).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
            asked[r.query_id] = r.candidates
        want = brute(x, 20, 20)
        assert sum(len(found[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
        share.append(sum(asked.values()) / len(asked) / n)
    assert share[0] < 0.4 and share[1] < 0.75 * share[0]


def test_very_long_and_unequal_vectors(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((300, 2000)) * rng.uniform(0.01, 1e6, (300, 1))
    found = {}
    for r in lsh_search.search(vectors(spark, x, [(1000, [1.0], None, None, None), (1001, [], None, None, None)])).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(x, 20, 20)
    assert sum(len(set(found[q]) & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want) and len(found[1000]) <= 20


@pytest.mark.parametrize("spread", [0.0, 0.02])
def test_queries_outside_a_hot_group_have_recall(spark, spread):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 64))
    hot = np.arange(6000) % 3 == 1
    x[hot] = x[1] + spread * rng.standard_normal((hot.sum(), 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = {}
    for r in lsh_search.search(vectors(spark, x)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: {i for i, _ in v} for q, v in brute(x, 20, 20).items() if not hot[q]}
    assert sum(len(found[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_repeated_rows_leave_room_for_other_neighbours(spark):
    x = np.random.default_rng(9).standard_normal((600, 16))
    x[300] *= 3
    rows = [(i, v.tolist(), "x", 1, "y") for i, v in enumerate(x)]
    several = spark.createDataFrame(3 * rows + 30 * [rows[300]], SCHEMA)  # one id with many rows, near to many queries
    rank = lambda found: sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    want = {(q, n + 1, i) for q, v in brute(x, 20, 20).items() for n, (i, _) in enumerate(v)}
    got = rank(lsh_search.search(several))
    assert len(got) == len(want) and len({(q, i) for q, _, i in got} & {(q, i) for q, _, i in want}) >= 0.95 * len(want)


def test_ties_and_hot_vector(spark):
    x = np.concatenate([np.tile([1.0, 0.0, 0.0], (900, 1)), np.random.default_rng(2).standard_normal((300, 3)) * 0.1])
    rows = lsh_search.search(vectors(spark, x)).where("query_id = 40").orderBy("rank").collect()
    assert [r.vec_id for r in rows] == [*range(20)]


def test_exact_topk_equals_sql(spark):
    assert spark_rows(QUERIES["op3_bitsliced_topk"](spark, DATA)) == duck_rows(ORACLE_SQL["op3_bitsliced_topk"])


def test_exact_topk_with_odd_rows_and_ties(spark):
    x = np.random.default_rng(3).integers(-2, 3, (500, 5)) / 256.0
    found = [(r.query_id, r["rank"], r.vec_id, r.score) for r in bitsliced.search(vectors(spark, x, [(10_000 + (o[0] or 0), *o[1:]) if o[0] else o for o in ODD if o[0] != 4])).orderBy("query_id", "rank").collect()]
    q = np.floor(256 * x).astype(int)
    want = [(i, k + 1, j, int(s)) for i, v in brute(q.astype(float), 50, 5).items() for k, (j, s) in enumerate(v)]
    assert found == want


def test_exact_topk_of_large_components(spark):
    rows = [(50, [1.0, 1.0]), (1, [70000.0, 1.0]), (2, [1.0, 2.0]), (3, [1e9, -1e9]), (4, [-1e9, 3.0]), (100, [-1000.0, 0.25]), (5, [1e30, -1e30]), (6, [2.5, 1.5]), (150, [0.0, 0.0]), (7, [70000.0]), (6, [9.0, 9.0])]
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in bitsliced.search(table.where("vec_id <> 5")).collect())
    whole = {n: [math.floor(Fraction(256) * Fraction(c)) for c in v] for n, (_, v) in enumerate(rows)}
    want = []
    for n, (q, _) in enumerate(rows):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[n], whole[m], strict=False)), i) for m, (i, _) in enumerate(rows) if i not in (q, 5))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert max(abs(r[3]) for r in want) < 2**63 and found == sorted(want)
    near = bitsliced.search(table.where("vec_id in (5, 50, 2)"))  # 5 and 50 are at right angles
    assert [(r.vec_id, r.score) for r in near.orderBy("rank").collect()] == [(2, 3 * 256**2), (5, 0)]
    with pytest.raises(Exception, match="64-bit"):
        bitsliced.search(table.where("vec_id in (5, 100)")).collect()


def test_exact_topk_of_very_long_and_empty_vectors(spark):
    x = np.random.default_rng(5).integers(-9, 9, (60, 3000)) / 256.0
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in bitsliced.search(vectors(spark, x, [(70, [], None, None, None), (70, [], None, None, None)])).collect()}
    want = brute(np.floor(256 * np.vstack([x, np.zeros((1, 3000))])), 50, 5)
    assert [found[50, k + 1][1] for k in range(5)] == [int(s) for _, s in want[50]]


@pytest.mark.parametrize("search", [bitsliced.search, lsh_search.search])
def test_empty_and_lonely(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert search(vectors(spark, np.ones((1, 2)))).count() == 0
    assert search(spark.createDataFrame(ODD, SCHEMA).where("vec_id is null or vec_id <> 4")).count() == 0


def test_no_query_or_block_goes_through_the_driver(spark):
    found = bitsliced.search(vectors(spark, np.random.default_rng(2).standard_normal((600, 16)) / 4))
    assert len(found.collect()) == 12 * 5
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [3, 200, 40_000, 1 << 40])
def test_queries_are_packed_narrowly_and_whole(most):
    x = np.array([[-most, 0, most - 1]], dtype=np.int64)
    data = bitsliced.packed(x)
    assert len(data) < 1 + x.nbytes or most > 1 << 31
    assert (bitsliced.unpacked(data, 1, 3) == x).all()
