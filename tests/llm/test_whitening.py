"""Whitening against a dense eigendecomposition and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillmark.llm import whitening
from quillmark.llm.queries import QUERIES
from tests.oracle import DATA

SCHEMA = "vec_id long, embedding array<double>, n int, x string, component string"
ODD = [(900, None), (901, [1.0, None]), (902, [float("nan"), 0.0]), (903, [float("inf"), 0.0])]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], SCHEMA)


def compare(found, rows, components=4, near=1e-9):
    """rows: (vec_id, entries). Every returned number against a plain computation."""
    dims = max(len(v) for _, v in rows)
    whole = [(i, [math.floor(256 * float(c)) for c in v] + [0] * (dims - len(v))) for i, v in rows]
    fit = sorted({tuple(v) for _, v in whole})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[float((n * a - s) / n) for a, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = sum(sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in fit) / n**3
    k = int((values > 1e-12 * values[0]).sum()) if values[0] > 0 else 0
    assert len(found) == len(rows) * k
    want = []
    for i, v in whole:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        w = np.array([float((n * a - s) / n) for a, s in zip(v, sums, strict=True)]) @ axes[:, :k] / np.sqrt(values[:k])
        want += [(-1 if i is None else i, c + 1, dev, abs(w[c])) for c in range(k)]
    got = [(-1 if r.vec_id is None else r.vec_id, r.component, r.deviation if r.deviation is not None else int(r.deviation_text), abs(r.whitened)) for r in found]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < near
    for r in found:
        assert r.n == n and abs(r.explained / (values[r.component - 1] / trace) - 1) < 1e-9 and r.identity_error < 1e-8


def test_given_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    found = QUERIES["op13_whitening"](spark, DATA).collect()
    compare(found, rows)
    sign = {}
    for r in found:  # one sign for all rows: the components are uncorrelated as they stand
        sign.setdefault(r.component, []).append((r.vec_id, r.whitened))
    w = np.array([[x for _, x in sorted(v)] for _, v in sorted(sign.items())])
    assert np.abs(np.cov(w, bias=True) - np.eye(4)).max() < 1e-9


def test_odd_vectors_copies_and_extra_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 6)) * [5, 4, 3, 2, 1, 1] + 1000)]
    rows += [(None, rows[0][1]), (7, rows[7][1]), (61, rows[1][1][:3]), (62, [])] + [(100 + i, rows[2][1]) for i in range(50)]
    compare(whitening.whiten(table(spark, rows + ODD)).collect(), rows)


def test_few_dimensions_give_few_components(spark):
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]
    compare(whitening.whiten(table(spark, line)).collect(), line)
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whiten(table(spark, [(1, [])])).collect() == []
    assert whitening.whiten(table(spark, ODD)).collect() == []
    assert whitening.whiten(table(spark, [])).collect() == []


def test_entries_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a) * 1e9 + 1e15, float(b) * 1e6, float(c)]) for i, (a, b, c) in enumerate(rng.standard_normal((30, 3)))]
    found = whitening.whiten(table(spark, rows)).collect()
    compare(found, rows, components=3)
    assert any(r.deviation is None for r in found)
    most = whitening.whiten(table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 0.0])])).collect()  # the nearest longs
    assert [(r.vec_id, abs(round(r.whitened, 9))) for r in most] == [(1, 1.0), (2, 1.0)]


def test_exact_deviations_on_each_path():
    rng = np.random.default_rng(5)
    for top in (100, 1 << 20, 1 << 27, 1 << 40, 1 << 62):
        x = rng.integers(-top, top, (20, 5))
        sums = [sum(c) for c in zip(*x.tolist(), strict=True)]
        want = [sum((20 * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x.tolist()]
        assert [int(d) for d in whitening.Centre(20, sums).deviations(x)] == want


@pytest.mark.parametrize(("dims", "shape"), [(300, "falling"), (300, "flat"), (300, "low rank"), (300, "one value"), (5, "falling"), (1, "falling"), (300, "none")])
def test_lanczos_restarts_and_breakdowns(dims, shape):
    rng = np.random.default_rng(6)
    values = {"falling": 0.95 ** np.arange(dims), "flat": 1 + 1e-3 * rng.random(dims), "low rank": np.r_[3.0, 2.0, 1.0, np.zeros(dims - 3)] if dims > 3 else np.ones(dims), "one value": np.full(dims, 2.0), "none": np.zeros(dims)}[shape]
    q, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    v = (q * values) @ q.T
    got, axes, passes = whitening.leading(lambda b: v @ b, dims, 4, most=64)
    want = np.sort(values)[::-1][:4]
    assert np.abs(got - want).max() <= 1e-12 and np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-12
    assert np.abs(v @ axes - axes * got).max() < 1e-11 and passes < whitening.PASSES
