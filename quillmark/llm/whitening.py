"""Embedding whitening: leading components by block Lanczos, whose products with the covariance are Spark passes over the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import stored

SCALE = 256
COMPONENTS = 4
#: Vectors of a block, and columns that the basis may have before it is restarted from its best ones.
WIDTH = 16
MOST = 128
#: A residual is small at this share of the largest eigenvalue; passes that may be needed for it.
SMALL = 1e-13
PASSES = 400
#: A column that keeps less than this share of the largest norm once the basis is taken out of it is replaced by a random one.
BROKEN = 1e-12
_WIDE = 1 << 61
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


def integers(embedding: Column) -> Column:
    """floor(256 * c) of each entry as a long (the nearest one, if it is beyond them), null for a vector with a null or an entry that isn't finite."""
    entries = F.transform(embedding, lambda c: c.cast("double"))
    odd = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(math.inf)))
    return F.when(~odd, F.transform(entries, lambda c: F.floor(c * SCALE)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


class Centre:
    """The fit list's mean, exactly: a whole part and a fraction for each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole, self.rest = n, [s // n for s in sums], [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])
        self.wide = any(abs(w) >= _WIDE for w in self.whole)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """x less the mean's whole part, exactly: 64-bit numbers or, where they might not fit, Python's."""
        if self.wide or x.size and (int(x.max()) >= _WIDE or int(x.min()) <= -_WIDE):
            return x.astype(object) - np.array(self.whole, dtype=object)
        return x - np.array(self.whole, dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """The sum over dimensions of (n * x - S) ** 2 of each row, exactly."""
        y = self.offsets(x)
        dims = max(1, x.shape[1])
        bound = self.n * (1 + max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))))
        limb = (62 - dims.bit_length()) // 2
        if y.dtype == object or bound >= 1 << 2 * limb:
            z = y.astype(object) * self.n - np.array(self.rest, dtype=object)
            return [sum(c * c for c in row) for row in z.tolist()]
        z = np.abs(y * self.n - np.array(self.rest, dtype=np.int64))
        if dims * bound * bound < 1 << 63:
            return (z * z).sum(axis=1)
        high, low = z >> limb, z & ((1 << limb) - 1)
        parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
        return [(int(a) << 2 * limb) + (int(b) << limb + 1) + int(c) for a, b, c in zip(*parts, strict=True)]


def totals(fit: DataFrame, of: Callable[[np.ndarray], np.ndarray], dims: int, size: int) -> np.ndarray:
    """The sum of of(x), `size` numbers, over blocks x of the fit list: a task adds up its blocks, Spark the tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            if b.num_rows:
                got = of(matrix(b.column(0), dims)).ravel()
                sums = got if sums is None else sums + got
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], ["at", "part"])

    out = np.zeros(size)
    for r in fit.select("x").mapInArrow(add, "at int, part double").groupBy("at").agg(F.sum("part").alias("total")).collect():  # `size` rows
        out[r["at"]] = r["total"]
    return out


def moments(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for b in batches:
            x = matrix(b.column(0), dims)
            n += len(x)
            if len(x):
                high, low = x >> 32, x & 0xFFFFFFFF  # neither half's sum can leave a long
                sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dims), pa.int32()), pa.array([str(v) for v in (n, *sums)])], ["at", "part"])

    found = fit.select("x").mapInArrow(add, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()  # dims + 1 rows
    got = {r["at"]: int(r["total"]) for r in found}
    return got.get(-1, 0), [got.get(i, 0) for i in range(dims)]


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator, scale: float) -> np.ndarray:
    """The block's columns made orthonormal to the basis and to each other; one with nothing new in it starts again at random."""
    made = basis
    columns = min(block.shape[1], basis.shape[0] - basis.shape[1])
    for j in range(columns):
        v, least = block[:, j], BROKEN * scale
        while True:
            before = v
            for _ in range(3):  # the whole basis each time
                v = v - made @ (made.T @ v)
            norm = np.linalg.norm(v)
            if norm > max(least, BROKEN * np.linalg.norm(before)):
                break
            v, least = rng.standard_normal(basis.shape[0]), 0.0
        v = v / norm
        v = v - made @ (made.T @ v)
        made = np.column_stack([made, v / np.linalg.norm(v)])
    return made[:, basis.shape[1] :]


def leading(times: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int = COMPONENTS, width: int = WIDTH, most: int = MOST) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest eigenvalues, falling, their unit vectors as columns, and the passes it took, of the symmetric matrix that times() multiplies with.

    Each pass multiplies a block; the products, made orthogonal to the whole basis twice and more,
    are the next block. It ends once the wanted residuals are small or the basis is the whole space.
    A full basis is replaced by its best vectors. An eigenvalue that occurs more often than a block
    is wide is found with as many vectors as were asked for.
    """
    rng = np.random.default_rng(13)
    wanted, width = min(wanted, dims), min(width, dims)
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    block = orthonormal(rng.standard_normal((dims, width)), basis, rng, 0.0)
    for passes in range(1, PASSES + 1):
        product = times(block)
        basis, image = np.hstack([basis, block]), np.hstack([image, product])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, moved = basis @ turn, image @ turn
        scale = max(abs(values[0]), abs(values[-1]))
        residuals = np.linalg.norm(moved[:, :wanted] - ritz[:, :wanted] * values[:wanted], axis=0)
        if basis.shape[1] == dims or basis.shape[1] >= wanted and (residuals <= SMALL * scale).all():
            return values[:wanted], ritz[:, :wanted] / np.linalg.norm(ritz[:, :wanted], axis=0), passes
        block = orthonormal(product, basis, rng, scale)
        if basis.shape[1] + block.shape[1] > max(most, 3 * width):
            keep = 2 * width
            basis, image = ritz[:, :keep], moved[:, :keep]
    raise RuntimeError(f"components did not settle in {PASSES} passes")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: every usable row on each leading component.

    Entries become longs, floor(256 * c). Rows whose vector is null or holds a null or an entry
    that isn't finite drop out; shorter vectors are filled with zeros. The fit list holds each
    different vector once, so copies weigh nothing in mean and covariance, but every row is
    returned, of null or repeated vec_id too. Components without variance are left out: fewer come
    out where the vectors span fewer dimensions, none for a single vector or an empty table.
    deviation is null where no long can hold it; deviation_text has its digits there. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x")).where("x is not null")
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return spark.createDataFrame([], OUT)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit, _ = stored(rows.select("x").distinct())
    n, sums = moments(fit, dims)
    centre = Centre(n, sums)

    def times(block: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return c.T @ (c @ block)

        return totals(fit, product, dims, block.size).reshape(block.shape) / n

    values, axes, _ = leading(times, dims, components)
    axes = axes[:, values > dims * 2.0**-50 * max(values[0], 0)]
    values = values[: axes.shape[1]]
    k = len(values)
    if not k:
        return spark.createDataFrame([], OUT)
    weights = axes / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = centre.centred(x) @ weights
        return np.concatenate([[(np.array(centre.deviations(x), dtype=np.float64) / n / n).sum()], w.sum(axis=0), (w.T @ w).ravel()])

    found = totals(fit, spread, dims, 1 + k + k * k) / n
    mean = found[1 : k + 1]
    error = float(np.abs(found[k + 1 :].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())
    explained = values / found[0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), dims)
            exact = centre.deviations(x)
            if isinstance(exact, np.ndarray):
                deviation, text = pa.array(exact), pa.nulls(len(x), pa.string())
            else:
                deviation, text = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()), pa.array([None if v < 1 << 63 else str(v) for v in exact], pa.string())
            every = np.repeat(np.arange(len(x)), k)
            own = pa.array(every)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(own), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(every), n, dtype=np.int64)),
                    deviation.take(own), pa.array((centre.centred(x) @ weights).ravel()), pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(every), error)), text.take(own),
                ],
                names=[c.split()[0] for c in OUT.split(", ")],
            )

    return rows.select("vec_id", "x").mapInArrow(project, OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
