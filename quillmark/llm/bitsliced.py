"""Exact top-k search with a bit-sliced index: quantised attributes as bitmaps, added up slice by slice."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import stored

K = 5
SCALE = 256
#: Rows of an index block, bits of its slices at most (but for 64 rows), and queries that are answered together.
BLOCK = 10_240
BITS = 1 << 27
LANE = 2048
#: Blocks are searched in so many groups; a group's best rows are merged before they are shuffled.
GROUPS = 64
#: Rows with a larger quantised component get blocks of their own, as one of them gives its whole block more slices.
NARROW = 1 << 24
LONG = 1 << 63


def quantised(vectors: pd.Series, ids: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """(ids, integers): floor(SCALE * x) of the vectors that take part, exactly: 64-bit numbers or, where they don't fit, Python's."""
    own, found = [], []
    for i, v in zip(ids, vectors, strict=True):
        if v is None or i is None or pd.isna(i):
            continue
        x = np.asarray(v, dtype=np.float64)  # a null becomes a NaN
        if not np.isfinite(x).all():
            continue
        own.append(int(i))
        if (np.abs(x) < 2.0**54).all():
            found.append(np.floor(SCALE * x).astype(np.int64))
        else:  # times a power of two is exact, and such a large number is whole
            found.append(np.array([math.floor(SCALE * c) if abs(c) < 2.0**54 else SCALE * int(c) for c in x.tolist()], dtype=object))
    return np.array(own, dtype=np.int64), found


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """The rows, short ones filled with zeros."""
    kind = object if any(r.dtype == object for r in rows) else np.int64
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=kind)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def packed(x: np.ndarray) -> bytes:
    """The numbers after a letter that names their type, the narrowest that holds all: they are copied for every group of blocks."""
    if x.dtype == object:
        return b"w" + " ".join(map(str, x.ravel().tolist())).encode()
    low, high = x.min(initial=0), x.max(initial=0)
    kind = next(k for k in "bhiq" if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind.encode() + x.astype(kind).tobytes()


def unpacked(data: bytes, rows: int, dims: int) -> np.ndarray:
    if data[:1] == b"w":
        return np.array([int(c) for c in data[1:].split()], dtype=object).reshape(rows, dims)
    return np.frombuffer(data, dtype=data[:1].decode(), offset=1).reshape(rows, dims).astype(np.int64)


class Block:
    """Bit slices of up to BLOCK rows: bit r of slice (d, b) is bit b of row r's component d, less the block's lowest."""

    def __init__(self, ids: np.ndarray, low: int, slices: np.ndarray):
        self.ids, self.low, self.slices = ids, low, slices

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Block:
        low = int(x.min(initial=0))
        width = max(1, (int(x.max(initial=0)) - low).bit_length())
        words = -(-len(ids) // 64)
        u = np.zeros((words * 64, x.shape[1]), dtype=x.dtype)
        u[: len(ids)] = x - low
        bits = np.empty((x.shape[1], width, words * 64), dtype=np.uint8)
        for b in range(width):
            bits[:, b] = (u.T >> b) & 1
        return cls(ids, low, np.packbits(bits, axis=-1, bitorder="little").view(np.uint64))

    def pack(self) -> tuple[bytes, str, int, int, bytes]:
        d, width, _ = self.slices.shape
        return self.ids.tobytes(), str(self.low), d, width, self.slices.tobytes()

    @classmethod
    def unpack(cls, ids: bytes, low: str, dims: int, width: int, slices: bytes) -> Block:
        own = np.frombuffer(ids, dtype=np.int64)
        return cls(own, int(low), np.frombuffer(slices, dtype=np.uint64).reshape(dims, width, -1 if dims else 0))

    def ready(self) -> None:
        """Slices by weight, followed by their complements for negative factors."""
        if not hasattr(self, "both"):
            turned = np.ascontiguousarray(self.slices.transpose(1, 0, 2))
            self.both = np.concatenate([turned, ~turned], axis=1)

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of every row's sum of factors times components, and what is to be added to it: carry-save addition of shifted slices.

        There are as many slices as the sum needs; they hold it whatever its size.
        """
        self.ready()
        dims, width, words = self.slices.shape
        q = np.concatenate([q, np.zeros(max(0, dims - len(q)), q.dtype)])[:dims]
        size, sign = np.abs(q), (q < 0).astype(bool)
        offset = self.low * sum(q.tolist()) - sum(size[sign].tolist()) * ((1 << width) - 1)
        column: dict[int, list[np.ndarray]] = {}
        for b in range(int(size.max(initial=0)).bit_length()):
            at = np.flatnonzero(((size >> b) & 1).astype(bool))
            if not len(at):
                continue
            at = at + dims * sign[at]
            for s in range(width):
                column.setdefault(b + s, []).append(self.both[s][at])
        out: list[np.ndarray] = []
        c = 0
        while column:
            x = np.concatenate(column.pop(c, [np.zeros((0, words), np.uint64)]))
            while len(x) > 1:
                t = len(x) // 3
                if t:
                    a, b, d = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                    ab = a ^ b
                    column.setdefault(c + 1, []).append((a & b) | (ab & d))
                    x = np.concatenate([ab ^ d, x[3 * t :]])
                else:
                    column.setdefault(c + 1, []).append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
            out.append(x[0] if len(x) else np.zeros(words, np.uint64))
            c += 1
        return out, offset

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """(ids, scores) of the k best rows but the query's own: slices narrow the rows down, ties go to smaller ids."""
        slices, offset = self.scores(q)
        bits = np.zeros(self.slices.shape[2] * 64, dtype=np.uint8)
        bits[: len(self.ids)] = self.ids != own
        open_ = np.packbits(bits, bitorder="little").view(np.uint64)
        sure = np.zeros_like(open_)
        taken = 0
        for s in reversed(slices):
            high = open_ & s
            n = int(np.bitwise_count(high).sum())
            if taken + n > k:
                open_ = high
            else:
                sure |= high
                taken += n
                open_ = open_ & ~s
                if taken == k:
                    break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if taken < k:
            tied = np.flatnonzero(np.unpackbits(open_.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, tied[np.argsort(self.ids[tied], kind="stable")[: k - taken]]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        score = [offset] * len(rows)
        for b, s in enumerate(slices):
            score = [x + (y << b) for x, y in zip(score, ((s[word] >> bit) & np.uint64(1)).tolist(), strict=True)]
        return self.ids[rows], score


def index(vectors: DataFrame) -> DataFrame:
    """Blocks (block, ids, low, dims, width, slices) of all rows of (vec_id, embedding) that take part."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = quantised(pdf["embedding"], pdf["vec_id"])
            large = np.array([max(map(abs, r.tolist()), default=0).bit_length() if r.dtype == object or (np.abs(r) >= NARROW).any() else 0 for r in rows], dtype=np.int64)
            for some in (np.flatnonzero(large == 0), np.flatnonzero(large)):
                if len(some):
                    x = matrix([rows[i] for i in some])
                    width = int(large[some].max()) + 1 or 1
                    size = max(64, min(BLOCK, (1 << 20) // max(1, x.shape[1]), BITS // max(1, x.shape[1] * width) // 64 * 64))
                    for at in range(0, len(some), size):
                        own = ids[some[at : at + size]]
                        yield pd.DataFrame([(int(own[0]), *Block.of(own, x[at : at + size]).pack())], columns=["block", "ids", "low", "dims", "width", "slices"])

    return vectors.select("vec_id", "embedding").mapInPandas(build, "block long, ids binary, low string, dims int, width int, slices binary")


def bounded(ids: np.ndarray, found: list[tuple[np.ndarray, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score, below) of what a block's queries found; below: the score is less than a long can be. One that is more raises an error."""
    flat = [s for _, scores in found for s in scores]
    if max(flat, default=0) >= LONG:
        raise OverflowError(f"the inner product {max(flat)} is no 64-bit number")
    below = np.array([s < -LONG for s in flat], dtype=bool)
    score = np.array([max(s, -LONG) for s in flat], dtype=np.int64)
    return np.repeat(ids, [len(i) for i, _ in found]), np.concatenate([i for i, _ in found]), score, below


def merged(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, ids, score, below = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((ids, ~score, query))  # ~ turns the order around and can't overflow
    query, ids, score, below = query[order], ids[order], score[order], below[order]
    first = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(query)), 0)) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - start < k
    return query[keep], ids[keep], score[keep], below[keep]


COLUMNS = ("query_id", "vec_id", "score", "below")


def search(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k largest integer inner products with other rows.

    Components are floor(256 * x), exactly and of any size; a shorter vector is filled with zeros.
    Vectors that are null, hold a null or a number that isn't finite take no part, nor do rows of
    null vec_id. Ties go to smaller vec_id. Rows that repeat a vec_id are candidates each, but never
    of the query with this id; as queries the first of them in order of its components counts. A
    score among the k best that no long can hold is an error.
    """
    blocks, _ = stored(index(vectors))
    n_blocks = blocks.count()
    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id") % every == 0)
    lanes = max(1, -(-chosen.count() // LANE))

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = quantised(pdf["embedding"], pdf["vec_id"])
            own = np.abs(ids // every) % lanes
            for lane in np.unique(own):
                some = np.flatnonzero(own == lane)
                x = matrix([rows[i] for i in some])
                yield pd.DataFrame([(int(lane), ids[some].tobytes(), x.shape[1], packed(x))], columns=["lane", "q_ids", "q_dims", "q"])

    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    queries = chosen.withColumn("__n", one).where("__n = 1").drop("__n").mapInPandas(group, "lane int, q_ids binary, q_dims int, q binary")
    groups = max(1, min(GROUPS, 4 * n_blocks))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shared = blocks.withColumn("part", F.pmod(F.hash("block"), F.lit(groups))).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, found = None, []
        kept: tuple | None = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if found and last != (r.lane, r.part):
                    yield pd.DataFrame(dict(zip(COLUMNS, found, strict=True)))
                    found = []
                last = (r.lane, r.part)
                if kept is None or kept[0] != (r.block, r.ids):
                    kept = ((r.block, r.ids), Block.unpack(r.ids, r.low, r.dims, r.width, r.slices))
                ids = np.frombuffer(r.q_ids, dtype=np.int64)
                got = bounded(ids, [kept[1].top(q, int(own), k) for q, own in zip(unpacked(r.q, len(ids), r.q_dims), ids, strict=True)])
                found = merged([found, got] if found else [got], k)
        if found:
            yield pd.DataFrame(dict(zip(COLUMNS, found, strict=True)))

    # Spark's estimates know nothing of the copies that explode makes, so it would send all of them through the driver
    pairs = shared.join(asked.hint("merge"), ["lane", "part"]).select("lane", "part", "block", "ids", "low", "dims", "width", "slices", "q_ids", "q_dims", "q")
    best = pairs.mapInPandas(answer, "query_id long, vec_id long, score long, below boolean")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    score = F.when(F.col("below"), F.raise_error(F.lit("an inner product is no 64-bit number")).cast("long")).otherwise(F.col("score"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op3_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
    SELECT vec_id AS query_id, e FROM v WHERE vec_id % 50 = 0
), s AS (
    SELECT q.query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM q JOIN v ON v.vec_id <> q.query_id
), r AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
