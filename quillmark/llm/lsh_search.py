"""Approximate nearest neighbours: multiprobe p-stable hashing, candidates of all tables reranked by exact inner product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import mix, stored

K = 20
TABLES = 2
#: Hashes of a table at most; fewer where there are fewer dimensions to tell apart.
HASHES = 32
#: Chance, for a neighbour as near as the k-th is expected to be, that some table's probes reach it.
TARGET = 0.9
#: Chance that a query's k-th neighbour is as near as is expected, at least.
SURE = 0.99
#: Width of a hash's slots, in standard deviations of a projection.
WIDTH = 1.0
#: The first hashes of a table name a cell: so many at most, of so many rows about, and a query's cells hold this share of the chances.
CELL_HASHES, CELL, CELL_SHARE = 6, 1024, 0.97
#: Rows of a part of a table at most, which one task searches at a time, and parts to aim at where that makes them smaller.
PART, PARTS = 8192, 24
#: Queries that are scored together.
RUN = 256
#: Vectors that the fit takes: those of the smallest hashes of vec_id.
SAMPLE = 4096
#: Rows of the sample that stand for a query's neighbours, and slots of a hash that probes leave out as too unlikely.
STAND, TAIL = 64, 1e-4


def parsed(vectors: pd.Series, ids: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors (doubles) that take part: not null, zero or with a null or a number that isn't finite."""
    own, out = [], []
    for i, v in zip(ids, vectors, strict=True):
        if v is None or i is None or pd.isna(i):
            continue
        x = np.asarray(v, dtype=np.float64)  # a null becomes a NaN
        if len(x) and np.isfinite(x).all() and x.any():
            own.append(int(i))
            out.append(x)
    return np.array(own, dtype=np.int64), out


def matrix(rows: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for r, x in enumerate(rows):
        out[r, : len(x)] = x[:dims]
    return out


def phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    tail = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return np.where(x > 0, 1 - tail, tail)


class Hashes:
    """Hash functions of all tables: slots of normal projections, which are at right angles where there are dimensions enough.

    A vector x of length up to `longest` is put on a sphere by one more component, so that the
    nearest by distance is the one with the largest inner product; a query is stretched onto it,
    with 0 there. A bucket is the slots of all of a table's hashes, a cell all buckets that share the first ones.
    """

    def __init__(self, dims: int, longest: float, first: int, hashes: int = HASHES, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.dims, self.longest = dims, longest
        self.hashes = max(1, first, min(hashes, (dims + 1) // TABLES))
        self.first = first
        a = rng.standard_normal((dims + 1, TABLES * self.hashes))
        if a.shape[1] <= dims + 1:
            a = np.linalg.qr(a)[0] * math.sqrt(dims + 1)
        self.a = a
        self.b = rng.uniform(0, WIDTH, TABLES * self.hashes)
        self.odd = mix(np.arange(1, TABLES * (first + 1) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)
        self.mean, self.spread = np.zeros(TABLES * self.hashes), np.ones(TABLES * self.hashes)

    def of(self, table: int) -> slice:
        return slice(table * self.hashes, (table + 1) * self.hashes)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Projections of rows."""
        scale = np.abs(x).max(initial=0.0) or 1.0  # so that squares stay finite
        rest = np.sqrt(np.maximum(0.0, (self.longest / scale) ** 2 - ((x / scale) ** 2).sum(axis=1))) * scale
        return np.column_stack([x, rest]) / self.longest @ self.a

    def slots(self, projected: np.ndarray) -> np.ndarray:
        return np.floor((projected + self.b) / WIDTH)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries of length 1."""
        return q @ self.a[:-1]

    def learn(self, x: np.ndarray) -> None:
        """Take mean and spread of each hash's slots, over a sample, as what rows in general are like."""
        if len(x) > 1:
            centre = self.centres(self.slots(self.lifted(x)))
            self.mean, self.spread = centre.mean(axis=0), np.maximum(centre.std(axis=0), 0.3 * WIDTH)

    def cells(self, slots: np.ndarray, table: int) -> np.ndarray:
        """64-bit names of cells from the slots of a table's first hashes (rows by hashes)."""
        odd = self.odd[table * (self.first + 1) : (table + 1) * (self.first + 1)]
        return mix((slots.astype(np.int64).view(np.uint64) * odd[:-1]).sum(axis=1, dtype=np.uint64) + odd[-1]).view(np.int64)

    def probes(self, middle: np.ndarray, noise: float, table: int) -> np.ndarray:
        """The cells to visit for one query, in order of estimated success: CELL_SHARE of the chances.

        A neighbour's projections are normal around `middle`, which gives each slot's chance and,
        multiplied, each cell's. Cells differ from the likeliest in as many slots as that takes.
        """
        slots, chance = np.zeros((1, 0)), np.ones(1)
        for h in range(table * self.hashes, table * self.hashes + self.first):
            low, high = (math.floor((middle[h] + d * 4.5 * noise + self.b[h]) / WIDTH) for d in (-1, 1))
            s = np.arange(low, high + 1)
            c = np.diff(phi(((np.append(s, high + 1) * WIDTH - self.b[h]) - middle[h]) / noise))
            s, c = s[c > TAIL], c[c > TAIL]
            slots = np.column_stack([np.repeat(slots, len(s), axis=0), np.tile(s, len(slots))])
            chance = np.multiply.outer(chance, c).ravel()
            # what no later step could bring back among the likeliest
            order = np.argsort(-chance, kind="stable")
            keep = order[: 1 + int(np.searchsorted(np.cumsum(chance[order]), 1 - (1 - CELL_SHARE) / (4 * self.first)))]
            slots, chance = slots[keep], chance[keep]
        order = np.argsort(-chance, kind="stable")
        return self.cells(slots[order[: 1 + int(np.searchsorted(np.cumsum(chance[order]), CELL_SHARE))]], table)

    def centres(self, slots: np.ndarray) -> np.ndarray:
        """The middle of each slot, for all hashes."""
        return (slots + 0.5) * WIDTH - self.b

    def usual(self, centre: np.ndarray, at: slice) -> np.ndarray:
        return (((centre - self.mean[at]) / self.spread[at]) ** 2).sum(axis=-1) / 2

    def success(self, slots: np.ndarray, middle: np.ndarray, noise: np.ndarray, table: int) -> np.ndarray:
        """By the table's part of the queries' middles: how much likelier each bucket (columns) is to hold a neighbour of each query (rows) than rows in general: a logarithm, which orders the buckets."""
        at = self.of(table)
        centre = (slots + 0.5) * WIDTH - self.b[at]
        far = (middle * middle).sum(axis=1)[:, None] - 2 * middle.astype(np.float32) @ centre.T.astype(np.float32) + (centre * centre).sum(axis=1)
        return self.usual(centre, at)[None, :] - far / (2 * noise[:, None] ** 2)


class Expected:
    """What a query's neighbours are like, from the query's own inner products with a sample of the vectors.

    Of the k nearest the sample holds a binomial number. The sample's vector one place beyond all
    that this may be (but for 1 - SURE) is no nearer than the k-th neighbour, whatever the other
    queries' neighbours are like. The STAND nearest of the sample, moved towards the query until
    they are that near, stand for the neighbours.
    """

    def __init__(self, made: Hashes, ids: np.ndarray, x: np.ndarray, share: float, k: int):
        self.made, self.ids, self.x = made, ids, (x / made.longest).astype(np.float32)
        self.centre = made.centres(made.slots(made.lifted(x))).astype(np.float32)
        chance = np.cumsum([math.comb(k, b) * share**b * (1 - share) ** (k - b) for b in range(k + 1)])
        self.place = min(k, 1 + int(np.searchsorted(chance, SURE)))

    def neighbours(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query the middle of its neighbours' projections, their noise, and for each table the success below which
        buckets aren't visited: the table's share of TARGET of the neighbours lies above it."""
        q = q / np.abs(q).max(axis=1, keepdims=True)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        p = self.made.asked(q)
        cosine = q.astype(np.float32) @ self.x.T
        cosine[ids[:, None] == self.ids] = -2
        some = min(STAND, cosine.shape[1])
        if self.place >= cosine.shape[1] or some < 2:  # so few rows tell nothing: every bucket is visited
            return p, np.ones(len(q)), np.full((len(q), TABLES), -np.inf)
        nearest = np.argpartition(-cosine, some - 1, axis=1)[:, :some]
        c = np.take_along_axis(cosine, nearest, axis=1)
        near = -np.partition(-cosine, self.place - 1, axis=1)[:, self.place - 1]
        at = self.centre[nearest] + np.maximum(0, near[:, None] - c)[:, :, None] * p[:, None, :]
        own = c < -1.5  # the query itself, in a small sample: its nearest stands in
        at[own] = at[np.nonzero(own)[0], np.argmax(c, axis=1)[np.nonzero(own)[0]]]
        middle = at.mean(axis=1)
        noise = np.maximum(np.sqrt(at.var(axis=1).mean(axis=1)), 0.3 * WIDTH)
        share = min(1.0, 1 - (1 - TARGET) ** (1 / TABLES) + 1 - CELL_SHARE)
        least = np.empty((len(q), TABLES))
        for t in range(TABLES):
            own = self.made.of(t)
            far = ((at[:, :, own] - middle[:, None, own]) ** 2).sum(axis=2) * (some / (some - 1)) ** 2  # as if each had no part in the middle
            least[:, t] = np.quantile(self.made.usual(at[:, :, own], own) - far / (2 * noise[:, None] ** 2), 1 - share, axis=1) - 1e-2
        return middle, noise, least


def fit(vectors: DataFrame, k: int) -> tuple[Hashes, Expected, int]:
    """Hash functions for these vectors, what nearness to expect, and how many vectors take part.

    Counts and the greatest length are those of all rows; the sample has SAMPLE vec_ids, each once.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            _, rows = parsed(pdf["embedding"], pdf["vec_id"])
            yield pd.DataFrame({"n": [len(rows)], "dims": [max(map(len, rows), default=0)], "longest": [max((float(np.abs(r).max() * np.linalg.norm(r / np.abs(r).max())) for r in rows), default=0.0)]})

    total = vectors.mapInPandas(measure, "n long, dims long, longest double").agg(F.sum("n"), F.max("dims"), F.max("longest")).first()
    n, dims, longest = total[0] or 0, total[1] or 1, total[2] or 1.0
    every = vectors.select("vec_id").where("vec_id is not null").distinct()
    some = every.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    sample = vectors.join(F.broadcast(some), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).toPandas()  # SAMPLE rows at most
    ids, rows = parsed(sample["embedding"], sample["vec_id"])
    x = matrix(rows, dims)
    made = Hashes(dims, longest * (1 + 1e-12), int(min(CELL_HASHES, max(0, round(math.log2(max(1, n / CELL)) / 2.05)))))
    made.learn(x)
    return made, Expected(made, ids, x, min(1.0, len(sample) / max(1, every.count())), k), n


class Part:
    """Rows of one part of a table, and the search of queries among them."""

    def __init__(self, made: Hashes, table: int, rows: pd.DataFrame):
        rows = rows.drop_duplicates(["vec_id", "vector"]).sort_values("vec_id", kind="stable")
        self.made, self.table = made, table
        self.ids = rows["vec_id"].to_numpy()
        self.x = np.frombuffer(b"".join(rows["vector"]), dtype=np.float64).reshape(len(rows), -1)
        slots = made.slots(made.lifted(self.x))[:, made.of(table)]
        self.names, self.cell = np.unique(made.cells(slots[:, : made.first], table), return_inverse=True)
        self.slots, self.bucket = np.unique(slots, axis=0, return_inverse=True)
        self.bucket = self.bucket.ravel()

    def search(self, asked: pd.DataFrame, k: int) -> pd.DataFrame:
        """(query_id, vec_id, score, candidates) of the k best candidates of each query; candidates, on the first row of each query, is how many there were."""
        own = asked["vec_id"].to_numpy()
        q = np.frombuffer(b"".join(asked["vector"]), dtype=np.float64).reshape(len(asked), -1)
        middle = np.frombuffer(b"".join(asked["middle"]), dtype=np.float32).reshape(len(asked), -1)
        visited = np.zeros((len(asked), len(self.names) + 1), dtype=bool)
        for r, b in enumerate(asked["cells"]):
            wanted = np.frombuffer(b, dtype=np.int64)
            found = np.searchsorted(self.names, wanted)
            found[found < len(self.names)] = np.where(self.names[found[found < len(self.names)]] == wanted[found < len(self.names)], found[found < len(self.names)], len(self.names))
            visited[r, found] = True
        good = self.made.success(self.slots, middle, asked["noise"].to_numpy(), self.table) >= asked["least"].to_numpy()[:, None]
        r, c = np.nonzero(good[:, self.bucket] & visited[:, self.cell] & (self.ids[None, :] != own[:, None]))
        score = np.empty(len(r))
        for at in range(0, len(r), 1 << 16):
            score[at : at + (1 << 16)] = np.einsum("ij,ij->i", q[r[at : at + (1 << 16)]], self.x[c[at : at + (1 << 16)]])
        order = np.lexsort((self.ids[c], -score, r))
        r, ids, score = r[order], self.ids[c[order]], score[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        if len(ids) and (np.diff(self.ids) == 0).any():  # other vectors of an id that is there already: k different ids are kept
            first = ~pd.DataFrame({"r": r, "id": ids}).duplicated().to_numpy()
            before = np.cumsum(first) - first
            place = before - before[np.searchsorted(r, r)]
            keep = first & (place < k)
        else:
            keep = rank < k
        candidates = np.where(rank == 0, np.bincount(r, minlength=len(own))[r], 0)
        return pd.DataFrame({"query_id": own[r[keep]], "vec_id": ids[keep], "score": score[keep], "candidates": candidates[keep]})


def search(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score, candidates: for each row whose vec_id is divisible by `every` the k largest inner products found with other rows.

    Every row is indexed. Vectors that are null, zero or hold a null or a number that isn't
    finite take no part, nor do rows of null vec_id; a shorter vector is filled with zeros. Ties
    go to smaller vec_id. Rows that repeat a vec_id are candidates once, with their best score;
    as queries the first in order of its components counts. candidates: how many rows of all
    tables were scored for the query.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    made, expected, n = fit(vectors, k)
    sent = vectors.sparkSession.sparkContext.broadcast(expected)
    rows_of_part = max(256, min(PART, n // PARTS))
    parts = max(1, -(-n // rows_of_part))

    def table_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = parsed(pdf["embedding"], pdf["vec_id"])
            x = matrix(rows, made.dims)
            slots = made.slots(made.lifted(x))
            for t in range(TABLES):
                cell = made.cells(slots[:, made.of(t)][:, : made.first], t)
                # a vec_id that repeats a vector needs it once
                yield pd.DataFrame({"t": np.int32(t), "cell": cell, "vec_id": ids, "vector": [r.tobytes() for r in x]}).drop_duplicates(["vec_id", "vector"])

    tables, _ = stored(vectors.mapInPandas(table_rows, "t int, cell long, vec_id long, vector binary"))
    # a cell of more rows than a part is divided; there are CELL_HASHES slots to the power of its length at most
    counts = tables.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_of_part).collect()
    large = {r.cell: -(-r.n // rows_of_part) for r in counts}

    def part_of(table: int, cell: np.ndarray, piece: np.ndarray) -> np.ndarray:
        return (mix(cell.view(np.uint64) + piece.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int32) * TABLES + table

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t, own in pdf.groupby("t"):
                cell, ids = own["cell"].to_numpy(), own["vec_id"].to_numpy()
                pieces = np.array([large.get(b, 1) for b in cell.tolist()], dtype=np.uint64)
                part = part_of(t, cell, mix(ids.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) % pieces)
                yield pd.DataFrame({"part": part, "asks": False, "vec_id": ids, "vector": own["vector"], "cells": None, "middle": None, "noise": 0.0, "least": 0.0})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, rows = parsed(pdf["embedding"], pdf["vec_id"])
            for at in range(0, len(ids), RUN):
                q = matrix(rows[at : at + RUN], made.dims)
                middle, noise, least = sent.value.neighbours(ids[at : at + RUN], q)
                for t in range(TABLES):
                    sent_to: list[tuple[np.ndarray, list[bytes]]] = []
                    for r in range(len(q)):
                        wanted = made.probes(middle[r], noise[r], t)
                        many = np.array([large.get(b, 1) for b in wanted.tolist()])
                        wanted, piece = np.repeat(wanted, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        part = part_of(t, wanted, piece)
                        order = np.argsort(part, kind="stable")
                        cuts = np.flatnonzero(np.diff(part[order])) + 1
                        sent_to.append((part[order][np.append(0, cuts)], [np.unique(g).tobytes() for g in np.split(wanted[order], cuts)]))
                    r = np.repeat(np.arange(len(q)), [len(x) for x, _ in sent_to])
                    vector, own_middle = [x.tobytes() for x in q], [x.astype(np.float32).tobytes() for x in middle[:, made.of(t)]]
                    yield pd.DataFrame(
                        {
                            "part": np.concatenate([x for x, _ in sent_to]), "asks": True, "vec_id": ids[at : at + RUN][r], "vector": [vector[i] for i in r], "cells": [c for _, x in sent_to for c in x],
                            "middle": [own_middle[i] for i in r], "noise": noise[r], "least": least[r, t],
                        }
                    )

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, searched = None, [], None
        for pdf in batches:
            for part, own in pdf.groupby("part", sort=True):  # sorted, and a part's rows come before its queries
                if part != now:
                    now, rows, searched = part, [], None
                rows.append(own[~own["asks"]])
                asked = own[own["asks"]]
                if len(asked) and sum(map(len, rows)):
                    if searched is None:
                        searched = Part(made, int(part) % TABLES, pd.concat(rows))
                    for at in range(0, len(asked), RUN):
                        yield searched.search(asked.iloc[at : at + RUN], k)

    kind = "part int, asks boolean, vec_id long, vector binary, cells binary, middle binary, noise double, least double"
    one = F.row_number().over(Window.partitionBy("vec_id").orderBy("embedding"))
    chosen = vectors.where(F.col("vec_id") % every == 0).withColumn("__n", one).where("__n = 1").drop("__n")
    chosen = chosen.repartition(max(1, -(-n // (every * RUN))), "vec_id")  # finding a query's buckets takes longer than reading it
    both = tables.mapInPandas(dealt, kind).unionByName(chosen.mapInPandas(ask, kind))
    best = both.repartition("part").sortWithinPartitions("part", "asks").mapInPandas(answer, "query_id long, vec_id long, score double, candidates long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("candidates").alias("candidates"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    candidates = F.sum("candidates").over(Window.partitionBy("query_id"))
    return best.withColumn("candidates", candidates).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "candidates")


def op1_lsh_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
