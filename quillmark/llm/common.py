"""Helpers that the operators share: hashing whole texts with numpy, gapless positions, tables in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; bounds memory at about 40 bytes for each.
PIECE = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII characters that are no letters or digits, and white space.
PUNCT = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
#: Paths of the tables that stored() has written in this process.
WRITTEN: list[str] = []
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = powers(_P, PIECE * 2)
_POW_INV = powers(_P_INV, PIECE * 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def pieces(texts: Iterable[bytes], separators: np.ndarray = WHITE) -> Iterator[tuple[list[int], list[bytes]]]:
    """Groups of whole texts, about PIECE bytes each; a longer text goes in several groups, cut at separators."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = min(len(text), at + PIECE)
            while end < len(text) and not separators[text[end]]:
                end += 1
            if size and size + end - at > PIECE:
                yield ids, parts
                ids, parts, size = [], [], 0
            ids.append(i)
            parts.append(text[at:end])
            size += end - at + 1
            at = end
            if not text:
                break
    if ids:
        yield ids, parts


class Words:
    """Words of some texts joined with a space: start and end offsets, index of the part, and prefix sums for hashes."""

    def __init__(self, parts: list[bytes], separators: np.ndarray = WHITE):
        self.raw = np.frombuffer(b" ".join(parts), dtype=np.uint8)
        sep = np.ones(len(self.raw) + 2, dtype=bool)
        sep[1:-1] = separators[self.raw]
        edges = np.flatnonzero(sep[1:] != sep[:-1])
        self.start, self.end = edges[0::2], edges[1::2]
        lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        self.part = np.searchsorted(self.offset, self.start, side="right") - 1
        n = len(self.raw)
        if n >= len(_POW):
            self._pow, self._inv = powers(_P, n + 1), powers(_P_INV, n + 1)
        else:
            self._pow, self._inv = _POW, _POW_INV
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * self._pow[:n], out=self._sum[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """64-bit hashes of the bytes between offsets, by default of each word."""
        start = self.start if start is None else start
        end = self.end if end is None else end
        return mix((self._sum[end] - self._sum[start]) * self._inv[start])


def word_hashes(texts: list[bytes], separators: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words each text has."""
    found, counts = [], np.zeros(len(texts), dtype=np.int64)
    for ids, parts in pieces(texts, separators):
        w = Words(parts, separators)
        found.append(w.hashes())
        np.add.at(counts, ids, np.bincount(w.part, minlength=len(parts)))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), counts


def as_bytes(texts: pd.Series, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text; null gives an empty one."""
    if lower:
        return [t.lower().encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task shouldn't hold what its last one needed."""
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(pdf: pd.DataFrame, column: str, most: int = PIECE * 8) -> Iterator[pd.DataFrame]:
    """The rows of a batch in runs of bounded text size."""
    sizes = pdf[column].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy(dtype=np.int64)
    run = np.cumsum(sizes) // most if len(sizes) else sizes
    for _, part in pdf.groupby(run, sort=True):
        yield part
    give_back()


def runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of equal keys together, from batches sorted by keys."""
    rest: list[pd.DataFrame] = []
    last: tuple | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        columns = [pdf[k].to_numpy() for k in keys]
        new = np.zeros(len(pdf), dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if rest and key != last:
                yield pd.concat(rest, ignore_index=True)
                rest = []
            rest.append(pdf.iloc[a:b])
            last = key
    if rest:
        yield pd.concat(rest, ignore_index=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is set and all run in one process."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillmark-')}"
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows written as a table in the shared folder and read again, so later steps don't depend on lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def swept(spark: SparkSession, since: int, keep: str) -> None:
    """Delete all tables that stored() wrote since it had written `since`, but one."""
    for path in WRITTEN[since:]:
        if path != keep:
            forget(spark, path)
    WRITTEN[since:] = [keep]


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def bucket_of(column: Column, n: int) -> Column:
    """0 to n - 1 from the column's text; the same in any engine that has md5."""
    return (F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def with_position(df: DataFrame, group: str, cell: str, order: list[str], out: str, bounded: bool = False) -> DataFrame:
    """Add a gapless long position from 0 within each group: cells in order, then rows of a cell by order.

    Only the cells' counts are added up per group, so a group that holds most rows is still
    sorted cell by cell in many tasks. Nulls are ordinary values of group and cell. bounded: the
    caller bounds the numbers of groups and cells, so their counts may be sent everywhere.
    """
    counts = df.groupBy(F.col(group).alias("__g"), F.col(cell).alias("__c")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__g", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__before"))
    if bounded:
        counts = F.broadcast(counts)
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group, cell).orderBy(*order)).cast("long"))
    joined = ranked.join(counts, ranked[group].eqNullSafe(counts["__g"]) & ranked[cell].eqNullSafe(counts["__c"]))
    return joined.withColumn(out, F.col("__before") + F.col("__rank") - 1).drop("__g", "__c", "__before", "__rank")


def connected(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, label) for every id in the edges (a, b), of any type with an order: the smallest id of its connected component.

    Alternates large-star and small-star steps, which need rounds about logarithmic in the
    number of ids; each round is a table in the shared folder. Hubs are only ever reduced to minima.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select("a", "b").where("a <> b").distinct())
    total = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after, new = stored(small.where("a <> b").distinct())
        forget(spark, path)
        path, now = new, after
        both_hashes = (F.sum(F.xxhash64(*c).cast("decimal(38,0)")) for c in (("a", "b"), ("b", "a")))
        seen = now.agg(F.count(F.lit(1)), *both_hashes).first()  # equal for other edges with a chance of 2 ** -64 squared
        if tuple(seen) == total:
            break
        total = tuple(seen)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("id"), "label").distinct())
