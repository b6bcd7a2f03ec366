"""N-gram Jaccard self-join: MinHash bands find candidates, full shingle sets verify them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import as_bytes, connected, mix, powers, runs, slices, stored, word_hashes

WORDS = 5
#: Similarity from which two texts are linked: 4 / 5, compared in whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
RECALL = 0.999
#: Hash functions at most: more rows in a band make fewer false candidates, but need more bands for the same recall.
HASHES = 160
#: Texts of a block; a component of more texts is verified block against block.
BLOCK = 1024

_Q = powers(np.uint64(0xD6E8FEB86659FD93), WORDS + 1)


def banding(threshold: float = NUMERATOR / DENOMINATOR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows of each): the most rows whose bands find a pair at the threshold with at least the recall asked for."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word n-grams, repeats included, and how many each has.

    A text of fewer words has one shingle of them all; a text without words has the empty shingle.
    """
    w, n = word_hashes(texts)
    m = np.maximum(n - words + 1, 1)
    out = np.empty(int(m.sum()), dtype=np.uint64)
    long = n >= words
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    if long.any():
        rolled = np.zeros(len(w) - words + 1, dtype=np.uint64)
        for k in range(words):
            rolled += w[k : len(w) - words + 1 + k] * _Q[k]
        take = np.repeat(start[long], m[long]) + np.arange(int(m[long].sum())) - np.repeat(np.cumsum(m[long]) - m[long], m[long])
        out[np.repeat(long, m)] = mix(rolled[take])
    short = [mix(np.array([(w[a : a + k] * _Q[:k]).sum() + np.uint64(k)], dtype=np.uint64))[0] for a, k in zip(start[~long].tolist(), n[~long].tolist(), strict=True)]
    out[np.repeat(~long, m)] = np.array(short, dtype=np.uint64)
    return out, m


def band_hashes(texts: list[bytes], bands: int, rows: int) -> np.ndarray:
    """For each text the hash of each band of its MinHash signature."""
    s, m = shingles(texts)
    first = np.cumsum(m) - m
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    out = np.zeros((len(texts), bands), dtype=np.uint64)
    for b in range(bands):
        got = np.full(len(texts), b + 1, dtype=np.uint64)
        for r in range(rows):
            seed = seeds[b * rows + r]
            got = mix(got + np.minimum.reduceat((s ^ seed) * (seed | np.uint64(1)), first) * np.uint64(0x9FB21C651E98DF25))
        out[:, b] = got
    return out.view(np.int64)


def linked(texts: list[bytes], a: int) -> np.ndarray:
    """Which of the first `a` texts (rows) are similar to which of the others (columns); a = 0: all against all."""
    s, m = shingles(texts)
    doc = np.repeat(np.arange(len(texts)), m)
    vocabulary, column = np.unique(s, return_inverse=True)
    cell = np.unique(doc * len(vocabulary) + column)
    doc, column = cell // len(vocabulary), cell % len(vocabulary)
    size = np.bincount(doc, minlength=len(texts))
    held = np.bincount(column, minlength=len(vocabulary))
    middle = (held > 1) & (held < len(texts))  # shingles in one text only or in all need no matrix
    left, right = (slice(0, a), slice(a, None)) if a else (slice(None), slice(None))
    both = np.full((size[left].shape[0], size[right].shape[0]), float((held == len(texts)).sum()), dtype=np.float32)
    number = np.cumsum(middle) - 1
    keep = middle[column]
    doc, column = doc[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    step = max(256, (1 << 22) // max(len(texts), 1))
    for at in range(0, int(middle.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        dense = np.zeros((len(texts), step), dtype=np.float32)
        dense[doc[lo:hi], column[lo:hi] - at] = 1
        both += dense[left] @ dense[right].T
    same = both.astype(np.int64)
    return DENOMINATOR * same >= NUMERATOR * (size[left][:, None] + size[right][None, :] - same)


def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each text of a group its number of links there and the lowest text it is joined with."""
    for g in runs(batches, ["label", "i", "j"]):
        g = g.drop_duplicates("k").sort_values("k")
        if g["i"].iat[0] != g["j"].iat[0]:
            g = pd.concat([g[g["block"] == g["i"]], g[g["block"] == g["j"]]])
            a = int((g["block"] == g["i"]).sum())
        else:
            a = 0
        k = g["k"].to_numpy()  # bytes; places in the group stand for them
        texts = as_bytes(g["text"], lower=True)
        if len(k) < 2 or a == len(k):
            continue
        link = linked(texts, a)
        if a:
            counts = np.concatenate([link.sum(axis=1), link.sum(axis=0)])
        else:
            np.fill_diagonal(link, False)
            counts = link.sum(axis=1)
        low, top = np.arange(len(k)), len(k)
        while True:
            was = low.copy()
            if a:
                low[:a] = np.minimum(low[:a], np.where(link, low[None, a:], top).min(axis=1))
                low[a:] = np.minimum(low[a:], np.where(link, low[:a, None], top).min(axis=0))
            else:
                low = np.minimum(low, np.where(link, low[None, :], top).min(axis=1))
            if (low == was).all():
                break
        out = pd.DataFrame({"k": k, "links": counts.astype(np.int64), "low": k[low]})
        yield out[out["links"] > 0]


def key(text: Column) -> Column:
    """128 bits that tell texts apart; null is like empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_classes(docs: DataFrame) -> DataFrame:
    """A row for each different text: k (its 128-bit hash), first_id, n_copies, label (the same for all texts of a class), n_links."""
    bands, rows = banding()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text"):
                found = band_hashes(as_bytes(part["text"], lower=True), bands, rows)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "doc_id": part["doc_id"].to_numpy(), "bands": list(found)})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", key(F.col("text")))
    copies = own.groupBy("k").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    signed = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).mapInPandas(sign, "k binary, doc_id long, bands array<long>")
    signed, _ = stored(signed.groupBy("k").agg(F.first("bands").alias("bands")))
    members = signed.select("k", F.explode("bands").alias("h"))
    firsts = members.groupBy("h").agg(F.min("k").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    candidates = connected(members.join(firsts, "h").where("k <> rep").select(F.col("k").alias("a"), F.col("rep").alias("b")))
    candidates, _ = stored(candidates)
    copies, _ = stored(copies)
    sizes = candidates.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = candidates.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select(F.col("id").alias("k"), "label", "block", other.alias("o")).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o")
    dealt = dealt.join(copies.select("k", "first_id"), "k")
    texts = own.join(dealt.withColumnRenamed("k", "__k"), (F.col("k") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    texts = texts.select("k", "label", "block", "i", "j", "text").repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "k")
    found, _ = stored(texts.mapInPandas(verified, "k binary, links long, low binary"))
    links = found.groupBy("k").agg(F.sum("links").alias("n_links"))
    joined = connected(found.select(F.col("k").alias("a"), F.col("low").alias("b")))
    out = copies.join(joined.select(F.col("id").alias("k"), F.col("label").alias("__label")), "k", "left").join(links, "k", "left")
    return out.select("k", "first_id", "n_copies", F.coalesce("__label", "k").alias("label"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def classes(docs: DataFrame) -> DataFrame:
    """Every row of docs as doc_id, class_id, n_links, n_copies.

    Texts are linked if the sets of their n-grams of five words (lower-cased runs of characters
    other than ASCII white space) have a Jaccard similarity of 0.8 or more. class_id is the
    smallest doc_id of the connected component; n_links counts the other texts linked with a
    row's text, n_copies the rows with exactly its text, the row itself included. A null text
    is an empty one; texts without words are all alike. Null ids come last as class_id.
    """
    found, _ = stored(text_classes(docs))
    ids = found.groupBy("label").agg(F.min("first_id").alias("class_id"))
    named = found.join(ids, "label").select("k", "class_id", "n_links", "n_copies")
    rows = docs.select("doc_id", key(F.col("text")).alias("k"))
    return rows.join(named, "k").select("doc_id", "class_id", "n_links", "n_copies")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class, unchanged: a row with the smallest doc_id; of repeated rows one stays. Null ids count as the largest."""
    found, _ = stored(text_classes(docs))
    lead = found.groupBy("label").agg(F.min(F.struct(F.coalesce("first_id", F.lit((1 << 63) - 1)).alias("id"), "k")).alias("lead")).select("lead.id", "lead.k")
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), key(F.col("text")).alias("k"))
    kept = rows.join(lead, ["k", "id"], "left_semi")
    one = F.row_number().over(Window.partitionBy("k", "id").orderBy(F.lit(1)))
    return kept.withColumn("__n", one).where("__n = 1").select("__row.*")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force over all pairs that share a shingle.
OP2_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT coalesce(text, '') AS t, min(doc_id) AS first_id, count(*) AS n_copies, row_number() OVER (ORDER BY coalesce(text, '')) AS k
    FROM documents GROUP BY coalesce(text, '')
), words AS (
    SELECT k, regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+') AS w FROM texts
), grams AS (
    SELECT DISTINCT k, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM words
), sizes AS (
    SELECT k, count(*) AS n FROM grams GROUP BY k
), links AS (
    SELECT a.k AS a, b.k AS b
    FROM grams a JOIN grams b ON a.g = b.g AND a.k <> b.k
    JOIN sizes x ON x.k = a.k JOIN sizes y ON y.k = b.k
    GROUP BY a.k, b.k, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))
), reach AS (
    SELECT k, k AS r FROM texts UNION SELECT reach.k, links.b FROM reach JOIN links ON links.a = reach.r
), named AS (
    SELECT reach.k, min(t.first_id) AS class_id FROM reach JOIN texts t ON t.k = reach.r GROUP BY reach.k
), counted AS (
    SELECT a AS k, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, n.class_id, coalesce(c.n_links, 0) AS n_links, t.n_copies
FROM documents d JOIN texts t ON t.t = coalesce(d.text, '') JOIN named n ON n.k = t.k LEFT JOIN counted c ON c.k = t.k
"""
