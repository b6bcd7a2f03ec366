"""Toxicity by multiple-instance learning: sentence scores combined by noisy-or, trained from document labels alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import PUNCT, Words, as_bytes, pieces

#: Weights of the sentence scorer.
BITS = 18
#: Bytes of a word's beginning that are features beside the whole word.
STEMS = (4, 5, 6)
#: Labelled rows of each class that training takes at most: those with the smallest crc32 of their id.
TRAIN_ROWS = 2000
#: Passes of training over its rows.
EPOCHS = 300
#: Standard errors by which a feature's documents must differ from chance.
RARE = 3.0
#: Weight of the sum of absolute weights.
L1 = 2e-4
#: Score from which a text is predicted toxic, and clean() rejects it.
THRESHOLD = 0.3

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?\n"]] = True


def features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids (a row for each word), the words' sentences (0, 1, ...), the sentences' parts and their byte spans."""
    w = Words(parts, PUNCT)
    ends = np.concatenate(([0], np.cumsum(_END[w.raw])))
    place = ends[w.start] + w.part  # a sentence ends with its mark or its text
    new = np.ones(len(place), dtype=bool)
    new[1:] = place[1:] != place[:-1]
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    ids = np.empty((len(place), 1 + len(STEMS)), dtype=np.int32)
    shift = np.uint64(64 - BITS)
    ids[:, 0] = (w.hashes() >> shift).astype(np.int32)
    for k, n in enumerate(STEMS, 1):
        h = w.hashes(w.start, np.minimum(w.start + n, w.end))
        ids[:, k] = ((h * np.uint64(2 * n + 1)) >> shift).astype(np.int32)
    span = np.stack([w.start[first], w.end[last]], axis=1) - w.offset[w.part[first]][:, None] if len(place) else np.zeros((0, 2), np.int64)
    return ids, sentence, w.part[first], span, first


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


class Model:
    """Weights of the hashed features and a bias; a sentence's chance to offend is sigmoid(their sum)."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[bytes]) -> pd.DataFrame:
        """For each text: score, number of sentences that offend (0.5 or more), byte span and score of the worst one."""
        n = len(texts)
        log_not, worst = np.zeros(n), np.zeros(n)
        begin, end, offend, shift = (np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
        for ids, parts in pieces(texts, PUNCT):
            f, _, part, span, first = features(parts)
            if len(f):
                z = np.add.reduceat(self.weights[f].sum(axis=1), first) + self.bias
                p = np.exp(-softplus(-z))
                at = np.asarray(ids)[part]
                np.add.at(log_not, at, softplus(z))
                np.add.at(offend, at, p >= 0.5)
                order = np.lexsort((-p, at))
                lead = order[np.concatenate(([True], at[order][1:] != at[order][:-1]))]
                for s in lead:
                    if p[s] > worst[at[s]]:
                        worst[at[s]], begin[at[s]], end[at[s]] = p[s], span[s, 0] + shift[at[s]], span[s, 1] + shift[at[s]]
            for i, part in zip(ids, parts, strict=True):
                shift[i] += len(part)
        return pd.DataFrame({"score": -np.expm1(-log_not), "n_offending": offend, "worst_start": begin, "worst_end": end, "worst_score": worst})


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Model:
    """Gradient descent (Adam) on the noisy-or likelihood of the documents' labels."""
    y = labels.astype(float)
    out = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return Model(out, float(np.log(max(rate, 1e-4) / max(1 - rate, 1e-4))) - 3)
    # a feature counts if the labels of the documents that hold it differ from chance by RARE standard errors
    n, hits = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for group, parts in pieces(texts, PUNCT):
        f, s, part, _, _ = features(parts)
        held = np.unique(f.astype(np.int64) * len(y) + np.asarray(group)[part][s][:, None]) if len(f) else np.zeros(0, np.int64)
        n += np.bincount(held // len(y), minlength=1 << BITS)
        hits += np.bincount(held // len(y), y[held % len(y)], minlength=1 << BITS)
    rate = y.mean()
    weigh = np.abs(hits - n * rate) >= RARE * np.sqrt(n * rate * (1 - rate) + 1)
    used = np.flatnonzero(weigh)
    number = np.cumsum(weigh, dtype=np.int32) - 1
    # sentences without such a feature are alike: only their number in each document matters
    rows, slots, homes, loud_so_far = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    plain = np.zeros(len(y), dtype=np.int64)
    for group, parts in pieces(texts, PUNCT):
        f, s, part, _, _ = features(parts)
        keep = weigh[f]
        loud, row = np.unique(np.broadcast_to(s[:, None], f.shape)[keep], return_inverse=True)
        home = np.asarray(group)[part]
        plain += np.bincount(home, minlength=len(y)) - np.bincount(home[loud], minlength=len(y))
        rows.append(row + loud_so_far)
        slots.append(number[f[keep]])
        homes.append(home[loud])
        loud_so_far += len(loud)
    row, slot, home = (np.concatenate(x) for x in (rows, slots, homes))
    loud = home
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    bias, bm, bv = -6.0, 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        z = np.bincount(row, w[slot], minlength=len(loud)) + bias
        total = np.bincount(home, softplus(z), minlength=len(y)) + plain * softplus(bias)
        p = np.clip(-np.expm1(-total), 1e-6, 1)
        pull = np.where(y == 1, -(1 - p) / p, 1.0)
        dz = pull[home] * np.exp(-softplus(-z))
        g = np.bincount(slot, dz[row], minlength=len(used)) / len(y) + L1 * np.sign(w)
        gb = (dz.sum() + (pull * plain).sum() * np.exp(-softplus(-bias))) / len(y)
        rate = 0.3 / (1 + step / 40)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bm, bv = 0.9 * bm + 0.1 * gb, 0.99 * bv + 0.01 * gb * gb
        bias -= rate * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.99**step)) + 1e-8)
    out[used] = w
    return Model(out, float(bias))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows whose crc32(doc_id) mod 4 is not 2, at most `rows` of each class.

    Rows of null id, label or text teach nothing. Equal (id, label) rows count once.
    """
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)").distinct().where(key % 4 != 2)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("toxic") == y).orderBy(key, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    # the sample is bounded by 2 * rows ids, so it may be sent everywhere
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").distinct().toPandas()
    found = found.sort_values(["doc_id", "toxic", "text"])
    return train(as_bytes(found["text"], lower=True), found["toxic"].to_numpy())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with score, n_offending, worst_start, worst_end (bytes of the lower-cased text) and worst_score added.

    A null text is an empty one; a text without words scores 0 and has no worst sentence (-1).
    Columns of the input with such names are replaced; all others stay.
    """
    weights = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = Model(*weights.value)
        for t in texts:
            yield m.score(as_bytes(t, lower=True))

    udf = F.pandas_udf(rate, "score double, n_offending long, worst_start long, worst_end long, worst_score double")
    names = ("score", "n_offending", "worst_start", "worst_end", "worst_score")
    keep = [c for c in docs.columns if c not in names]
    return docs.select(*keep, udf(F.col("text")).alias("__s")).select(*keep, *(f"__s.{n}" for n in names))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is under THRESHOLD, unchanged."""
    return score(docs.withColumn("__row", F.struct(*docs.columns)).select("text", "__row"), fit(docs, labels)).where(F.col("score") < THRESHOLD).select("__row.*")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", "text"), model)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_offending", "worst_start", "worst_end", "worst_score")
