"""Overlap with a corpus by TF-IDF cosine, with the paper itself by word sets, and with search results."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from quillmark.functions import text as T
from quillmark.operators import sections
from quillmark.sources.store import merging, written

#: Words too common to compare by, and the thresholds of a report.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few for from further had has have having he her here hers "
    "him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our ours out over own same she so some such than that the their theirs them then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with you your yours"
).split()
MATCH, DUPLICATE, RATIO, LEAST_WORDS = 0.60, 0.85, 0.7, 25
#: Columns of plagiarism(), and those of them that need a paper's repeated chunks.
REPEATED = ("plagiarism_score", "plagiarism_summary", "duplicate_paragraphs")
PLAGIARISM = (*REPEATED, "n_matches", "top_similarity", "top_title", "sections")
TERMS, MIN_DF, MAX_DF = 20_000, 2, 0.95
#: Weights of a corpus, at most, that are sent everywhere.
SENT = 200_000
#: Papers of more chunks look for their repeated ones as rows.
MANY = 1500
#: Bounds of cosines are held this much lower, for rounding.
SLACK = 1e-6
WEB_STOPWORDS = "the and or that this with from have been are was were also into more".split()
WEB_LEAST, WEB_SEGMENTS, WEB_MATCHES = 25, 5, 15


def terms(text: Column) -> Column:
    """Words of two letters or digits and more that aren't stop words, and pairs of words that follow each other then."""
    words = F.filter(T.runs(F.lower(text)), lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return T.bound(words, T.with_pairs)


def counted(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.select(*ids, F.explode(terms(F.col("text"))).alias("term")).groupBy(*ids, "term").agg(F.count(F.lit(1)).alias("tf"))


def fit(corpus: DataFrame) -> DataFrame:
    """(term, idf) of a corpus (item_id, text): terms in two texts at least and 95 % at most, the TERMS most frequent of them."""
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    stats = counted(corpus, ["item_id"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    kept = stats.join(F.broadcast(n)).where((F.col("df") >= MIN_DF) & (F.col("df") <= MAX_DF * F.col("n")))  # n is one row
    kept = kept.orderBy(F.desc("total"), "term").limit(TERMS)
    return kept.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighed(rows: DataFrame, ids: list[str], idf: DataFrame) -> DataFrame:
    """(*ids, term, weight): (1 + ln tf) * idf, each text's weights of length 1. idf has TERMS rows at most, so it is sent everywhere; its other columns stay."""
    more = [c for c in idf.columns if c not in ("term", "idf")]
    # terms that the corpus doesn't know go before anything is shuffled
    known = rows.select(*ids, F.explode(terms(F.col("text"))).alias("term")).join(F.broadcast(idf), "term")
    raw = known.groupBy(*ids, "term", "idf", *more).agg(F.count(F.lit(1)).alias("tf")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return raw.select(*ids, "term", *more, (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*ids)))).alias("weight"))


def looked_up(chunks: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(key, hits) of all different chunk texts, by key (their md5): the vocabulary's terms in them, as (place in it, tf). Only these are shuffled, no text."""
    rows = chunks.select(F.md5(F.col("chunk").cast("binary")).alias("key"), terms(F.col("chunk")).alias("__terms"))
    # a vocabulary must hold something; no term is empty
    model = CountVectorizerModel.from_vocabulary(vocabulary or [""], "__terms", "__counts")
    counts = F.unwrap_udt(F.col("__counts"))
    hits = model.transform(rows).select("key", F.arrays_zip(counts["indices"].alias("place"), counts["values"].alias("tf")).alias("hits"))
    # empty ones stay, as a filter of them would go below the projection and count all terms twice
    return hits.groupBy("key").agg(F.any_value("hits").alias("hits"))


def placed(weights: DataFrame, idf: DataFrame) -> DataFrame:
    """(term, idf, most, at): idf with the largest weight that a term has in any text of the corpus, and its place in the order of those."""
    most = weights.groupBy("term").agg(F.max("weight").alias("most")).join(F.broadcast(idf), "term")
    return most.select("term", "idf", "most", F.row_number().over(Window.orderBy(F.desc("most"), "term")).alias("at"))  # TERMS rows at most


def indexed(weights: DataFrame, ids: list[str], against_corpus: bool, least: float = MATCH) -> DataFrame:
    """(*ids, at, weight, behind, sum_behind, vector): the terms by which a text must be looked up to find all texts whose cosine with it is `least` or more.

    A text's terms are put in the order of their largest corpus weight, the same order for all
    texts. Terms at its end are left out while all of them together can't reach `least`: they can
    give no more than their length, as the other text's is 1, nor, against texts of the corpus, more
    than they give with the largest corpus weights. So two texts that are near enough meet in the
    first term that they share. behind is the length of what follows a term, sum_behind what that
    gives at most with the largest weights, and vector the whole text: (at, weight) in order.
    """
    per = Window.partitionBy(*ids)
    rows = per.orderBy(F.desc("at"))
    with_own, after = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow), rows.rowsBetween(Window.unboundedPreceding, -1)
    square, most, zero = F.col("weight") * F.col("weight"), F.col("weight") * F.col("most"), F.lit(0.0)
    reach = F.sqrt(F.sum(square).over(with_own))
    if against_corpus:
        reach = F.least(reach, F.sum(most).over(with_own))
    marked = weights.select(*ids, "at", "weight", reach.alias("reach"), F.sqrt(F.coalesce(F.sum(square).over(after), zero)).alias("behind"), F.coalesce(F.sum(most).over(after), zero).alias("sum_behind"), F.sort_array(F.collect_list(F.struct("at", "weight")).over(per)).alias("vector"))
    return marked.where(F.col("reach") >= least - SLACK).drop("reach")


def met(chunks: DataFrame, corpus: DataFrame, least: float = MATCH) -> DataFrame:
    """(key, item_id, u, v) of weights (key, at, most, weight) and (item_id, at, most, weight): vectors of the pairs that can be `least` alike, once for each indexed term that they share.

    If a term is the first that a pair shares, its cosine is what this term gives and at most the
    product of the two lengths behind it; rows that can't be such a first term are left out.
    """
    a = indexed(chunks, ["key"], True, least).withColumnRenamed("vector", "u")
    rows = written(indexed(corpus, ["item_id"], False, least).select("item_id", "at", F.col("weight").alias("other"), F.col("behind").alias("after"), "vector"), "index")
    # written, so that Spark knows their sizes: where the corpus' index is small it is sent everywhere, and no chunk's vector is shuffled
    b = written(rows.drop("vector"), "index")
    v = written(rows.groupBy("item_id").agg(F.any_value("vector").alias("v")), "index").select("item_id", F.map_from_entries("v").alias("v"))
    bound = F.col("weight") * F.col("other") + F.least(F.col("behind") * F.col("after"), F.col("sum_behind"))
    return a.join(b, "at").where(bound >= least - SLACK).select("key", "item_id", "u").join(v, "item_id").select("key", "item_id", "u", "v")


def corpus_weights(corpus: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """placed() terms of a corpus, weights (item_id, term, weight, most, at) of its different texts, by the smallest item_id, and its terms in their order."""
    idf = fit(corpus)
    once = corpus.groupBy("text").agg(F.min("item_id").alias("item_id"))  # equal texts are ties, which go to the smallest
    other = weighed(once, ["item_id"], idf)
    known = written(placed(other, idf), "terms")
    vocabulary = [r.term for r in known.select("term", "at").orderBy("at").collect()]  # TERMS at most; places count from 1
    return known, written(other.join(F.broadcast(known.drop("idf")), "term"), "weights"), vocabulary


def chunk_weights(hits: DataFrame, known: DataFrame) -> DataFrame:
    """(key, term, most, at, weight) of looked_up() rows."""
    rows = hits.select("key", F.inline("hits")).select("key", (F.col("place") + 1).alias("at"), "tf")
    w = rows.join(F.broadcast(known), "at").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    return w.select("key", "term", "most", "at", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))).alias("weight"))


def weights_of(chunks: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights of all different chunk texts, by key (their md5), and of all different corpus texts, by the smallest item_id."""
    known, other, vocabulary = corpus_weights(corpus)
    return chunk_weights(looked_up(chunks, vocabulary), known), other


def scorer(known: DataFrame, other: DataFrame) -> Callable[[list[str | None]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function that finds of lower-cased texts those whose best text of a small corpus is MATCH alike or more: their places, item_ids and scores. Of equal ones the smallest item_id counts.

    other's rows, SENT at most, and the terms are held by it. A text that can't reach MATCH with the largest weights of its terms meets none.
    """
    fitted = known.select("term", "at", "idf", "most").orderBy("at").collect()  # TERMS at most
    idf, most = (np.array([0.0, *(r[c] for r in fitted)]) for c in ("idf", "most"))
    single = {r.term: r.at for r in fitted if " " not in r.term}
    after: dict[str, dict[str, int]] = {}  # pairs by their first word
    for r in fitted:
        first, _, second = r.term.partition(" ")
        if second:
            after.setdefault(first, {})[second] = r.at
    rows = other.select("item_id", "at", "weight").toPandas()
    items, column = np.unique(rows["item_id"].to_numpy(dtype=np.int64), return_inverse=True)
    place, weight = rows["at"].to_numpy(dtype=np.int64), rows["weight"].to_numpy()
    # words as in terms(), as \w is \p{L}, \p{N} and _; a text of Latin-1 is cut by bytes, which is faster
    run, apart = re.compile(r"\w{2,}"), bytes(c if chr(c).isalnum() or c == ord("_") else ord(" ") for c in range(256))
    passed = {*STOPWORDS, "", *map(chr, range(256))}

    def words_of(text: str) -> list[str]:
        try:
            found = text.encode("latin-1").translate(apart).decode("latin-1").split(" ")
        except UnicodeEncodeError:
            found = run.findall(text)
        return [w for w in found if w not in passed]

    def places(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of each known term in each text."""
        row: list[int] = []
        found: list[int] = []
        for i, text in enumerate(texts):
            words = words_of(text or "")
            own = list(filter(None, map(single.get, words)))  # places count from 1
            own += [next[b] for next, b in zip(map(after.get, words), words[1:], strict=False) if next and b in next]
            row += [i] * len(own)
            found += own
        return np.array(row, dtype=np.int64), np.array(found, dtype=np.int64)

    def found(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, of = places(texts)
        cell, tf = np.unique(row * len(idf) + of, return_counts=True)
        own = cell % len(idf)
        some, start, n = np.unique(cell // len(idf), return_index=True, return_counts=True)
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(some):
            return none
        x = (1 + np.log(tf)) * idf[own]
        x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, start)), n)
        able = np.add.reduceat(x * most[own], start) >= MATCH - SLACK
        if not able.any():
            return none
        x, own, some, n = x[np.repeat(able, n)], own[np.repeat(able, n)], some[able], n[able]
        start = np.cumsum(n) - n
        top, item, raw = np.zeros(len(some)), np.zeros(len(some), dtype=np.int64), np.zeros(len(some))
        for low in range(0, len(items), 256):
            here = (column >= low) & (column < low + 256)
            w = np.zeros((len(idf), min(256, len(items) - low)))
            w[place[here], column[here] - low] = weight[here]
            sums = np.empty((len(some), w.shape[1]))
            for i in range(0, len(some), 64):  # so few rows that their products stay in a core's cache
                a, b = start[i], start[i + 64] if i + 64 < len(some) else len(x)
                np.add.reduceat(x[a:b, None] * w[own[a:b]], start[i : i + 64] - a, axis=0, out=sums[i : i + 64])
            near = np.round(sums, 9)  # equal but for the last bits are ties
            k = near.argmax(axis=1)
            line = np.arange(len(some))
            better = near[line, k] > top
            top, item, raw = np.where(better, near[line, k], top), np.where(better, items[low + k], item), np.where(better, sums[line, k], raw)
        hit = np.flatnonzero(top >= MATCH)
        return some[hit], item[hit], raw[hit]

    return found


def scored(chunks: DataFrame, known: DataFrame, other: DataFrame) -> DataFrame:
    """(paper_id, idx, pos, item_id, score): each chunk's best text of a small corpus, by scorer(), which goes to all tasks. Neither texts nor pairs are shuffled."""
    best = scorer(known, other)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                row, item, raw = best(part.column("low").to_pylist())
                ids = part.select(["paper_id", "idx", "pos"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(item), pa.array(raw)], names=[*ids.schema.names, "item_id", "score"])

    shape = StructType([*(StructField(c, chunks.schema[c].dataType) for c in ("paper_id", "idx", "pos")), StructField("item_id", LongType()), StructField("score", DoubleType())])
    return chunks.select("paper_id", "idx", "pos", F.lower("chunk").alias("low")).mapInArrow(score, shape)


def best_match(chunks: DataFrame, corpus: DataFrame) -> DataFrame:
    """(paper_id, idx, pos, item_id, title, corpus, score): each chunk's best corpus text, if it is MATCH or more. Ties go to the smaller item_id.

    Exact. The weights of a corpus of up to SENT of them are sent to the chunks, which are scored in their own rows. Of a larger one
    only texts are met that share an indexed term, which carries both whole vectors; a pair is scored where it is found, none below
    MATCH is shuffled, and a text that stands often is looked up once.
    """
    known, other, vocabulary = corpus_weights(corpus)
    names = corpus.select("item_id", "title", "corpus")
    if other.count() <= SENT:
        return scored(chunks, known, other).join(names, "item_id").select("paper_id", "idx", "pos", "item_id", "title", "corpus", "score")
    hits = looked_up(chunks, vocabulary)
    dot = F.aggregate("u", F.lit(0.0), lambda sum, x: sum + x["weight"] * F.coalesce(F.col("v")[x["at"]], F.lit(0.0)))
    found = met(chunk_weights(hits, known), other).select("key", "item_id", dot.alias("score")).where(F.round("score", 9) >= MATCH)
    # equal but for the last bits are ties
    best = found.groupBy("key").agg(F.max(F.struct(F.round("score", 9).alias("r"), (-F.col("item_id")).alias("i"), "score")).alias("b"))
    named = best.select("key", (-F.col("b.i")).alias("item_id"), F.col("b.score").alias("score")).join(names, "item_id")
    named = written(named, "best")  # few rows, so they go to the chunks
    places = chunks.select("paper_id", "idx", "pos", F.md5(F.col("chunk").cast("binary")).alias("key"))
    return places.join(named, "key").select("paper_id", "idx", "pos", "item_id", "title", "corpus", "score")


def matches(hits: DataFrame, chunks: DataFrame | None = None, most: int = 6) -> DataFrame:
    """(paper_id, rank, title, corpus, similarity, matched_text): the first hit of each title, most similar first. chunks: where the hits' texts are, if hits have no matched_text."""
    if chunks is not None:
        shown = chunks.select("paper_id", "idx", "pos", F.substring("chunk", 1, 180).alias("matched_text"))
        hits = written(hits, "hits").join(shown, ["paper_id", "idx", "pos"])
    text = hits.withColumn("similarity", T.half_even(F.round(F.col("score") * 100, 7), 1))
    first = F.row_number().over(Window.partitionBy("paper_id", "title").orderBy("idx", "pos"))
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("similarity"), "idx", "pos"))
    once = text.withColumn("o", first).where("o = 1").withColumn("rank", rank).where(F.col("rank") <= most)
    return once.select("paper_id", "rank", "title", "corpus", "similarity", "matched_text")


def _words(chunk: Column) -> Column:
    return F.array_distinct(T.tokens(F.lower(chunk)))


def _first(w: Column) -> Column:
    """Two sets that are DUPLICATE alike share a word among the first of each, in any order of all words; long words, which are rare, come first."""
    ordered = F.transform(F.sort_array(F.transform(w, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda y: y["x"])
    return T.bound(F.size(w), lambda n: F.slice(ordered, F.lit(1), (n - F.ceil(n * F.lit(DUPLICATE)) + 1).cast("int")))


def repeated(lists: DataFrame) -> DataFrame:
    """duplicates() of sections.chunk_lists(), which are best written first. A paper of MANY chunks or less is done in its own row, without a shuffle; others as rows."""
    lists = lists.where("size(chunks) > 1")
    near = _repeated(lists.where(F.size("chunks") <= MANY))
    long = lists.where(F.size("chunks") > MANY)
    return near if long.isEmpty() else near.unionByName(duplicates(long.select("paper_id", F.inline("chunks"))))


def alike(lows: list[bytes]) -> list[tuple[int, float]]:
    """(i, Jaccard similarity with the first later text that is DUPLICATE alike) of each lower-cased text that has one, in order; texts of under LEAST_WORDS words are left out.

    Sets that are that much alike share a word among their first ones in any order of all words; the rarest come first. A set with too few words
    that another one has is like none.
    """
    sets = [(k, w) for k, t in enumerate(lows) if len(w := set(t.split())) >= LEAST_WORDS]  # bytes are cut as T.tokens cuts texts
    df: Counter[bytes] = Counter()
    for _, w in sets:
        df.update(w)
    once = {w for w, n in df.items() if n == 1}
    sets = [(k, w) for k, w in sets if len(w) - len(w & once) >= DUPLICATE * len(w) - SLACK]
    out = []
    met: dict[bytes, list[int]] = {}
    for i in range(len(sets) - 1, -1, -1):
        own, n = sets[i][1], len(sets[i][1])
        lead = sorted(own, key=lambda w: (df[w], w))[: n - math.ceil(n * DUPLICATE) + 1]
        for j in sorted({j for w in lead for j in met.get(w, ())}):
            m = len(sets[j][1])
            if n >= RATIO * m and m >= RATIO * n:
                both = len(own & sets[j][1])
                if both / (n + m - both) >= DUPLICATE:
                    out.append((sets[i][0], both / (n + m - both)))
                    break
        for w in lead:
            met.setdefault(w, []).append(i)
    return out[::-1]


def _repeated(lists: DataFrame) -> DataFrame:
    """A paper's sets of words are intersected in a Python task: lambdas of SQL, which aren't compiled, took more than twice the CPU time."""
    sent = F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["pos"].alias("pos"), F.lower(c["chunk"]).cast("binary").alias("low"), F.substring(c["chunk"], 1, 180).alias("shown")))
    key = lists.schema["paper_id"].dataType
    shape = StructType([StructField("paper_id", key), *(StructField(n, IntegerType()) for n in ("idx", "pos")), StructField("score", DoubleType()), StructField("matched_text", StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
                idx, pos, low, shown = (c.to_pylist() for c in part.column("c").flatten().flatten())
                end = 0
                for paper, n in zip(part.column("paper_id").to_pylist(), part.column("c").value_lengths().to_pylist(), strict=True):
                    start, end = end, end + n
                    begun = set()
                    for i, score in alike(low[start:end]):
                        k = start + i
                        if shown[k][:150] not in begun:  # those that start alike count once
                            begun.add(shown[k][:150])
                            out.append((paper, idx[k], pos[k], score, shown[k]))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=to_arrow_type(f.dataType)) for i, f in enumerate(shape)], names=shape.names)

    found = lists.select("paper_id", sent.alias("c")).mapInArrow(find, shape)
    return found.select("paper_id", "idx", "pos", T.half_even(F.col("score") * 100, 1).alias("similarity"), "matched_text")


def duplicates(chunks: DataFrame) -> DataFrame:
    """(paper_id, idx, pos, similarity, matched_text): chunks that a later chunk of the same paper nearly repeats; those that start alike count once.

    Pairs are found by the words that they share, so papers of many unlike chunks cost little. Hashes
    of these words are shuffled, and chunks only where a pair names them.
    """
    sets = chunks.select("paper_id", "idx", "pos", "chunk", _words(F.col("chunk")).alias("w")).where(F.size("w") >= LEAST_WORDS)
    rare = sets.select("paper_id", "idx", "pos", F.size("w").alias("n"), F.explode(F.transform(_first(F.col("w")), lambda x: F.xxhash64(x))).alias("word"))
    a = rare.select("paper_id", "word", F.col("idx").alias("i"), F.col("pos").alias("p"), F.col("n").alias("x"))
    b = rare.select("paper_id", "word", F.col("idx").alias("j"), F.col("pos").alias("q"), F.col("n").alias("y"))
    later = (F.col("j") > F.col("i")) | ((F.col("j") == F.col("i")) & (F.col("q") > F.col("p")))
    near = (F.col("x") >= RATIO * F.col("y")) & (F.col("y") >= RATIO * F.col("x"))
    pairs = written(a.join(b, ["paper_id", "word"]).where(later & near).select("paper_id", "i", "p", "j", "q").distinct(), "pairs")
    one = sets.select("paper_id", F.col("idx").alias("i"), F.col("pos").alias("p"), F.substring("chunk", 1, 180).alias("chunk"), F.col("w").alias("u"))
    two = sets.select("paper_id", F.col("idx").alias("j"), F.col("pos").alias("q"), F.col("w").alias("v"))
    both = pairs.join(one, ["paper_id", "i", "p"]).join(pairs.join(two, ["paper_id", "j", "q"]), ["paper_id", "i", "p", "j", "q"])
    scored = both.withColumn("s", T.jaccard(F.col("u"), F.col("v"))).where(F.col("s") >= DUPLICATE)
    first = F.row_number().over(Window.partitionBy("paper_id", F.substring("chunk", 1, 150)).orderBy("i", "p", "j", "q"))
    return scored.withColumn("o", first).where("o = 1").select("paper_id", F.col("i").alias("idx"), F.col("p").alias("pos"), T.half_even(F.col("s") * 100, 1).alias("similarity"), F.substring("chunk", 1, 180).alias("matched_text"))


def plagiarism_score(top: Column, n: Column, dups: Column) -> Column:
    return F.when(n > 0, T.half_even(F.least(F.lit(100.0), F.round(top * 0.6 + n * 6, 9)))).when(dups > 0, F.least(F.lit(100), dups * 12 + 20)).otherwise(0).cast("int")


def plagiarism_summary(score: Column) -> Column:
    return (
        F.when(score <= 5, "The corpus holds nothing alike.")
        .when(score <= 25, "A few passages are like texts of the corpus.")
        .when(score <= 50, "Several passages are like texts of the corpus.")
        .otherwise("Large parts are like texts of the corpus.")
    )


def matched_most(secs: DataFrame, matched: DataFrame) -> DataFrame:
    """(paper_id, sections, n_matches, top_similarity, top_title) of sections.sectioned() rows and matches() of them."""
    return _with_most(secs.where("size(secs) > 0").select("paper_id", F.size("secs").cast("long").alias("sections")), matched)


def _with_most(rows: DataFrame, matched: DataFrame) -> DataFrame:
    found = matched.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n_matches"), F.max("similarity").alias("top_similarity"), F.min_by("title", "rank").alias("top_title"))
    return rows.join(merging(found), "paper_id", "left").fillna(0, ["n_matches"])


def _judged(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("plagiarism_score", plagiarism_score(F.col("top_similarity"), F.col("n_matches"), F.col("duplicate_paragraphs")))
    return out.select("paper_id", "plagiarism_score", plagiarism_summary(F.col("plagiarism_score")).alias("plagiarism_summary"), "n_matches", "top_similarity", "top_title", "duplicate_paragraphs", "sections")


def plagiarism(secs: DataFrame, chunks: DataFrame, corpus: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """secs: sections.sectioned() rows; chunks: chunk_lists() of them; matched: matches() of the chunks, if they are known already. (paper_id, plagiarism_score, plagiarism_summary, n_matches, top_similarity, top_title, duplicate_paragraphs, sections)."""
    if matched is None:
        rows = chunks.select("paper_id", F.inline("chunks"))
        matched = matches(best_match(rows, corpus), rows)
    dups = repeated(chunks).groupBy("paper_id").agg(F.count(F.lit(1)).alias("duplicate_paragraphs"))
    return _judged(matched_most(secs, matched).join(merging(dups), "paper_id", "left").fillna(0, ["duplicate_paragraphs"]))


def overlaps(secs: DataFrame, corpus: DataFrame, repeats: bool = True) -> DataFrame | None:
    """(paper_id, sections, hits, duplicate_paragraphs) of sections.sectioned() rows against a corpus that can be sent everywhere; None for a larger one.

    What best_match() and repeated() find of a paper, in one row and one Python task that makes the paper's chunks, so no chunk is written, sent twice or
    shuffled. hits: array of (idx, pos, item_id, score, matched_text). duplicate_paragraphs is null for papers of more than MANY chunks, and without repeats.
    """
    known, other, _ = corpus_weights(corpus)
    if other.count() > SENT:
        return None
    best = scorer(known, other)
    hit = StructType([StructField("idx", IntegerType()), StructField("pos", IntegerType()), StructField("item_id", LongType()), StructField("score", DoubleType()), StructField("matched_text", StringType())])
    shape = StructType([secs.schema["paper_id"], StructField("sections", LongType()), StructField("hits", ArrayType(hit)), StructField("duplicate_paragraphs", LongType())])
    types = [to_arrow_type(f.dataType) for f in hit]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 30) for i in range(0, batch.num_rows, 30)):
                chunks: list[tuple[int, int, str]] = []  # of all papers here, one behind the other
                ends, n_secs = [0], []
                for idx, texts in zip(part.column("idx").to_pylist(), part.column("text").to_pylist(), strict=True):
                    chunks += [(i, pos, c) for i, t in zip(idx, texts, strict=True) for pos, c in enumerate(sections.grouped(t))]
                    ends.append(len(chunks))
                    n_secs.append(len(idx))
                low = [c.lower() for _, _, c in chunks]
                hits = []
                for i in range(0, len(low), 1000):
                    hits += [(i + at, item, score) for at, item, score in zip(*(a.tolist() for a in best(low[i : i + 1000])), strict=True)]
                own = [(*chunks[at][:2], item, score, chunks[at][2][:180]) for at, item, score in hits]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted([at for at, _, _ in hits], ends), type=pa.int32()), pa.StructArray.from_arrays([pa.array([x[k] for x in own], type=t) for k, t in enumerate(types)], names=hit.names))
                dups = [len({chunks[a + i][2][:150] for i, _ in alike([t.encode() for t in low[a:b]])}) if repeats and b - a <= MANY else None for a, b in pairwise(ends)]  # those that start alike count once
                yield pa.RecordBatch.from_arrays([part.column("paper_id"), pa.array(n_secs, type=pa.int64()), lists, pa.array(dups, type=pa.int64())], names=shape.names)

    return secs.where("size(secs) > 0").select("paper_id", F.col("secs.idx").alias("idx"), F.col("secs.text").alias("text")).mapInArrow(find, shape)


def named(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Hits of overlaps(), a row each, as matches() takes them."""
    return found.select("paper_id", F.inline("hits")).join(corpus.select("item_id", "title", "corpus"), "item_id")


def overlapping(found: DataFrame, matched: DataFrame, secs: DataFrame, repeats: bool = True) -> DataFrame:
    """plagiarism() of overlaps() that are written, matches() of their hits and sections.sectioned() rows; without repeats matched_most()."""
    if not repeats:
        return _with_most(found.select("paper_id", "sections"), matched)
    rows = found.select("paper_id", "sections", "duplicate_paragraphs")
    long = rows.where("duplicate_paragraphs is null")
    if not long.isEmpty():
        lists = written(sections.chunk_lists(secs.join(long.select("paper_id"), "paper_id", "left_semi")), "chunks")
        dups = repeated(lists).groupBy("paper_id").agg(F.count(F.lit(1)).alias("__n"))
        rows = rows.join(merging(dups), "paper_id", "left").select("paper_id", "sections", F.coalesce("duplicate_paragraphs", "__n", F.lit(0)).alias("duplicate_paragraphs"))
    return _judged(_with_most(rows, matched))


def token_overlap(a: Column, b: Column) -> Column:
    """0 to 100: shared words of three unaccented letters or more."""

    def words(x: Column) -> Column:
        return F.array_distinct(F.filter(T.letter_runs(x), lambda w: ~w.isin(*WEB_STOPWORDS)))

    return T.half_even(T.jaccard(words(a), words(b)) * 100).cast("int")


def web_matches(segments: DataFrame, results: DataFrame) -> DataFrame:
    """(paper_id, rank, url, title, snippet, matched_text, similarity, provider) from segments (paper_id, pos, segment) and results (query, provider, rank, url, title, description).

    A paper's first WEB_SEGMENTS segments are looked up by their first 200 characters; of the
    providers that know a query the first in the order google, brave, duckduckgo is used.
    """
    order = F.when(F.col("provider") == "google", 0).when(F.col("provider") == "brave", 1).otherwise(2)
    best = results.withColumn("o", order).withColumn("m", F.min("o").over(Window.partitionBy("query"))).where("o = m")
    asked = segments.withColumn("n", F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))).where((F.col("n") <= WEB_SEGMENTS) & F.col("segment").rlike(r"\S"))
    found = asked.withColumn("query", F.substring("segment", 1, 200)).join(best.withColumnRenamed("rank", "at"), "query")
    scored = found.withColumn("similarity", token_overlap(F.col("segment"), F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))))).where(F.col("similarity") >= WEB_LEAST)
    rank = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("similarity"), "n", "at"))
    ranked = scored.withColumn("rank", rank).where(F.col("rank") <= WEB_MATCHES)
    return ranked.select("paper_id", "rank", "url", "title", F.substring(F.coalesce("description", F.lit("")), 1, 240).alias("snippet"), F.substring("segment", 1, 140).alias("matched_text"), "similarity", "provider")
