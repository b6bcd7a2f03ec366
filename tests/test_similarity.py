"""Corpus similarity against plain cosines of all pairs."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillmark.operators import similarity as S


def weights(rows, idf):
    out = {}
    for i, counts in rows.items():
        w = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {t: x / length for t, x in w.items()} if length else {}
    return out


def terms(text):
    words = [w for w in text.lower().split() if len(w) > 1 and w not in S.STOPWORDS]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def fitted(texts):
    df, total = Counter(), Counter()
    for t in texts:
        df.update(terms(t).keys())
        total.update(terms(t))
    kept = [t for t in df if 2 <= df[t] <= 0.95 * len(texts)]
    kept = sorted(kept, key=lambda t: (-total[t], t))[: S.TERMS]
    return {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}


def tables(spark, chunks, corpus):
    c = spark.createDataFrame([(p, 0, i, t) for p, i, t in chunks], "paper_id long, idx int, pos int, chunk string")
    return c, spark.createDataFrame([(i, f"T{i}", t, "x") for i, t in enumerate(corpus)], "item_id long, title string, text string, corpus string")


def made(seed, n_corpus=60, n_chunks=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)]
    said = lambda n: " ".join(words[min(119, int(rng.expovariate(0.04)))] for _ in range(n))
    corpus = [said(rng.randrange(1, 40)) for _ in range(n_corpus)]
    corpus += [corpus[3], corpus[3], corpus[9] + " w1"]
    mixed = []
    for _ in range(n_chunks):
        base = rng.choice(corpus).split()
        mixed.append(" ".join(base[: rng.randrange(len(base) + 1)] + said(rng.randrange(0, 12)).split()))
    return [(i % 7, i, t) for i, t in enumerate([*mixed, corpus[3], corpus[3], "", "none of these"])], corpus


def test_best_match_is_that_of_all_pairs(spark):
    for seed in (1, 2):
        chunks, corpus = made(seed)
        idf = fitted(corpus)
        docs = weights({i: terms(t) for i, t in enumerate(corpus)}, idf)
        asked = weights({(p, i): terms(t) for p, i, t in chunks}, idf)
        want = {}
        for k, u in asked.items():
            scores = [(-round(sum(x * v.get(t, 0.0) for t, x in u.items()), 9), i) for i, v in docs.items()]
            best = min(scores)
            if -best[0] >= S.MATCH:
                want[k] = (best[1], -best[0])
        found = {(r.paper_id, r.pos): (r.item_id, round(r.score, 9)) for r in S.best_match(*tables(spark, chunks, corpus)).collect()}
        assert found == want and len(want) > 40


def test_every_near_pair_is_met_and_far_ones_are_not_all(spark):
    chunks, corpus = made(3)
    own, other = S.weights_of(*tables(spark, chunks, corpus))
    u, v = {}, {}
    for r in own.collect():
        u.setdefault(r.key, {})[r.at] = r.weight
    for r in other.collect():
        v.setdefault(r.item_id, {})[r.at] = r.weight
    sharing = sum(len(a.keys() & b.keys()) for a in u.values() for b in v.values())
    for least in (0.3, 0.6, 0.9):
        rows = [(r.key, r.item_id) for r in S.met(own, other, least).select("key", "item_id").collect()]
        near = {(k, i) for k, a in u.items() for i, b in v.items() if sum(x * b.get(t, 0.0) for t, x in a.items()) >= least}
        assert near <= set(rows) and len(rows) < sharing * (0.9 if least < 0.5 else 0.5)


def test_a_word_of_nearly_every_text_joins_nothing(spark):
    rng = random.Random(4)
    own = [" ".join(f"n{rng.randrange(2000)}" for _ in range(6)) for _ in range(400)]
    corpus = [f"{t} {t} {t}" + (" everywhere" if i % 20 else "") for i, t in enumerate(own)]  # in 95 % of the texts
    chunks = [(1, i, f"{rng.choice(own)} everywhere unknown{i}") for i in range(100)]
    own_w, other = S.weights_of(*tables(spark, chunks, corpus))
    at = {r.term: r.at for r in other.select("term", "at").distinct().collect()}["everywhere"]
    assert other.where(f"at = {at}").count() == 380 and own_w.where(f"at = {at}").count() == 100
    assert S.indexed(own_w, ["key"], True).where(f"at = {at}").count() == 0 and S.indexed(other, ["item_id"], False).where(f"at = {at}").count() == 0
    assert S.met(own_w, other).count() < 3000  # 38000 for that word alone
    assert S.best_match(*tables(spark, chunks, corpus)).count() > 50


def test_no_text_of_a_chunk_is_shuffled_to_look_it_up(spark):
    chunks, corpus = made(6, 20, 40)
    rows, items = tables(spark, chunks, corpus)
    own, other = S.weights_of(rows, items)
    plan = S.met(own, other)._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(moved) == 1 and "hashpartitioning(key" in moved[0]  # only the counts of known terms, by key


def test_no_chunks_or_no_corpus(spark):
    chunks, corpus = made(5, 10, 10)
    assert S.best_match(*tables(spark, [], corpus)).collect() == []
    assert S.best_match(*tables(spark, chunks, [])).collect() == []


def test_a_large_corpus_gives_the_same_matches(spark, monkeypatch):
    from quillmark.plans import queries

    corpus = queries.corpus(spark, "/root/testdata/sf0.001")
    chunks = queries.chunks_of(queries.chunk_table(spark, "/root/testdata/sf0.001"))
    found = lambda: sorted((r.paper_id, r.idx, r.pos, r.item_id, round(r.score, 9)) for r in S.best_match(chunks, corpus).collect())
    sent = found()
    monkeypatch.setattr(S, "SENT", 0)
    assert found() == sent and sent


def test_chunks_are_scored_in_their_own_rows(spark, monkeypatch):
    texts = ["Größe déjà_vu x²y naïve ﬁne", "İstanbul — größe déjà_vu", "größe’s déjà_vu\tx²y the naïve ﬁne", "a b größe déjà_vu x²y naïve", "日本 größe\x00déjà_vu", ""] * 2
    corpus = ["größe déjà_vu x²y naïve", "größe déjà_vu istanbul", "naïve ﬁne 日本 x²y", "größe déjà_vu x²y naïve", "other istanbul 日本"]
    chunks, items = tables(spark, [*((i, i, t) for i, t in enumerate(texts)), (99, 0, None)], corpus)
    with monkeypatch.context() as m:
        m.setattr(S, "looked_up", None)  # no chunk's terms are shuffled
        made = S.best_match(chunks, items)
    # as by the terms that Spark finds
    known, other, vocabulary = S.corpus_weights(items)
    own = S.chunk_weights(S.looked_up(chunks.where("chunk is not null"), vocabulary), known)
    near = own.join(other.select("term", "item_id", F.col("weight").alias("w")), "term").groupBy("key", "item_id").agg(F.sum(F.col("weight") * F.col("w")).alias("s")).where(F.round("s", 9) >= S.MATCH)
    best = {r.key: (-r.b.i, round(r.b.r, 9)) for r in near.groupBy("key").agg(F.max(F.struct(F.round("s", 9).alias("r"), (-F.col("item_id")).alias("i"))).alias("b")).collect()}
    want = {i: best[k] for i, t in enumerate(texts) if (k := hashlib.md5(t.encode()).hexdigest()) in best}
    assert {r.paper_id: (r.item_id, round(r.score, 9)) for r in made.collect()} == want and len(want) >= 6
