"""What the whole analysis finds of a paper's chunks in one task, against the operators that it stands for, and how its modules are joined."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import sections, similarity
from quillmark.plans import queries
from tests.oracle import DATA

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron rho Sigma TAU upsilon phi chi psi omega ähre ΣΑΣ x".split()


def sentence(rng, least=1, most=50):
    return rng.choice(["", " ", "\n", " "]).join(["", *(rng.choice(" \t\n").join([rng.choice(WORDS), rng.choice(WORDS)]) + rng.choice("  \n") + str(rng.randrange(90)) for _ in range(rng.randint(least, most)))])


def texts():
    rng = random.Random(4)
    out = ["", ".", "a.b", "short. " * 9, "no full stop at all and yet words", "One two three four five. " * 40, "w " * 300, ("w " * 36 + ". ") * 5]
    for _ in range(60):
        own = [sentence(rng) for _ in range(rng.randint(1, 25))]
        out.append(". ".join(own + rng.choices(own, k=rng.randrange(6))))
    return out


def test_chunks_in_python_are_those_of_the_columns(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "paper_id long, text string").select("text", sections.chunks(F.col("text")).alias("c")).collect()
    assert all(sections.grouped(r.text) == r.c for r in rows) and sum(len(r.c) for r in rows) > 100


def test_chunk_lists_keep_null_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, "Abstract\n" + "many words stand here " * 12 + ".")], "paper_id long, full_text string")
    found = {r.paper_id: r.chunks for r in sections.chunk_lists(sections.sectioned(rows)).collect()}
    assert found[1] is None and [c.chunk for c in found[2]] == [("many words stand here " * 12).strip() + "."] * 2  # the rest starts with the last sentence


def test_lower_case_is_that_of_the_columns(spark):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(x,) for x in ["aΣ. b", "aΣ.b", "Σ", "aΣ b", "ΣΑΣ", "İx", "".join(every[1:0x500])]], "t string").select("t", F.lower("t").alias("low")).collect()
    assert all(r.t.lower() == r.low for r in rows)


@pytest.mark.parametrize("many", [1500, 6])
def test_overlaps_are_those_of_the_single_operators(spark, monkeypatch, many):
    monkeypatch.setattr(similarity, "MANY", many)
    rng = random.Random(5)
    items = [(i, f"Title {i % 4}", " ".join(rng.choices(WORDS, k=40)), "c") for i in range(8)]
    corpus = spark.createDataFrame(items, "item_id long, title string, text string, corpus string")
    papers = [(i, t if i % 3 else f"{t}. {items[i % 8][2]}. More words follow here. {items[i % 8][2]}.\n2. Methods\n{t}") for i, t in enumerate(texts()[3:])]
    secs = sections.sectioned(spark.createDataFrame(papers, "paper_id long, full_text string")).cache()
    want = sorted(map(str, similarity.plagiarism(secs, sections.chunk_lists(secs), corpus).collect()))
    found = similarity.overlaps(secs, corpus).cache()
    matched = similarity.matches(similarity.named(found, corpus))
    assert sorted(map(str, similarity.overlapping(found, matched, secs).collect())) == want
    rows = sections.chunk_lists(secs).select("paper_id", F.inline("chunks"))
    shown = sorted(map(str, similarity.matches(similarity.best_match(rows, corpus), rows).collect()))
    assert sorted(map(str, matched.collect())) == shown and len(shown) > 10
    assert (found.where("duplicate_paragraphs is null").count() > 0) == (many == 6)
    assert found.agg(F.sum("duplicate_paragraphs")).first()[0] > 0 or many == 6


def test_no_modules_rows_are_sent_through_the_driver(spark):
    for name in ("f1_credibility", "f9_answers", "f9_evidence"):
        plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan, name
