"""Marks of a paper's own matches against a plain search, character by character."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quillmark.operators import sections as S


def plain(text, matches):
    """Which match each character belongs to, and where marks begin."""
    owner, starts = [None] * len(text), {}
    for rank, m in sorted(matches, key=lambda x: (-len(x[1] or ""), x[0])):
        at = 0
        while m and len(m) >= 10 and at + len(m) <= len(text):
            if text[at : at + len(m)].lower() == m.lower() and all(o is None for o in owner[at : at + len(m)]):
                owner[at : at + len(m)], starts[at] = [rank] * len(m), rank
                at += len(m)
            else:
                at += 1
    length = {r: len(m or "") for r, m in matches}
    return sorted((a, r, text[a : a + length[r]]) for a, r in starts.items())


def overlaid(spark, papers, matches):
    p = spark.createDataFrame(papers, "paper_id long, full_text string")
    m = spark.createDataFrame(matches, "paper_id long, rank int, title string, similarity double, matched_text string")
    return {r.paper_id: r for r in S.overlay(p, m).collect()}


def test_marks_are_those_of_a_plain_search(spark):
    rng = random.Random(5)
    papers, matches = [], []
    for i in range(60):
        text = "".join(rng.choice("abAB ") for _ in range(300))
        own = []
        for k in range(rng.randrange(7)):
            a = rng.randrange(280)
            own.append((k + 1, rng.choice([text[a : a + rng.randrange(8, 40)].upper(), "ab" * 6, text[a : a + 12]])))
        papers.append((i, text))
        matches += [(i, k, f"T{k}", 70.5, m) for k, m in own]
    found = overlaid(spark, papers, matches)
    total = 0
    for i, text in papers:
        want = plain(text, [(k, m) for j, k, _, _, m in matches if j == i])
        got, at = [], 0
        for piece in re.split(r'(<mark title="T\d+ \(70\.5%\)">.*?</mark>)', found[i].marked):
            inside = re.fullmatch(r'<mark title="T(\d+) \(70\.5%\)">(.*)</mark>', piece, re.S)
            if inside:
                got.append((at, int(inside[1]), inside[2]))
            at += len(inside[2] if inside else piece)
        assert got == want and found[i].marks == len(want)
        assert re.sub(r"</?mark[^>]*>", "", found[i].marked) == text
        total += len(want)
    assert total > 100


def test_overlaps_patterns_and_odd_rows(spark):
    papers = [(1, "the first long sentence stands; long sentence stands alone"), (2, "a+b (c) [d] $1 \\Q.* and A+B (C) [D] $1 \\q.*"), (3, None), (4, ""), (5, "no match here at all"), (6, "STRASSE und Übermaß, ÜBERMASS und übermaß")]
    matches = [
        (1, 1, "short", 60.0, "long sentence stands"), (1, 2, "long", 61.0, "first long sentence"), (1, 3, "tiny", 62.0, "the"), (1, 4, None, 63.0, None),
        (2, 1, 'say "x"', 70.0, "a+b (c) [d] $1 \\Q.*"), (3, 1, "t", 70.0, "anything at all"), (4, 1, "t", 70.0, "anything at all"), (6, 1, "t", 70.0, "und übermaß"), (9, 1, "t", 70.0, "of no paper at all"),
    ]
    found = overlaid(spark, papers, matches)
    # of 20 and 19 characters: the longer one wins where they overlap, though it starts later
    assert found[1].marked == 'the first <mark title="short (60.0%)">long sentence stands</mark>; <mark title="short (60.0%)">long sentence stands</mark> alone'
    assert found[2].marks == 2 and found[2].marked.startswith('<mark title="say &quot;x&quot; (70.0%)">a+b (c) [d] $1 \\Q.*</mark> and <mark')
    assert (found[3].marks, found[3].marked) == (0, None) and (found[4].marks, found[4].marked) == (0, "")
    assert (found[5].marks, found[5].marked) == (0, "no match here at all")
    assert found[6].marks == 2 and set(found) == {1, 2, 3, 4, 5, 6}


def test_sentences_are_marked_over_fifty(spark):
    rows = spark.createDataFrame([("One. Two?  Three", 50.1), ("One. Two", 50.0), ("", 90.0), (None, 90.0)], "t string, p double").select(S.machine_overlay(F.col("t"), F.col("p")).alias("m")).collect()
    assert [r.m for r in rows] == ["<mark>One.</mark> <mark>Two?</mark> <mark>Three</mark>", "One. Two", "<mark></mark>", None]


def plain_chunks(pieces, least=35):
    done, now = [], []
    for s in pieces:
        now.append(s)
        if sum(len(x.split()) for x in now) >= least:
            done.append(". ".join(now) + ".")
            now = now[-2:]
    return done + ([". ".join(now) + "."] if now else [])


def test_chunks_are_those_of_a_plain_loop(spark):
    rng = random.Random(6)
    texts = []
    for n in [0, 1, 2, 3, 5, 8, 20, 33, 64, 65, 300]:
        for words in ((1, 2), (3, 12), (30, 50), (1, 60)):
            texts.append([" ".join(f"word{rng.randrange(10)}word" for _ in range(rng.randint(*words))) for _ in range(n)])
    rows = spark.createDataFrame([(i, ".\n".join(t) + "." * (i % 2)) for i, t in enumerate(texts)], "i int, t string").select("i", S.chunks(F.col("t")).alias("c")).collect()
    for r in rows:
        assert r.c == plain_chunks(texts[r.i])
    none = spark.createDataFrame([(None,), ("short. bits. no",), (" . . .",)], "t string").select(S.chunks(F.col("t")).alias("c")).collect()
    assert [r.c for r in none] == [None, [], []]


def test_chunking_time_grows_with_the_text(spark):
    import time

    def seconds(n):
        row = spark.range(1).select(F.repeat(F.lit("seven words stand in this short sentence. "), n).alias("t"))
        began = time.perf_counter()
        assert row.select(F.size(S.chunks(F.col("t"))).alias("n")).first().n > n // 5
        return time.perf_counter() - began

    seconds(1000)
    small, large = seconds(30_000), seconds(240_000)
    assert large < 24 * small + 5  # a loop that copies its list would need 64 times as long
