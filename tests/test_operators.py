"""Operators on a few rows whose results follow from their rules by hand."""

from __future__ import annotations

import datetime as dt
import io
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators import citations, numeric, provenance, scoring, sections, serving, similarity, stylometry, writing
from quillmark.plans import queries
from quillmark.plans.analyze import analyze, score_stream
from quillmark.sources import papers
from quillmark.streaming import rate_limit
from tests.oracle import DATA, duck_rows, spark_rows

PAPER = """A title of a paper

Abstract
We study orders. They are many.
1. Introduction
Earlier work is cited in [1] and it says that orders are many.
2. Methods
We count them.
3. Results
The p = 0.03 and the p < 0.001 were found.
Conclusion
Orders are many indeed.
References
[1] On orders. doi: 10.1000/aabc.1.
[2] A book.
"""


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def paper(spark, text):
    return spark.createDataFrame([(1, "a.txt", text)], "paper_id long, filename string, full_text string")


def test_sections_are_found_and_the_title_joins_the_first(spark):
    rows = sections.sections(paper(spark, PAPER)).orderBy("idx").collect()
    assert [r.label for r in rows] == ["abstract", "introduction", "methods", "results", "conclusion", "references"]
    assert rows[0].text.startswith("A title of a paper\n\nWe study")
    assert rows[1].heading == "1. Introduction"


@pytest.mark.parametrize("text", ["", " \n \n"])
def test_blank_paper_has_one_empty_section(spark, text):
    rows = sections.sections(paper(spark, text)).collect()
    assert [(r.idx, r.label, r.text) for r in rows] == [(0, "other", "")]


def test_chunks_carry_two_sentences_over(spark):
    s = ". ".join(f"sentence number {i} has exactly ten words in it now ok" for i in range(6)) + "."
    found = one(spark, s, sections.chunks(F.col("t")).alias("c")).c
    assert found[0].count("sentence number") == 4
    assert found[1].startswith("sentence number 2")
    assert one(spark, "", sections.chunks(F.col("t")).alias("c")).c == []


def test_p_values_count_twice(spark):
    r = one(spark, "we saw p = 0.031 and p-value of 0.004, p = 0.42, gap = 12.5", numeric.p_values(F.col("t")).alias("p"))
    assert sorted(r.p) == [0.031, 0.031, 0.42, 0.42, 12.5]


def test_constant_digits_are_flagged(spark):
    r = numeric.statistics(paper(spark, " ".join(["123.45"] * 40))).first()
    assert [(f.category, f.severity) for f in r.findings] == [("digit-preference bias", "high")]
    assert r.statistical_risk == 15


def test_fingerprint_without_numbers_is_69(spark):
    assert numeric.fingerprint(paper(spark, "no numbers here")).first().fingerprint == 69


def test_fingerprint_of_unreadable_number_is_null(spark):
    r = numeric.fingerprint(paper(spark, "it was 3.4 ± 1.2.")).first()
    assert r.precision is None and r.fingerprint is None


def test_benford_saturates(spark):
    r = one(spark, ", ".join(["1"] * 3), numeric.benford(F.array(*[F.lit("1")] * 25)).alias("b"))
    assert r.b == 98


def test_heuristic_of_repetitive_text_is_70(spark):
    s = ". ".join(["furthermore we propose a novel framework that in this paper we delve into"] * 8)
    assert 0.6 <= one(spark, s, stylometry.heuristic(F.col("t")).alias("h")).h <= 0.98


def test_dois_are_trimmed_and_once(spark):
    r = one(spark, "10.1000/aabc.1. and 10.1000/aabc.1, (10.2000/x;y)", citations.dois(F.col("t")).alias("d"))
    assert r.d == ["10.1000/aabc.1", "10.2000/x;y"]


@pytest.mark.parametrize(("n", "valid", "bare", "score"), [(0, 0, 0, 55), (4, 0, 0, 15), (4, 4, 0, 100), (0, 0, 1, 8), (2, 1, 3, 36)])
def test_validity_score(spark, n, valid, bare, score):
    assert one(spark, "", citations.validity_score(F.lit(n), F.lit(valid), F.lit(bare)).alias("s")).s == score


@pytest.mark.parametrize(("n", "retracted", "score"), [(0, 0, 0), (20, 1, 52), (4, 1, 85), (1, 1, 100)])
def test_contamination(spark, n, retracted, score):
    p = spark.createDataFrame([(1,)], "paper_id long")
    d = spark.createDataFrame([(1, f"d{i}", i < retracted) for i in range(n)], "paper_id long, doi string, retracted boolean")
    assert provenance.contamination(d, p).first().contamination == score


def test_similarity_score(spark):
    assert one(spark, "", similarity.plagiarism_score(F.lit(80.0), F.lit(3), F.lit(0)).alias("s")).s == 66
    assert one(spark, "", similarity.plagiarism_score(F.lit(None).cast("double"), F.lit(0), F.lit(3)).alias("s")).s == 56


def test_writing_of_whole_paper(spark):
    p = paper(spark, PAPER)
    r = writing.quality(p, sections.sections(p)).first()
    assert r.structure == 100 and r.citation_style == "ieee" and r.linkage == 85 and r.hierarchy == 75
    assert r.section_map["results"] == "3. Results"


@pytest.mark.parametrize(("ai", "plag", "cit", "risk", "writing_score", "score", "verdict"), [(10.0, 5, 80, 5, 80, 87, "Credible"), (80.0, 5, 80, 5, 80, 70, "Needs review")])
def test_credibility(spark, ai, plag, cit, risk, writing_score, score, verdict):
    row = (1, ai, plag, cit, risk, writing_score, "low", 0, 2, 1, 3)
    names = "paper_id long, ai_probability double, plagiarism_score int, citation_score int, statistical_risk int, writing_score int, ai_confidence string, n_matches long, total_dois long, valid_dois long, bare_references int"
    r = scoring.credibility(spark.createDataFrame([row], names)).first()
    assert (r.credibility, r.verdict) == (score, verdict)
    assert len(r.flags) == 3 and "Look up by hand the references that have no DOI." in r.action_items


@pytest.mark.parametrize(("question", "topic"), [("explain the citation score", "ai"), ("Who is the author of this paper?", "none"), ("OVERALL?", "overall"), ("doi?", "citation")])
def test_topic(spark, question, topic):
    assert one(spark, question, serving.topic(F.col("t")).alias("x")).x == topic


@pytest.mark.parametrize(("name", "content", "error"), [("a.txt", b"plain", None), ("a.pdf", b"plain", "aren't those"), ("a.exe", b"MZ", "No reader"), ("a.txt", "é".encode(), "no known kind"), ("a.docx", b"PK\x03\x04..", None)])
def test_upload(spark, name, content, error):
    r = spark.createDataFrame([(name, bytearray(content))], "f string, c binary").select(papers.upload_error(F.col("f"), F.col("c")).alias("e")).first()
    assert (r.e is None) if error is None else error in r.e


def test_files_of_each_kind(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain text")
    (tmp_path / "b.exe").write_bytes(b"MZ")
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04broken")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Intro</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(buffer := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.docx").write_bytes(buffer.getvalue())
    rows = {r.filename: r for r in papers.papers_from_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].full_text == "plain text" and rows["d.docx"].full_text == "\nIntro\n\none two"
    assert rows["b.exe"].error.startswith("No reader") and rows["c.docx"].error


def test_corpus_and_retraction_files(spark, tmp_path):
    long = " ".join(["word"] * 15)
    (tmp_path / "c.jsonl").write_text(f'{{"title":"A","text":"{long}"}}\nnot json\n{{"title":"B","text":"short"}}\n')
    assert [(r.title, r.corpus) for r in papers.corpus_from_jsonl(spark, str(tmp_path / "c.jsonl")).collect()] == [("A", "arxiv")]
    (tmp_path / "r.csv").write_text("OriginalPaperDOI,RetractionDate,Reason,RetractionNature\n10.1/a,2001,x,Retraction\n,2002,y,Retraction\n10.1/a,2003,z,Correction\n")
    assert [tuple(r) for r in papers.retractions_from_csv(spark, str(tmp_path / "r.csv")).collect()] == [("10.1/a", "2003", "z", "Correction")]


def requests(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(seconds=s)) for s in (0, 10, 20, 60, 61, 62)] + [("b", start), (None, start)]
    return spark.createDataFrame(rows, "client string, ts timestamp")


def test_rate_limit(spark):
    rows = rate_limit.limited(requests(spark), limit=3, seconds=60).where("client = 'a'").orderBy("ts").collect()
    assert [r.n for r in rows] == [1, 2, 3, 4, 1, 2]
    assert [r.allowed for r in rows] == [True, True, True, False, True, True]


def test_rate_limit_of_a_stream_equals_the_batch(spark, tmp_path):
    requests(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in"))
    q = rate_limit.limited_stream(stream, limit=3).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, rate_limit.limited(requests(spark), limit=3).collect()))
    assert sorted(map(tuple, spark.table("limited").collect())) == want


def test_notices_withdraw_by_type_or_label(spark):
    rows = [("a", [("correction", "Correction", 1), (None, "RETRACTED: x", 2001)]), ("b", [("retraction", None, None)]), ("c", [("update", "Not retracted", 3)]), ("d", None), ("e", [])]
    works = citations.noticed(spark.createDataFrame(rows, "doi string, update_to array<struct<type string, label string, year int>>"))
    assert {tuple(r) for r in works.collect()} == {("a", True, "RETRACTED: x", "2001"), ("b", True, None, None), ("c", False, None, None), ("d", False, None, None), ("e", False, None, None)}
    checked = works.select(F.lit(1).alias("paper_id"), "doi", F.lit(True).alias("valid"))
    listed = spark.createDataFrame([("c", "1999", "Data", "Retraction")], "doi string, retraction_date string, reason string, notice_type string")
    found = {r.doi: tuple(r)[2:] for r in citations.retracted(checked, works, listed).collect()}
    assert found["a"] == (True, "2001", "RETRACTED: x", "retraction") and found["b"] == (True, None, "registry notice", "retraction")
    assert found["c"] == (True, "1999", "Data", "Retraction") and found["d"][0] is False


def inputs(spark):
    body = " ".join(f"Sentence {i} of the paper tells about measure{i} and sample{i} in plain words." for i in range(12))
    rows = [(i, f"{i}.txt", f"Abstract\nOwn words {i}. {body}\nReferences\n[1] A. doi: 10.1000/aa\n[2] B. doi: 10.1000/bb\n") for i in (1, 2)] + [(3, "3.txt", "too short")]
    found = spark.createDataFrame(rows, "paper_id long, filename string, full_text string")
    corpus = spark.createDataFrame([(1, "Copied", body, "arxiv"), (2, "Other", body.replace("sample", "thing") + " more", "arxiv"), (3, "Third", "unlike words stand here alone", "arxiv")], "item_id long, title string, text string, corpus string")
    return found, corpus


def works_of(spark):
    data = "/root/testdata/sf0.001"
    works = papers.works(spark, data)
    own = spark.createDataFrame([("10.1000/aa",), ("10.1000/bb",)], "doi string")
    for field in works.schema.fields[1:]:
        own = own.withColumn(field.name, F.lit(False) if field.name == "withdrawn" else F.lit(None).cast(field.dataType))
    retractions = spark.createDataFrame([("10.1000/aa", "2001", "Data", "Retraction")], "doi string, retraction_date string, reason string, notice_type string")
    return own, retractions


def test_a_result_lists_its_evidence(spark):
    found, corpus = inputs(spark)
    works, retractions = works_of(spark)
    query = found.where("paper_id = 1").select(F.split("full_text", "\n")[1].alias("t")).first().t
    searched = spark.createDataFrame([(query[:200], "google", 1, "http://x", "Own words of the paper", query)], "query string, provider string, rank int, url string, title string, description string")
    held = []
    rows = {r.paper_id: r for r in analyze(found, corpus, works, retractions, searched=searched, held=held).collect()}
    assert set(rows) == {1, 2} and rows[1].n_matches == len(rows[1].matches) > 0 and rows[1].matches[0].title == rows[1].top_title
    assert [x.doi for x in rows[1].retractions] == [x.doi for x in rows[2].retractions] and rows[1].retractions[0].doi == "10.1000/aa"
    assert [x.url for x in rows[1].web_matches] == ["http://x"] and rows[2].web_matches == []
    whole = analyze(found, corpus, works, retractions, searched=searched, held=held)
    exported = {r.paper_id: json.loads(r.json) for r in serving.json_rows(whole).collect()}
    assert set(exported[1]) == set(whole.columns) and exported[1]["verdict"] == rows[1].verdict and len(exported[1]["matches"]) == rows[1].n_matches and exported[2]["web_matches"] == []
    for df in held:
        df.unpersist()


def test_score_stream_appends_new_papers_and_gives_memory_back(spark, tmp_path):
    found, corpus = inputs(spark)
    works, retractions = works_of(spark)
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    for part in ("1", "2"):  # the second run sees a paper that has a result, under another id
        found.withColumn("paper_id", F.col("paper_id") + int(part)).where(f"paper_id < {2 + int(part)}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(found.schema).parquet(str(tmp_path / "in"))
        score_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), corpus, works, retractions).awaitTermination(300)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.file_hash for r in rows) == sorted({r.file_hash for r in rows}) and len(rows) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= kept


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    lines = []
    for i in range(4000):
        lines.append(["", "  ", "{broken", "[1]", '"text"', f'{{"text": "{long} {i}"}}', f'{{"title": "", "text": "{long} {i}", "corpus": ""}}', f'{{"title": "T{i}", "text": "{long}", "corpus": "c"}}', '{"text": "short"}', '{"title": "x"}', "{'text': 'q'}"][i % 11])
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        found = sorted(map(tuple, papers.corpus_from_jsonl(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [(4000 * k + i + 1, f"T{i}" if i % 11 == 7 else f"Entry {i + 1}", long if i % 11 == 7 else f"{long} {i}", "c" if i % 11 == 7 else "arxiv") for k in (0, 1) for i in range(4000) if i % 11 in (5, 6, 7)]
    assert found == sorted(want)


def test_rounding_goes_to_the_even_digit_where_a_double_is_next_to_a_tie(spark):
    xs = [53.349999999999994, 53.25, 53.35, 26.35, -26.35, 0.049999999999999996, 3.4999999999999996, 2.5, 3.5, 0.0, 100.0, 12.3456]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.half_even(F.col("x"), 1).alias("one"), T.half_even(F.col("x")).alias("none")).collect()
    con = duckdb.connect()
    assert {r.x: (r.one, r.none) for r in rows} == {x: con.execute("SELECT round_even(?::DOUBLE, 1), round_even(?::DOUBLE, 0)", [x, x]).fetchone() for x in xs}
    assert rows[0].one == 53.4


def test_a_papers_patterns_are_searched_for_once(spark):
    papers = spark.createDataFrame([(1, "p = 0.05, 100% of 1.25")], "paper_id long, full_text string")
    plan = numeric.statistics(papers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4  # two for p-values, decimals, percentages
    plan = numeric.fingerprint(papers)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 8  # counting is finding, too


def test_findings_are_not_made_again_to_filter_them(spark):
    from quillmark.plans import queries

    plan = queries.QUERIES["t5_digit_preference"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 4


def test_the_batch_analysis_holds_no_text_in_a_cache(spark):
    from quillmark.plans import queries

    out = queries.analyzed(spark, "/root/testdata/sf0.001")
    assert "InMemoryTableScan" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0


def planned(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def several(spark):
    rows = [(i, f"{i}.txt", PAPER.replace("orders", f"orders {i}") * (1 + i % 2)) for i in range(12)]
    return spark.createDataFrame([*rows, (20, "n", None), (21, "b", "  \n"), (22, "x", "3 Foo"), (23, "y", "Words alone stand here.")], "paper_id long, filename string, full_text string")


def test_what_a_papers_own_text_gives_is_made_in_its_row(spark):
    found = sections.sectioned(several(spark))
    for df in (sections.listed(found), sections.section_chunks(sections.listed(found)), sections.citing_rows(found), writing.checked(found), stylometry.vector(several(spark))):
        assert "Exchange" not in planned(df, "executedPlan")


def test_what_is_exploded_is_made_once(spark):
    found = sections.sections(several(spark).where("paper_id < 3")).select("paper_id", "idx", F.concat("text", F.lit("")).alias("text"))
    assert planned(sections.section_chunks(found)).count("array_min(") == planned(found.select(sections.chunks(F.col("text")).alias("c"))).count("array_min(")
    assert planned(citations.cited(several(spark))).count("regexp_extract_all") == 1


def test_papers_without_sections_have_no_writing_score(spark):
    papers = several(spark)
    one, two = writing.checked(sections.sectioned(papers)), writing.quality(papers, sections.sections(papers))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert {r.paper_id for r in one.collect()} == {*range(12), 21, 23}


def test_terms_are_searched_once(spark):
    from quillmark.operators import detector

    assert planned(several(spark).select(similarity.terms(F.col("full_text")).alias("t"))).count("regexp_extract_all") == 1
    assert planned(several(spark).select(detector.terms(F.col("full_text")).alias("t"))).count("regexp_extract_all") == 1


def test_latin_words_are_whole_runs(spark):
    text = "Ab c3 déf_ x yz-zy_a naïve abcé éabc 12ab ab12 so, On\nend"
    want = ["ab", "yz", "so", "on", "end"]
    assert one(spark, text, T.latin_words(F.col("t")).alias("w")).w == want


def test_repeated_chunks_of_a_row_are_those_of_all_pairs(spark):
    import random

    r = random.Random(3)
    words = [f"word{i:03d}" + "x" * (i % 7) for i in range(60)]
    rows = []
    for p in range(6):
        own = []
        for _ in range(30):
            c = r.sample(words, 32) if not own or r.random() < 0.4 else list(r.choice(own))
            for _ in range(r.randrange(4)):
                c[r.randrange(len(c))] = r.choice(words)
            own.append(c)
        rows.append((p, [(k // 7, k % 7, " ".join(c)) for k, c in enumerate(own)]))
    lists = spark.createDataFrame(rows, "paper_id long, chunks array<struct<idx:int,pos:int,chunk:string>>")
    want = []
    for p, own in rows:
        sets, seen = [set(c.split()) for _, _, c in own], set()
        for i, (idx, pos, c) in enumerate(own):
            for j in range(i + 1, len(own)):
                a, b = len(sets[i]), len(sets[j])
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if min(a, b) >= 25 and a >= 0.7 * b and b >= 0.7 * a and s >= 0.85 and c[:150] not in seen:
                    seen.add(c[:150])
                    want.append((p, idx, pos, c[:180], round(s * 100, 1)))
    rowwise = similarity._repeated(lists)
    assert "Exchange" not in planned(rowwise, "executedPlan")
    got = sorted((x.paper_id, x.idx, x.pos, x.matched_text, x.similarity) for x in rowwise.collect())
    assert got == sorted(want) and len(want) > 30
    assert sorted(map(str, similarity.duplicates(lists.select("paper_id", F.inline("chunks"))).collect())) == sorted(map(str, rowwise.collect()))


def test_a_paper_of_very_many_chunks_is_done_as_rows(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(30))
    lists = spark.createDataFrame([(p, [(0, k, text) for k in range(n)]) for p, n in ((1, 3), (2, 9))], "paper_id long, chunks array<struct<idx:int,pos:int,chunk:string>>")
    want = sorted(map(str, similarity.repeated(lists).collect()))
    monkeypatch.setattr(similarity, "MANY", 4)
    assert sorted(map(str, similarity.repeated(lists).collect())) == want and len(want) == 2


@pytest.mark.parametrize(("name", "idle"), [("f5_flags", ((provenance, "provenance"), (writing, "checked"), (similarity, "repeated"))), ("f12_bands", ((provenance, "provenance"),))])
def test_what_no_wanted_column_comes_from_is_not_computed(spark, monkeypatch, name, idle):
    for module, part in idle:
        monkeypatch.setattr(module, part, None)
    assert spark_rows(queries.QUERIES[name](spark, DATA)) == duck_rows(queries.ORACLE_SQL[name])
