"""Writing conventions: sections, tone, citation style and linkage, figures, headings."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.operators.sections import APA, IEEE, gathered

# What is expected, what counts as informal, and the weights of the checks.
EXPECTED = ("abstract", "introduction", "methods", "results", "conclusion")
EDGE, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# each begins with a look at the next letter, which rules most places out sooner than the look behind
INFORMAL = ("gonna", "wanna", "gotta", "kids", "stuff", "things like", "a lot of", "very nice", "pretty good", "super important", "huge deal")
COLLOQUIAL = rf"(?i)(?=[gwkstavph]){EDGE}({'|'.join(INFORMAL)}){END}"
FIRST_PERSON = rf"(?=[Iwmo]){EDGE}(I|we|my|our|ours){END}"
FIGURE = rf"(?=[FT]){EDGE}(?:Figure|Fig\.|Table)\s+\d+"
WEIGHTS = {"structure": 0.30, "tone": 0.20, "style": 0.20, "linkage": 0.15, "figures": 0.075, "hierarchy": 0.075}
CHECKED = (*WEIGHTS, "citation_style", "section_map", "writing_score", "grade")


def parts(rows: DataFrame) -> DataFrame:
    """(paper_id, full_text, labels, body, refs, n_refs, headings) of sections.sectioned() rows: what the checks look at."""
    texts = lambda keep, glue: F.array_join(F.transform(F.filter("secs", keep), lambda s: s["text"]), glue)
    of = lambda c: F.transform("secs", lambda s: s[c])
    return rows.select(
        "paper_id", "full_text", F.array_distinct(of("label")).alias("labels"), texts(lambda s: s["label"] != "references", " ").alias("body"), texts(lambda s: s["label"] == "references", "\n").alias("refs"),
        F.size(F.filter("secs", lambda s: s["label"] == "references")).alias("n_refs"), F.transform("secs", lambda s: F.struct(s["heading"].alias("heading"), s["label"].alias("label"))).alias("headings"),
    )


def missing_sections(labels: Column) -> Column:
    return F.array_except(F.array(*(F.lit(x) for x in EXPECTED)), labels)


def structure(labels: Column) -> Column:
    missing = F.size(missing_sections(labels))
    return F.when(missing == 0, 100.0).otherwise(F.greatest(F.lit(0), 100 - missing * 18) * F.when(F.array_contains(labels, "discussion"), 1.0).otherwise(0.85))


def tone_issues(text: Column) -> Column:
    exclaimed = text.contains("!")  # then some sentence holds it
    # patterns and counts that take long are tried only where they can matter
    informal = T.bound(F.lower(text), lambda low: reduce(or_, (low.contains(x) for x in INFORMAL))) & text.rlike(COLLOQUIAL)
    personal = T.bound(T.count(text, FIRST_PERSON), lambda n: (n > 0) & (n / F.greatest(T.count(text, T.WORD_RUN), F.lit(1)) > 0.03))
    return F.when(~text.rlike(r"\S"), 0).otherwise(exclaimed.cast("int") + informal.cast("int") + personal.cast("int"))


def tone(issues: Column) -> Column:
    return F.greatest(F.lit(0), 100 - issues * 22).cast("double")


def style(body: Column) -> Column:
    ieee, apa = body.rlike(IEEE), body.rlike(APA)
    return F.when(ieee & apa, "mixed").when(ieee, "ieee").when(apa, "apa").otherwise("none")


def style_score(found: Column, n_refs: Column) -> Column:
    return F.when(found == "mixed", 55.0).when(found != "none", 95.0).when(n_refs > 0, 30.0).otherwise(70.0)


def orphans(body: Column, refs: Column) -> Column:
    """Numbers in the reference list that the body never cites."""
    return F.array_except(F.array_distinct(T.found(refs, IEEE)), T.found(body, IEEE))


def linkage(n: Column) -> Column:
    return F.when(n == 0, 100.0).otherwise(F.greatest(F.lit(10), 100 - n * 15).cast("double"))


def missing_figures(text: Column, body: Column) -> Column:
    declared, called = T.count(text, FIGURE), T.count(body, FIGURE)
    return F.when(declared > called + 1, declared - called).otherwise(0)


def figures(missing: Column) -> Column:
    return F.when(missing == 0, 100.0).otherwise(F.greatest(F.lit(20), 100 - missing * 20).cast("double"))


def hierarchy(headings: Column) -> Column:
    """25 less for numbered and other headings together, and for numbers that aren't 1, 2, 3, ..."""
    named = F.filter(headings, lambda h: h["heading"] != "")
    numbers = F.transform(F.filter(named, lambda h: h["heading"].rlike(r"^\d")), lambda h: F.regexp_extract(h["heading"], r"^(\d+)", 1).try_cast("int"))
    n = F.size(numbers)
    mixed = (n > 0) & (n < F.size(named))
    skipped = F.when(n >= 2, numbers != F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(False)
    return (100 - (mixed.cast("int") + skipped.cast("int")) * 25).cast("double")


def grade(score: Column) -> Column:
    return F.when(score >= 80, "Meets standard").when(score >= 55, "Minor issues").otherwise("Needs revision")


def quality(papers: DataFrame, secs: DataFrame) -> DataFrame:
    """(paper_id, *checks, writing_score, grade, citation_style, section_map): the weighted checks. A label's last heading is kept."""
    return checked(gathered(papers.select("paper_id", "full_text"), secs))


def checked(rows: DataFrame) -> DataFrame:
    """quality() of sections.sectioned() rows, in one projection. Papers without a section are left out."""
    text, body, found = F.col("full_text"), F.col("body"), F.col("found")
    # in columns of their own, as what is exploded is evaluated as often as it stands there
    p = parts(rows).select(
        "paper_id", "labels", "n_refs", "headings", tone_issues(text).alias("issues"), style(body).alias("found"), F.size(orphans(body, F.col("refs"))).alias("orphans"), missing_figures(text, body).alias("missing"),
    )
    last = lambda x: F.element_at(F.filter("headings", lambda h: h["label"] == x), -1)["heading"]
    checks = F.struct(
        structure(F.col("labels")).alias("structure"), tone(F.col("issues")).alias("tone"), style_score(found, F.col("n_refs")).alias("style"), linkage(F.col("orphans")).alias("linkage"), figures(F.col("missing")).alias("figures"),
        hierarchy(F.col("headings")).alias("hierarchy"), F.when(found == "ieee", "ieee").otherwise("none").alias("citation_style"),
        F.map_from_entries(F.transform("labels", lambda x: F.struct(x.alias("k"), last(x).alias("v")))).alias("section_map"),
    )
    # exploded, not filtered, as a filter would go below the projection and make the sections twice
    some = p.select("paper_id", F.explode_outer(F.when(F.size("labels") > 0, F.array(checks))).alias("c")).where("c is not null").select("paper_id", "c.*")
    score = T.half_even(F.round(sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)), 9)).cast("int")
    return some.withColumn("writing_score", score).withColumn("grade", grade(F.col("writing_score")))
