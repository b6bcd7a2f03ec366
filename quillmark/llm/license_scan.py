"""Licence scans: ordered signature rules, gated by keywords, resolved by rank and containment. Native: SQL functions only."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import stored
from quillmark.llm.license_rules import EXACT, HINT, NAME, compiled, rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, and words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always reported, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: How sure a detection of each rank leaves one that a licence is meant.
DOUBT = (0.1, 0.3, 0.8)
FOUND = "array<struct<start:bigint,back:bigint,rank:int,number:int,label:string>>"


def keywords() -> dict[str, list[str]]:
    """The substrings that each rule's keyword asks for."""
    return {r.keyword: r.keyword.split("+") for r in rules()}


def place(match: Column, at: int) -> Column:
    """The place of a match's first (0) or last (-1) word."""
    marked = F.split(F.trim(match), " +")
    return F.substring_index(marked[0] if at == 0 else F.element_at(marked, -1), "#", -1).cast("long")


def places(marked: Column, rule: Column) -> Column:
    """Where the rule's pattern stands, in words; back is the place behind it, negated, so that longer ones sort first."""
    return F.transform(F.regexp_extract_all(marked, rule["regex"], F.lit(0)), lambda m: F.struct(place(m, 0).alias("start"), (-1 - place(m, -1)).alias("back"), rule["rank"], rule["number"], rule["label"]))


def resolved(found: DataFrame) -> DataFrame:
    """Of detections (id, start, back, rank, number, label) those that stay: one that holds another of better rank goes; of the rest, one that lies inside another of the same or better rank."""
    order = ["start", "back", "rank", "number"]
    behind = Window.partitionBy("id").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    end, rank = -F.col("back"), F.col("rank")
    holds = [F.min(F.when(rank < r, end)).over(behind) <= end for r in (NAME, HINT)]
    first = found.withColumn("holds", F.coalesce(F.when(rank == NAME, holds[0]).when(rank == HINT, holds[1]), F.lit(False))).where("not holds").drop("holds")
    inside = [F.max(F.when(rank <= r, end)).over(before) >= end for r in (EXACT, NAME, HINT)]
    return first.withColumn("inside", F.coalesce(F.when(rank == EXACT, inside[0]).when(rank == NAME, inside[1]).otherwise(inside[2]), F.lit(False))).where("not inside").drop("inside")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections, detections of every row of docs.

    detections: (start, end, label, rank, rule) of what the rules find and resolved() keeps, start
    and end in words from 0, null if there are none. labels are theirs and those of PHRASES, all of which are counted.
    score is the chance that at least one detection is right. A null text is an empty one; null and
    repeated doc_id keep their rows; other columns are ignored. Texts are read whole and never
    shuffled, only the places of detections are.
    """
    atoms = list(dict.fromkeys(a for needs in keywords().values() for a in needs))
    groups = [{"needs": needs, "rules": [r._asdict() for r in rules() if r.keyword == k]} for k, needs in keywords().items()]
    table = F.from_json(F.lit(json.dumps(groups)), "array<struct<needs:array<string>,rules:array<struct<rank:int,number:int,label:string,regex:string>>>>")
    lower = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = docs.select("doc_id", lower.alias("lower"))
    here = [F.when(F.col("lower").rlike(GAP.join(a.split(" "))) if " " in a else F.contains(F.col("lower"), F.lit(a)), a) for a in atoms]
    rows = rows.select("doc_id", "lower", F.array_compact(F.array(*here)).alias("here"))
    tried = F.flatten(F.transform(F.filter(table, lambda g: F.size(F.array_except(g["needs"], F.col("here"))) == 0), lambda g: g["rules"]))
    rows = rows.select("doc_id", F.regexp_count("lower", F.lit(WORD)).cast("long").alias("n_words"), F.when(F.size("here") > 0, tried).alias("tried"), "lower")
    words = F.regexp_extract_all("lower", F.lit(WORD), F.lit(0))
    marked = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i, F.lit(" "))), "")
    rows = rows.select("doc_id", "n_words", "tried", F.when(F.size("tried") > 0, marked).otherwise("").alias("marked"))
    phrases = {compiled(phrase): label for phrase, label in PHRASES.items()}  # a rule of their family is tried wherever one of them stands
    base = F.regexp_extract_all("marked", F.lit("|".join(phrases)), F.lit(0))
    told = F.array_sort(F.array_compact(F.array(*(F.when(F.col("marked").rlike(p), label) for p, label in phrases.items()))))
    matching = F.filter(F.coalesce("tried", F.array().cast("array<struct<rank:int,number:int,label:string,regex:string>>")), lambda r: F.rlike(F.col("marked"), r["regex"]))
    found = F.flatten(F.transform(matching, lambda r: places(F.col("marked"), r))).cast(FOUND)
    rows = rows.select("doc_id", "n_words", base.alias("base"), told.alias("told"), found.alias("found"))
    first, last = (F.when(F.size("base") > 0, place(F.element_at("base", at or 1), 0)) for at in (0, -1))
    rows, _ = stored(rows.select(F.monotonically_increasing_id().alias("id"), "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"), "told", "found"))
    kept = resolved(rows.where(F.size("found") > 0).select("id", F.inline("found")))
    one = F.struct("start", (-F.col("back")).alias("end"), "label", "rank", F.col("number").alias("rule"))
    counts = [F.count(F.when(F.col("rank") == r, 1)).alias(f"n{r}") for r in range(len(DOUBT))]
    kept = kept.groupBy("id").agg(F.collect_set("label").alias("said"), F.sort_array(F.collect_list(one)).alias("detections"), *counts)
    out = rows.where(F.size("found") > 0).join(kept, "id").unionByName(rows.where(F.size("found") == 0), allowMissingColumns=True)
    doubt = F.lit(1.0)
    for r, p in enumerate(DOUBT):
        doubt = doubt * F.pow(F.lit(p), F.coalesce(f"n{r}", F.lit(0)))
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("told", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("told", F.coalesce("said", none))), ",").alias("labels"), F.round(1 - doubt, 6).alias("score"),
        F.coalesce(F.col("n0") + F.col("n1") + F.col("n2"), F.lit(0)).alias("n_detections"), "detections",
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("detections")


def op11_sql() -> str:
    """The rows of the query in SQL: every rule on every text, detections compared with each other."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({r.rank}, {r.number}, {quoted(r.label)}, {quoted(r.regex.replace(chr(35) + chr(92) + 'd+', ''))}, {r.keyword.replace(' ', '+').split('+')})" for r in rules())
    phrases = ", ".join(f"({quoted(''.join(f' {w} ' for w in p.split(' ')))}, {quoted(label)})" for p, label in PHRASES.items())
    count = "((length({0}) - length(replace({0}, ' ', ''))) // 2)".format
    places = f"""list_transform(range(1, len(hits) + 1), lambda i: {{'start': list_sum([0] || list_transform(parts[1:i], lambda p: {count("p")})) + list_sum([0] || list_transform(hits[1:i - 1], lambda h: {count("h")})), 'width': {count("hits[i]")}}})"""
    return f"""WITH rules(rank, number, label, regex, needs) AS (VALUES {table}), phrases(phrase, label) AS (VALUES {phrases}),
    given AS (SELECT row_number() OVER () AS id, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS lower FROM documents),
    texts AS (SELECT id, doc_id, lower, len(regexp_extract_all(lower, '{WORD}')) AS n_words, CASE WHEN regexp_matches(lower, '{WORD}') THEN ' ' || trim(regexp_replace(lower, '{GAP}', '  ', 'g'), ' ') || ' ' ELSE '' END AS spaced FROM given),
    split AS MATERIALIZED (SELECT id, rank, number, t.label, regexp_extract_all(spaced, regex) AS hits, string_split_regex(spaced, regex) AS parts FROM texts JOIN rules t ON list_bool_and(list_transform(needs, lambda n: contains(lower, n))) WHERE regexp_matches(spaced, regex)),
    listed AS (SELECT id, rank, number, label, unnest({places}) AS p FROM split),
    found AS (SELECT id, rank, number, label, p.start AS a, p.start + p.width AS z FROM listed),
    better AS (SELECT * FROM found d WHERE NOT EXISTS (SELECT 1 FROM found e WHERE e.id = d.id AND e.rank < d.rank AND e.a >= d.a AND e.z <= d.z)),
    kept AS (SELECT * FROM better d WHERE NOT EXISTS (SELECT 1 FROM better e WHERE e.id = d.id AND e.rank <= d.rank AND e.a <= d.a AND e.z >= d.z AND (e.z - e.a > d.z - d.a OR (e.rank, e.number) < (d.rank, d.number)))),
    base AS (SELECT id, p.label, unnest(list_transform(range(1, len(string_split(spaced, phrase))), lambda i: list_sum(list_transform(string_split(spaced, phrase)[1:i], lambda s: {count("s")})) + (i - 1) * {count("phrase")})) AS a FROM texts JOIN phrases p ON contains(spaced, phrase)),
    b AS (SELECT id, count(*) AS n, min(a) AS low, max(a) AS high, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY id),
    k AS (SELECT id, list(label) AS labels, count(*) AS n, round(1 - pow(0.1, count(*) FILTER (rank = 0)) * pow(0.3, count(*) FILTER (rank = 1)) * pow(0.8, count(*) FILTER (rank = 2)), 6) AS score FROM kept GROUP BY id)
    SELECT doc_id, n_words, coalesce(b.n, 0) AS n_base, low::BIGINT AS first_word, high::BIGINT AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(k.labels, []))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(k.n, 0) AS n_detections
    FROM texts LEFT JOIN b USING (id) LEFT JOIN k USING (id)"""
