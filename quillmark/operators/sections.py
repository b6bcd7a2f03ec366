"""From papers to sections and chunks: headings are found by pattern, sections are runs of lines between them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillmark.functions import text as T
from quillmark.functions.text import bound

# Which lines are headings, and the labels they stand for; the first that fits counts.
HEADING = r"^(?:\d+\s*\.?\s*)?[A-Z][A-Za-z &\-]{2,45}$"
LABELS = {
    "abstract": r"^\s*(a\s*b\s*s\s*t\s*r\s*a\s*c\s*t)\s*\.?\s*$",
    "introduction": r"^\s*(\d*\s*\.?\s*)?(intro|background|motivation)\w*\s*$",
    "methods": r"^\s*(\d*\s*\.?\s*)?(methods|methodology|materials and methods|approach|system|model|experimental setup)\w*\s*$",
    "results": r"^\s*(\d*\s*\.?\s*)?(results|findings|experiments?|evaluation|performance)\s*$",
    "discussion": r"^\s*(\d*\s*\.?\s*)?(discussion|analysis|limitations)\s*$",
    "conclusion": r"^\s*(\d*\s*\.?\s*)?(conclusion|concluding remarks|summary)\s*$",
    "references": r"^\s*(references|bibliography|works cited)\s*\.?\s*$",
    "acknowledgements": r"^\s*(acknowledg(e|ement)s?|funding|disclosure)\s*$",
}
BODY = ("abstract", "introduction", "methods", "results", "discussion", "conclusion")
IEEE = r"\[\d+\]"
APA = r"\([A-Z][a-z]+(?:\s+and\s+[A-Z][a-z]+)?,?\s+\d{4}\)"
DOI = r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
CHUNK_WORDS = 35
#: Matches of fewer characters aren't marked in a text.
LEAST_MARK = 10


def word_count(text: Column) -> Column:
    """How often WORD stands in a text. Its repeats are made possessive, as giving back never helps it."""
    return T.count(text, re.sub(r"(?<=[+*])", "+", WORD))


def label(line: Column) -> Column:
    return reduce(lambda out, x: out.when(line.rlike("(?i)" + x[1]), x[0]), list(LABELS.items())[1:], F.when(line.rlike("(?i)" + LABELS["abstract"]), "abstract"))


def lines(papers: DataFrame) -> DataFrame:
    """(paper_id, pos, raw, line, label, heading) of each line that isn't blank."""
    cut = papers.select("paper_id", F.posexplode(F.split("full_text", "\n")).alias("pos", "raw")).withColumn("line", T.strip(F.col("raw"))).where("line <> ''")
    candidate = F.col("line").rlike(HEADING) & (T.n_tokens(F.col("line")) <= 6)
    named = cut.withColumn("label", F.when(candidate, label(F.col("line"))))
    return named.withColumn("heading", candidate & (F.col("label").isNotNull() | F.col("line").rlike(r"^\d")))


def joined(items: Column, field: str, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(items), lambda x: x[field]), glue)


def sectioned(papers: DataFrame) -> DataFrame:
    """papers with secs: an array of (idx, label, heading, text), the sections in order. A paper without any line has one empty section, a null text null.

    A paper is one row, so nothing is shuffled: sections are the slices of its lines between headings.
    """
    raw, line, made, kept, starts = (F.col(f"__{c}") for c in ("raw", "line", "made", "kept", "starts"))
    rows = papers.withColumn("__raw", F.filter(F.split("full_text", "\n"), lambda x: T.strip(x) != "")).withColumn("__line", F.transform("__raw", T.strip))

    def head(x: Column, i: Column) -> Column:
        candidate = x.rlike(HEADING) & (T.n_tokens(x) <= 6)
        return F.when(candidate, bound(label(x), lambda of: F.when(of.isNotNull() | x.rlike(r"^\d"), F.struct(i.alias("at"), x.alias("heading"), of.alias("label")))))

    rows = rows.withColumn("__heads", F.array_compact(F.transform(line, head)))
    # what stands before the first heading is a section, too
    lead = F.when((F.size(line) > 0) & (F.coalesce(F.get("__heads", F.lit(0))["at"], F.lit(1)) > 0), F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("heading"), F.lit(None).cast("string").alias("label"))))
    rows = rows.withColumn("__heads", F.concat(F.coalesce(lead, F.slice("__heads", 1, 0)), "__heads"))

    def section(x: Column, i: Column) -> Column:
        first = x["at"] + (x["heading"] != "").cast("int")
        end = F.coalesce(F.get("__heads", i + 1)["at"], F.size(line))
        return F.struct(x["label"].alias("label"), x["heading"].alias("heading"), T.strip(F.array_join(F.slice(raw, first + 1, end - first), "\n")).alias("text"))

    said = F.filter(F.transform("__heads", section), lambda x: (x["text"] != "") | x["label"].isNotNull())
    rows = rows.withColumn("__made", F.transform(said, lambda x: F.struct(F.coalesce(x["label"], F.lit("other")).alias("label"), x["heading"].alias("heading"), x["text"].alias("text"))))
    one, two = F.get(made, F.lit(0)), F.get(made, F.lit(1))
    title = (F.size(made) > 1) & (one["label"] == "other") & (one["heading"] == "") & (T.n_tokens(one["text"]) < 20)
    joint = F.struct(two["label"].alias("label"), two["heading"].alias("heading"), T.strip(F.concat(one["text"], F.lit("\n\n"), two["text"])).alias("text"))
    rows = rows.withColumn("__kept", F.when(title, F.concat(F.array(joint), F.slice(made, F.lit(3), F.size(made)))).otherwise(made))
    rows = rows.withColumn("__starts", F.array_compact(F.transform(kept, lambda x, i: F.when((i == 0) | ~((x["label"] == "other") & (T.n_tokens(x["text"]) < 15)), i))))

    def merged(a: Column, j: Column) -> Column:
        n = F.coalesce(F.get(starts, j + 1), F.size(kept)) - a
        text = F.array_join(F.transform(F.slice(kept, a + 1, n), lambda x: x["text"]), "\n\n")
        return F.struct(j.alias("idx"), kept[a]["label"].alias("label"), kept[a]["heading"].alias("heading"), text.alias("text"))

    blank = F.array(F.struct(F.lit(0).alias("idx"), F.lit("other").alias("label"), F.lit("").alias("heading"), F.lit("").alias("text")))
    secs = F.when(~F.col("full_text").rlike(r"\S"), blank).otherwise(F.transform(starts, merged))
    return rows.withColumn("secs", secs).drop("__raw", "__line", "__heads", "__made", "__kept", "__starts")


def listed(rows: DataFrame) -> DataFrame:
    """(paper_id, idx, label, heading, text) of sectioned() rows."""
    # the outer form, as the plain one first filters by the sections' number, which makes them twice
    return rows.select("paper_id", F.inline_outer("secs")).where("idx is not null")


def sections(papers: DataFrame) -> DataFrame:
    """(paper_id, idx, label, heading, text): sections in order. A paper without any line has one empty section."""
    return listed(sectioned(papers))


def gathered(papers: DataFrame, secs: DataFrame) -> DataFrame:
    """papers with their sections, given as rows, as sectioned() makes them; null where there are none."""
    own = secs.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("idx", "label", "heading", "text"))).alias("secs"))
    return papers.join(own, "paper_id", "left")


def chunks(text: Column) -> Column:
    """Groups of sentences (cut at full stops) of CHUNK_WORDS words or more, each starting with the last two of the one before; the rest follows.

    Null for a null text. Where a chunk ends depends only on where the one before ended, so each
    sentence points to the end that would follow it; pointers of 1, 2, 4, ... chunks are made by
    doubling, and every chunk looks up its own end. No list is copied as it grows.
    """
    pieces = F.filter(F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\."), T.strip), lambda s: F.length(s) > 8)
    return bound(pieces, lambda s: F.when(F.size(s) == 0, F.array().cast("array<string>")).otherwise(bound(F.transform(s, T.n_tokens), lambda n: _grouped(s, n))))


def _grouped(s: Column, n: Column) -> Column:
    """The chunks of sentences s of n words each."""
    m = F.size(n)
    none = F.struct(F.lit(0).alias("words"), F.lit(0).alias("taken"))

    def ended(start: Column, after: Column, most: Column) -> Column:
        """The place, not before `after`, at which sentences from `start` on have words enough; m if they never have."""

        def take(a: Column, x: Column) -> Column:
            more = a["words"] < CHUNK_WORDS
            return F.when(more, F.struct((a["words"] + x).alias("words"), (a["taken"] + 1).alias("taken"))).otherwise(a)

        return bound(F.aggregate(F.slice(n, start + 1, most), none, take), lambda a: F.when(a["words"] < CHUNK_WORDS, m).otherwise(F.least(m, F.greatest(after, start + a["taken"] - 1))))

    def doubled(next: Column) -> Column:
        levels = F.sequence(F.lit(1), F.ceil(F.log2(m + 1)).cast("int"))
        return F.aggregate(levels, F.array(next), lambda all, _: bound(F.element_at(all, -1), lambda j: F.concat(all, F.array(F.transform(j, lambda x: j[x])))))

    def placed(jumps: Column, first: Column) -> Column:
        """The ends of all chunks before the rest."""
        zero = F.struct(first.alias("at"), F.lit(0).alias("k"))
        levels = F.sequence(F.lit(0), F.size(jumps) - 1)

        def further(a: Column, i: Column) -> Column:
            return bound(jumps[i][a["at"]], lambda to: F.when(to < m, F.struct(to.alias("at"), (a["k"] + F.pow(F.lit(2), i).cast("int")).alias("k"))).otherwise(a))

        last = F.aggregate(F.reverse(levels), zero, further, lambda a: a["k"])
        ends = bound(levels, lambda ls: F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(ls, first, lambda at, i: F.when(F.getbit(k, i) == 1, jumps[i][at]).otherwise(at))))
        return F.when(first >= m, F.array().cast("array<int>")).otherwise(ends)

    def cut(ends: Column) -> Column:
        def piece(end: Column, i: Column) -> Column:
            start = F.when(i == 0, 0).otherwise(F.greatest(F.get(ends, i - 1) - 1, F.lit(0)))
            return bound(start, lambda a: F.concat(F.array_join(F.slice(s, a + 1, end - a + 1), ". "), F.lit(".")))

        return F.transform(F.concat(ends, F.array(m - 1)), piece)

    # sentences that a chunk can hold, besides the two carried over
    most = F.greatest(F.lit(3), F.ceil(CHUNK_WORDS / F.greatest(F.array_min(n), F.lit(1))).cast("int") + 1)
    follow = bound(most, lambda w: F.transform(F.sequence(F.lit(0), m), lambda e: F.when(e >= m - 1, m).otherwise(ended(F.greatest(e - 1, F.lit(0)), e + 1, w))))
    first = bound(most, lambda w: ended(F.lit(0), F.lit(0), w))
    ends = bound(follow, lambda next: bound(doubled(next), lambda jumps: bound(first, lambda f: placed(jumps, f))))
    return bound(ends, cut)


def section_chunks(secs: DataFrame) -> DataFrame:
    """(paper_id, idx, pos, chunk), pos counted over the whole section."""
    # the outer form, as the plain one first filters by the chunks' number, which makes them twice
    return secs.select("paper_id", "idx", F.posexplode_outer(chunks(F.col("text"))).alias("pos", "chunk")).where("pos is not null")


def grouped(text: str) -> list[str]:
    """chunks() of one text, in Python: from each start on sentences are taken until they have words enough, and each but the first must end one later at least."""
    s = [p for x in text.replace("\n", " ").split(".") if len(p := x.strip(" \t\n\x0b\f\r")) > 8]
    n = [len(x.encode().split()) for x in s]  # bytes are cut at ASCII white space alone, as T.n_tokens does
    out, start, least = [], 0, 0
    while s:
        words, end = 0, start
        while end < len(s) and words < CHUNK_WORDS:
            words += n[end]
            end += 1
        last = max(end - 1, least) if words >= CHUNK_WORDS else len(s)
        out.append(". ".join(s[start : last + 1]) + ".")
        if last >= len(s):
            break
        start, least = max(last - 1, 0), last + 1
    return out


def chunk_lists(rows: DataFrame) -> DataFrame:
    """(paper_id, chunks) of sectioned() rows: all chunks of a paper as an array of (idx, pos, chunk), in order; null if a text is null.

    Cut in a Python task: chunks(), whose lambdas of SQL aren't compiled, took several times the CPU time.
    """
    chunk = StructType([StructField("idx", IntegerType()), StructField("pos", IntegerType()), StructField("chunk", StringType())])
    shape = StructType([rows.schema["paper_id"], StructField("chunks", ArrayType(chunk))])
    arrow = to_arrow_schema(shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                made = []
                for idx, texts in zip(part.column("idx").to_pylist(), part.column("text").to_pylist(), strict=True):
                    known = texts is not None and None not in texts
                    made.append([(i, pos, c) for i, t in zip(idx, texts, strict=True) for pos, c in enumerate(grouped(t))] if known else None)
                flat = [x for own in made if own for x in own]
                items = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], type=f.type) for k, f in enumerate(arrow.field("chunks").type.value_type)], names=chunk.names)
                ends, at = [0], 0
                for own in made:
                    at += len(own or ())
                    ends.append(at)
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), items, mask=pa.array([own is None for own in made]))
                yield pa.RecordBatch.from_arrays([part.column("paper_id"), lists], names=shape.names)

    return rows.select("paper_id", F.col("secs.idx").alias("idx"), F.col("secs.text").alias("text")).mapInArrow(cut, shape)


def body(secs: Column) -> Column:
    """The text of the sections with labels of BODY."""
    return F.array_join(F.transform(F.filter(secs, lambda s: s["label"].isin(*BODY)), lambda s: s["text"]), " ")


def citing(rows: DataFrame, most: int = 40) -> DataFrame:
    """(paper_id, said) of sectioned() rows: an array of sentences of 12 to 60 words in the body, cited ones first, alike ones once, `most` of them."""
    own = F.coalesce(body(F.col("secs")), F.lit(""))
    text = rows.select("paper_id", "full_text", own.alias("__b")).select("paper_id", F.when(F.col("__b").rlike(r"\S"), F.col("__b")).otherwise(F.col("full_text")).alias("__t"))
    cited = lambda s: s.rlike(IEEE) | s.rlike(APA) | s.rlike(r"\b10\.\d{4,9}/\S+\b")
    fit = F.filter(T.sentences(F.replace("__t", F.lit("\n"), F.lit(" "))), lambda s: T.n_tokens(s).between(12, 60))
    order = F.sort_array(F.transform(fit, lambda s, i: F.struct((~cited(s)).alias("last"), i.alias("pos"), s.alias("s"))))
    ordered = text.select("paper_id", F.transform(order, lambda x: x["s"]).alias("__s"))
    keyed = ordered.withColumn("__k", F.transform("__s", lambda s: F.substring(F.lower(s), 1, 80)))
    first = F.transform(F.slice(F.array_distinct("__k"), 1, most), lambda k: F.col("__s")[F.array_position(F.col("__k"), k).cast("int") - 1])
    return keyed.select("paper_id", first.alias("said"))


def citing_rows(rows: DataFrame) -> DataFrame:
    """(paper_id, rank, sentence) of sectioned() rows."""
    return citing(rows).select("paper_id", F.posexplode_outer("said").alias("pos", "sentence")).where("pos is not null").select("paper_id", (F.col("pos") + 1).alias("rank"), "sentence")


def citing_sentences(papers: DataFrame, secs: DataFrame) -> DataFrame:
    """(paper_id, rank, sentence): sentences of 12 to 60 words in the body, cited ones first, alike ones once, 40 of them."""
    return citing_rows(gathered(papers, secs))


def report_name(filename: Column, record_id: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    safe = F.substring(F.regexp_replace(stem, r"[^\p{L}\p{N}_.\-]", ""), 1, 60)
    return F.concat(F.when(safe == "", "paper").otherwise(safe), F.lit("_"), record_id.cast("string"), F.lit(".pdf"))


def literal(match: Column) -> Column:
    """A pattern that finds a text as it stands, whatever its case."""
    return F.concat(F.lit("(?iu)"), F.regexp_replace(match, r"([\\.\[\]{}()*+?^$|/-])", r"\\$1"))


def highlighted(text: Column, matches: Column) -> Column:
    """Each match of 10 characters or more marked wherever it stands, longest first, whatever its case."""
    order = F.array_sort(matches, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0))
    return F.aggregate(F.filter(order, lambda m: F.length(m) >= LEAST_MARK), text, lambda t, m: F.regexp_replace(t, F.concat(F.lit("("), literal(m), F.lit(")")), F.lit("<mark>$1</mark>")))


def marked_parts(text: Column, matches: Column) -> Column:
    """The text cut in parts (text, rank): rank of the match that a part is, or null between matches. Put together the parts are the text; a null text has none.

    matches: array of (rank, matched_text), empty or null for none. Longer matches come first,
    of equal length the smaller rank; what a longer one covers isn't looked at again, so marks
    neither nest nor cross. Matches shorter than LEAST_MARK characters and null ones mark nothing.
    """
    part = "struct<text:string,rank:int>"
    found = F.filter(matches, lambda m: F.length(m["matched_text"]) >= LEAST_MARK)
    order = F.transform(F.array_sort(F.transform(found, lambda m: F.struct((-F.length(m["matched_text"])).alias("n"), m["rank"].alias("rank"), m["matched_text"].alias("t")))), lambda m: F.struct(m["rank"].alias("rank"), literal(m["t"]).alias("pattern")))

    def cut(p: Column, m: Column) -> Column:
        between = F.transform(F.split(p["text"], m["pattern"]), lambda t: F.struct(t.alias("text"), F.lit(None).cast("int").alias("rank")))
        there = F.transform(F.regexp_extract_all(p["text"], m["pattern"], F.lit(0)), lambda t: F.struct(t.alias("text"), m["rank"].cast("int").alias("rank")))
        both = F.flatten(F.zip_with(between, there, lambda a, b: F.array(a, b)))  # one more of between, so the last of there is null
        return F.when(p["rank"].isNotNull(), F.array(p)).otherwise(F.filter(both, lambda x: x["text"] != ""))

    whole = F.when(text.isNotNull(), F.array(F.struct(text.alias("text"), F.lit(None).cast("int").alias("rank")))).cast(f"array<{part}>")
    return F.aggregate(F.coalesce(order, F.array().cast("array<struct<rank:int,pattern:string>>")), whole, lambda parts, m: F.flatten(F.transform(parts, lambda p: cut(p, m))).cast(f"array<{part}>"))


def overlay(papers: DataFrame, matches: DataFrame) -> DataFrame:
    """(paper_id, marks, marked): each paper's text with its own matches (paper_id, rank, title, similarity, matched_text) marked, and how many marks stand in it.

    A mark names its match: <mark title="Title (similarity%)">. Every paper has a row; a null text
    is null. Only the matches are grouped; a paper's text stays where it is joined with them.
    """
    own = matches.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "title", "similarity", "matched_text"))).alias("m"))
    cut = papers.join(own, "paper_id", "left").select("paper_id", "m", marked_parts(F.col("full_text"), F.col("m")).alias("parts"))
    named = F.map_from_entries(F.transform("m", lambda x: F.struct(x["rank"], F.concat(x["title"], F.lit(" ("), x["similarity"].cast("string"), F.lit("%)")))))
    opened = cut.select("paper_id", "parts", named.alias("names"))
    shown = F.transform("parts", lambda p: F.when(p["rank"].isNull(), p["text"]).otherwise(F.concat(F.lit('<mark title="'), F.replace(F.coalesce(F.col("names")[p["rank"]], F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit('">'), p["text"], F.lit("</mark>"))))
    marks = F.size(F.filter("parts", lambda p: p["rank"].isNotNull()))
    return opened.select("paper_id", F.coalesce(marks, F.lit(0)).alias("marks"), F.when(F.col("parts").isNotNull(), F.array_join(shown, "")).alias("marked"))


def machine_overlay(text: Column, probability: Column) -> Column:
    """Every sentence marked where a machine is likelier than not to have written the text (probability over 50), else the text."""
    return F.when(probability > 50, F.array_join(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.concat(F.lit("<mark>"), s, F.lit("</mark>"))), " ")).otherwise(text)
