"""Packing by length buckets whose boundaries minimise padding, with batches of a token budget inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import stored, with_position

BUCKETS = 12
#: Tokens of a batch, padding included.
BUDGET = 65_536
CELLS = 1024


def tokens(text: Column) -> Column:
    """Words of the text and one end; a null text is an empty one."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """The lengths to pad to, at most `buckets`, with least padding in all: dynamic programming over all different lengths, which rise.

    With lengths 0 to i dealt with, a bucket up to length j adds lengths[j] times the rows between: a line in
    lengths[j] for each i. Its slopes fall and its places rise, so the lowest lines are found in one pass.
    """
    n = len(lengths)
    if not n:
        return []
    before = [0]
    for c in counts:
        before.append(before[-1] + c)
    cost = [lengths[j] * before[j + 1] for j in range(n)]  # one bucket for lengths 0 to j; padded tokens, as the tokens themselves are given
    cut = [[-1] * n]
    for _ in range(1, min(buckets, n)):
        lines: list[tuple[int, int, int]] = []  # slope, height, i
        new, own, at = list(cost), [-1] * n, 0  # -1: no further bucket
        for j in range(1, n):
            m, h = -before[j], cost[j - 1]
            while len(lines) - at >= 2 and (h - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - m):
                lines.pop()
            lines.append((m, h, j - 1))
            x = lengths[j]
            while len(lines) - at >= 2 and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            way = lines[at][0] * x + lines[at][1] + x * before[j + 1]
            if way < new[j]:
                new[j], own[j] = way, lines[at][2]
        cost = new
        cut.append(own)
    out, j = [], n - 1
    for own in reversed(cut[1:]):
        if own[j] >= 0:
            out.append(lengths[j])
            j = own[j]
    return sorted({*out, lengths[j]})


def pack(rows: DataFrame, cell: str, order: list[str], buckets: int, budget: int, bounded: bool = False) -> DataFrame:
    """Every row of (length, ...) with bucket, padded (the bucket's boundary), batch (gapless from 0 in a bucket) and place.

    A batch holds budget // padded rows, one at least: a row longer than the budget is a batch of
    its own, whole. bounded: there are few cells, whatever the number of rows. An empty table gives an empty result.
    """
    rows, _ = stored(rows)  # so that words are counted once
    histogram = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").collect()  # a row for each length that there is
    ends = boundaries([r.length for r in histogram], [r.n for r in histogram], buckets)
    bucket, padded = F.lit(len(ends) - 1), F.lit(ends[-1] if ends else 0)
    for b in reversed(range(len(ends) - 1)):
        bucket = F.when(F.col("length") <= ends[b], b).otherwise(bucket)
        padded = F.when(F.col("length") <= ends[b], ends[b]).otherwise(padded)
    held = rows.withColumn("bucket", bucket.cast("int")).withColumn("padded", padded.cast("long"))
    at = with_position(held, "bucket", cell, order, "__at", bounded)
    most = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded"), F.lit(1)))).cast("long")
    return at.withColumn("batch", F.floor(F.col("__at") / most).cast("long")).withColumn("place", (F.col("__at") % most).cast("int")).drop("__at")


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, length (words and an end), bucket, padded, batch, place of every row of docs.

    Rows are dealt to a bucket's batches in order of a hash of doc_id and text. Null texts are
    empty; null and repeated ids are rows like others.
    """
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 10), 16, 10).cast("long")  # the same in any engine that has md5
    rows = docs.select("doc_id", tokens(F.col("text")).alias("length"), key.alias("__h"))
    rows = rows.withColumn("__cell", (F.col("__h") % CELLS).cast("int"))
    return pack(rows, "__cell", ["__h", "doc_id"], buckets, budget, bounded=True).select("doc_id", "length", "bucket", "padded", "batch", "place")


def pack_in_order(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Like pack_documents, but for rows read from files: a bucket's batches take them in the order of files and rows."""
    rows = docs.select("doc_id", tokens(F.col("text")).alias("length"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    return pack(rows, "__file", ["__row"], buckets, budget).select("doc_id", "length", "bucket", "padded", "batch", "place")


#: The same in SQL: every layer of the dynamic programming is a step of a recursive query over all different lengths.
OP9_SQL = rf"""WITH RECURSIVE
given AS (SELECT doc_id, (len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1)::BIGINT AS length, ('0x' || md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, '')))[:10])::BIGINT AS h FROM documents),
lengths AS (SELECT length, row_number() OVER (ORDER BY length) - 1 AS j, (sum(count(*)) OVER (ORDER BY length))::BIGINT AS upto FROM given GROUP BY length),
ways AS (
    SELECT 1 AS k, j, length * upto AS cost, -1::BIGINT AS i, upto FROM lengths
    UNION ALL SELECT k, j, b.cost, b.i, upto FROM (
        SELECT w.k + 1 AS k, q.j, q.upto, min(CASE WHEN w.j = q.j THEN {{'cost': w.cost, 'i': -1::BIGINT}} ELSE {{'cost': w.cost + q.length * (q.upto - w.upto), 'i': w.j}} END) AS b
        FROM lengths q JOIN ways w ON w.j <= q.j WHERE w.k < {BUCKETS} GROUP BY w.k, q.j, q.upto
    )
),
back AS (
    SELECT {BUCKETS} AS k, max(j) AS j FROM lengths
    UNION ALL SELECT b.k - 1, CASE WHEN w.i >= 0 THEN w.i ELSE w.j END FROM back b JOIN ways w ON w.k = b.k AND w.j = b.j WHERE b.k > 1
),
ends AS (SELECT length AS padded, (row_number() OVER (ORDER BY length) - 1)::INTEGER AS bucket FROM lengths WHERE j IN (SELECT j FROM back)),
held AS (SELECT * FROM given ASOF JOIN ends ON given.length <= ends.padded),
placed AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h % {CELLS}, h, doc_id NULLS FIRST) - 1 AS spot, greatest(1, {BUDGET} // padded) AS most FROM held)
SELECT doc_id, length, bucket, padded, (spot // most)::BIGINT AS batch, (spot % most)::INTEGER AS place FROM placed"""


def op9_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
