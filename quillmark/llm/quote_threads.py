"""Quotation linking: nested quotes are parsed, hashed and joined to the messages they come from. Native: SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import forget, stored, with_position

#: A line that quotes begins with these marks; their number is the level.
MARKS = r"^(?:[ \t]*>)+"
#: A line before a quote that only says who wrote it.
SAID = r"(?im)^[ \t]*(?:on|am|le|el|em|il)\b[^\n]{0,300}\b(?:wrote|writes|schrieb|écrit|a écrit|escribió|ha scritto)\b[^\n]{0,40}:[ \t]*\n(?=(?:[ \t]*\n)*[ \t]*>)"
#: Rows of a conversation's threads that one sort takes together.
CELL = 256


def normal(text: Column) -> Column:
    """Letters and digits in lower case, with one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """Normalised sentences that aren't empty; line breaks inside a quote may differ from the original's."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+"), normal), lambda s: s != "")


def own_words(text: Column) -> Column:
    """The text without quoted lines and the lines that introduce them, trimmed."""
    return F.trim(F.array_join(F.filter(F.split(F.regexp_replace(text, SAID, ""), "\n"), lambda x: ~x.rlike(MARKS)), "\n"), F.lit(" \n\t\r"))


def passages(messages: DataFrame) -> DataFrame:
    """(message, conv_id, turn, passage, level, quoted) of each run of lines of one level, for messages that quote."""
    quoting = messages.where(F.col("text").rlike("(?m)" + MARKS)).select("message", "conv_id", "turn", F.posexplode(F.split(F.regexp_replace("text", SAID, ""), "\n")).alias("line", "said"))
    marks = F.regexp_extract("said", MARKS, 0)
    level = F.length(F.regexp_replace(marks, "[^>]", ""))
    lines = quoting.select("message", "conv_id", "turn", "line", level.alias("level"), F.regexp_replace("said", MARKS, "").alias("said"))
    here = Window.partitionBy("message").orderBy("line")
    lines = lines.withColumn("passage", F.sum(F.when(F.col("level") == F.lag("level", 1, -1).over(here), 0).otherwise(1)).over(here))
    grouped = lines.where("level > 0").groupBy("message", "conv_id", "turn", "passage", "level")
    return grouped.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "said"))), lambda x: x["said"]), "\n").alias("quoted"))


def linked(messages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(message, conv_id, turn, passage, level, reply_to, share): the earlier turn that most of a passage's characters come from.

    Each sentence belongs to the latest earlier message of its conversation that says it in its
    own words; of turns with equal characters the latest wins. A passage found nowhere has none.
    """
    asked = quotes.select("message", "conv_id", "turn", "passage", "level", F.explode(sentences(F.col("quoted"))).alias("s"))
    asked = asked.groupBy("message", "conv_id", "turn", "passage", "level", F.xxhash64("s").alias("h")).agg((F.length(F.first("s")) * F.count(F.lit(1))).alias("n"))
    wanted = asked.select("conv_id", "h").distinct()
    said = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(sentences(own_words(F.col("text"))), lambda s: F.xxhash64(s)))).alias("h"))
    said = said.join(wanted, ["conv_id", "h"], "left_semi").distinct()
    none = F.lit(None)
    events = said.select("conv_id", "h", "turn", F.lit(1).alias("kind"), none.cast("string").alias("message"), none.cast("long").alias("passage"), none.cast("int").alias("level"), none.cast("long").alias("n"))
    events = events.unionByName(asked.select("conv_id", "h", "turn", F.lit(0).alias("kind"), "message", "passage", "level", "n"))
    before = Window.partitionBy("conv_id", "h").orderBy("turn", "kind")
    found = events.withColumn("from", F.last(F.when(F.col("kind") == 1, F.col("turn")), ignorenulls=True).over(before)).where("kind = 0")
    votes = found.groupBy("message", "conv_id", "turn", "passage", "level", "from").agg(F.sum("n").alias("n"))
    best = F.max(F.when(F.col("from").isNotNull(), F.struct("n", "from")))
    return votes.groupBy("message", "conv_id", "turn", "passage", "level").agg(best.alias("b"), F.sum("n").alias("all")).select("message", "conv_id", "turn", "passage", "level", F.col("b.from").alias("reply_to"), (F.coalesce(F.col("b.n"), F.lit(0)) / F.col("all")).alias("share"))


def roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, thread): the first turn of each reply's chain, by doubling. A reply always answers an earlier turn."""
    spark = replies.sparkSession
    now, path = stored(replies.select("conv_id", "turn", F.col("reply_to").alias("thread")))
    while True:
        up = now.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("up"))
        step = now.join(up, (F.col("conv_id") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        after, new = stored(step.select("conv_id", "turn", F.coalesce("up", "thread").alias("thread"), F.col("up").isNotNull().alias("moved")))
        forget(spark, path)
        path, now = new, after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now


def thread(conversations: DataFrame) -> DataFrame:
    """Every message without its quotes, as conv_id, turn, role, text, reply_to, thread, position, quote_depth, n_quotes, n_linked.

    A message answers the turn that its shallowest linked quote comes from (the first such quote,
    if several); one that quotes nothing known begins a thread of its own. thread is that
    thread's first turn, and position the gapless place in the conversation from 0: threads in
    order of their first turn, each in order of turns, so answers follow what they answer.
    Quotes are looked up in earlier turns of the same conversation. A null text is an empty one;
    null conv_id or turn link to nothing but keep their rows; repeated rows all stay.
    """
    # messages of the same conversation, turn and words are one when links are looked for
    name = F.concat_ws("/", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))
    messages = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", name)
    quotes, _ = stored(passages(messages.select("message", "conv_id", "turn", "text").where("conv_id is not null and turn is not null").dropDuplicates(["message"])))
    links, _ = stored(linked(messages, quotes))
    per = links.groupBy("message").agg(F.min_by("reply_to", F.when(F.col("reply_to").isNotNull(), F.struct("level", "passage"))).alias("reply_to"), F.count("reply_to").alias("n_linked"))
    counted = quotes.groupBy("message").agg(F.max("level").alias("quote_depth"), F.count(F.lit(1)).alias("n_quotes"))
    answers = counted.join(per, "message", "left")
    replies = links.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min_by("reply_to", F.struct("level", "passage")).alias("reply_to"))
    tops = roots(replies).withColumnRenamed("turn", "__turn").withColumnRenamed("conv_id", "__conv")
    out = messages.join(answers, "message", "left").join(tops, (F.col("conv_id") == F.col("__conv")) & (F.col("turn") == F.col("__turn")), "left")
    out = out.select("conv_id", "turn", "role", F.when(F.col("n_quotes") > 0, own_words(F.col("text"))).otherwise(F.col("text")).alias("text"), "reply_to", F.coalesce("thread", "turn").alias("thread"), F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
    celled = out.withColumn("__cell", F.floor(F.col("thread") / CELL).cast("long"))
    return with_position(celled, "conv_id", "__cell", ["thread", "turn", "role", "text"], "position").select("conv_id", "turn", "role", "text", "reply_to", "thread", "position", "quote_depth", "n_quotes", "n_linked")


def op6_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
