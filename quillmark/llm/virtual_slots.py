"""Sharding by fixed virtual slots: records hash into slots, and a versioned map sends slots to shards."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import bucket_of, shared_folder

SLOTS = 4096


class SlotMap:
    """Which shard each slot belongs to, in every version. A version is never changed, only followed by another."""

    def __init__(self, versions: list[list[int]]):
        self.versions = versions

    @classmethod
    def of(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        """The map that a count of shards alone decides: one shard, grown shard by shard; its last version has them all."""
        if not 1 <= shards <= slots:
            raise ValueError("there must be a shard at least, and as many slots as shards at least")
        made = cls([[0] * slots])
        for _ in range(shards - 1):
            made.grow()
        return made

    @property
    def version(self) -> int:
        return len(self.versions)

    @property
    def shards(self) -> int:
        return max(self.versions[-1]) + 1

    def grow(self) -> int:
        """Add a version with one more shard, which takes its share of slots from the fullest shards; no other slot moves."""
        now = list(self.versions[-1])
        new = max(now) + 1
        own: dict[int, list[int]] = {}
        for slot, shard in enumerate(now):
            own.setdefault(shard, []).append(slot)
        for shard, held in own.items():
            held.sort(key=lambda s: (zlib.crc32(f"{s}/{new}".encode()), s))
        for _ in range(len(now) // (new + 1)):
            fullest = max(own, key=lambda k: (len(own[k]), -k))
            now[own[fullest].pop()] = new
        self.versions.append(now)
        return self.version

    def rebalance(self, sizes: dict[int, int], within: float = 0.02) -> int:
        """Add a version in which slots moved from the fullest shard to the emptiest until sizes (bytes by slot) differ little.

        Slots move whole; the largest move that narrows the gap is taken first. Rows follow
        their slots, so afterwards the shard no longer follows from the count of shards alone.
        """
        now = list(self.versions[-1])
        load = [0] * self.shards
        for slot, shard in enumerate(now):
            load[shard] += sizes.get(slot, 0)
        mean = sum(load) / len(load)
        for _ in range(len(now)):
            high, low = load.index(max(load)), load.index(min(load))
            gap = load[high] - load[low]
            if gap <= within * mean:
                break
            best = max((s for s, k in enumerate(now) if k == high and 0 < sizes.get(s, 0) < gap), key=lambda s: (min(sizes[s], gap - sizes[s]), -s), default=None)
            if best is None:
                break
            now[best] = low
            load[high] -= sizes[best]
            load[low] += sizes[best]
        self.versions.append(now)
        return self.version

    def table(self, spark: SparkSession) -> DataFrame:
        """(version, slot, shard) of all versions, to be stored."""
        return spark.createDataFrame([(v, s, k) for v, now in enumerate(self.versions, 1) for s, k in enumerate(now)], "version int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).write.mode("overwrite").partitionBy("version").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = spark.read.parquet(path).orderBy("version", "slot").collect()  # slots times versions, whatever the data's size
        versions: dict[int, list[int]] = {}
        for r in rows:
            versions.setdefault(r.version, []).append(r.shard)
        return cls([versions[v] for v in sorted(versions)])


def slotted(df: DataFrame, key: str, slots: int = SLOTS) -> DataFrame:
    """virtual_slot added: a hash of the key's text, so a record's slot never changes. A null key is like an empty one."""
    return df.withColumn("virtual_slot", bucket_of(F.col(key), slots))


def slot_bytes(df: DataFrame) -> DataFrame:
    """Rows and bytes of each virtual slot that has any; column size must be there."""
    return df.groupBy("virtual_slot").agg(F.sum("size").alias("slot_bytes"), F.count(F.lit(1)).alias("slot_rows"))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """Every row of docs with its shard of `shards`, and the one it has after the map has grown by one shard.

    The law `key` holds: doc_id and the count of shards decide; in grown_shard rows only move into
    the new shard. slot is the row's gapless place in its shard, in order of virtual slot and doc_id.
    A null text has no bytes, a null doc_id is like an empty one, and repeated rows all count, in
    any order among themselves. Only doc_id, text and the columns made from them are kept.
    """
    spark = docs.sparkSession
    made = SlotMap.of(shards, slots)
    before = made.version
    made.grow()
    path = f"{shared_folder(spark)}/quillmark-slots-{uuid.uuid4().hex}"
    made.save(spark, path)
    old, new = SlotMap.load(spark, path).versions[before - 1 : before + 1]  # the stored map rules
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = slotted(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "doc_id", slots)
    filled = sorted(slot_bytes(rows).collect())  # a row for each slot: `slots` rows at most
    at, table = [0] * shards, []
    for slot, size, count in filled:
        table.append((slot, old[slot], new[slot], size, at[old[slot]]))
        at[old[slot]] += count
    known = F.broadcast(spark.createDataFrame(table, "virtual_slot int, shard int, grown_shard int, slot_bytes long, __from long"))
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32")))
    placed = ranked.join(known, "virtual_slot").withColumn("slot", (F.col("__from") + F.col("__rank") - 1).cast("long"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "slot_bytes", F.lit(before).alias("map_version"))


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def op7_sql(shards: int = 8, slots: int = SLOTS) -> str:
    """The rows of shard() in SQL, from the versions of the map that it would store. SQL has no crc32, so bytes are folded one by one."""
    made = SlotMap.of(shards, slots)
    version, old = made.version, made.versions[-1]
    made.grow()
    return f"""WITH given AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS h, (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT % {slots})::INTEGER AS virtual_slot FROM documents),
    bytes AS (SELECT * EXCLUDE h, list_transform(regexp_extract_all(h, '..'), lambda p: ('0x' || p)::UBIGINT) AS b FROM given),
    summed AS (SELECT * EXCLUDE b, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, ({_crc_table()}::UBIGINT[])[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM bytes),
    placed AS (SELECT *, ({old}::INTEGER[])[virtual_slot + 1] AS shard, ({made.versions[-1]}::INTEGER[])[virtual_slot + 1] AS grown_shard, sum(size) OVER (PARTITION BY virtual_slot)::BIGINT AS slot_bytes FROM summed)
    SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard, virtual_slot, slot_bytes, {version}::INTEGER AS map_version FROM placed"""
