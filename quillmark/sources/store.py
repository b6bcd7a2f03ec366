"""A table of results in which a row replaces the one that its key had: placeholders, results, errors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets of a new store; a batch reads and writes only those that its keys fall in.
BUCKETS = 64
#: States, weakest first: of rows of equal time the strongest counts.
STATES = ("pending", "error", "rejected", "done")
#: States that need no further analysis of the same content.
SETTLED = ("rejected", "done")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or a local one where all run in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quillmark-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written in the shared folder and read again, so that later steps don't depend on lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """Rows that grow with the papers, to be joined by merging: their compressed files look small enough to be sent everywhere, but the driver would hold all rows unpacked."""
    return df.hint("merge")


def strength(state: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0))


class ResultStore:
    """Rows by a key in Parquet files, parted by a hash of the key.

    upsert() merges a batch into the buckets that it touches and replaces just those. The new
    buckets are written beside the table first, as a whole; a writer that dies while it puts them
    in place is made good by the next one, and a batch that is written twice changes nothing. One
    writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "file_hash", time: str = "analyzed_at", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.time, self.buckets = spark, path.rstrip("/"), key, time, buckets
        self.staged = f"{self.path}-staged"

    def _file(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._file(path)
        return fs.exists(p)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self) -> DataFrame:
        """All rows as they are now."""
        self.recover()
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)

    def _held(self, schema, touched: list[int]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path).where(F.col("bucket").isin(touched))

    def _touched(self, keyed: DataFrame) -> list[int]:
        return [r.bucket for r in keyed.select("bucket").distinct().collect()]  # `buckets` rows at most

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """Rows (with the key) whose key has no settled state; only the buckets of these keys are read."""
        self.recover()
        if not self.exists(self.path):
            return rows
        keyed = rows.withColumn("bucket", self.bucket(F.col(self.key)))
        schema = f"{self.key} {dict(rows.dtypes)[self.key]}, state string, bucket int"
        known = self._held(schema, self._touched(keyed)).where(F.col("state").isin(*SETTLED)).select(self.key)
        return keyed.drop("bucket").join(known, self.key, "left_anti")

    def upsert(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Put in rows that have the key, a time and a state; of each key the latest row stays, of equal times the strongest state. Rows without a key are left out.

        keys: a table with (at least) the keys of rows, if that is cheaper to read than rows, which then are made only once.
        """
        self.recover()
        new = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(F.col(self.key)))
        touched = self._touched((rows if keys is None else keys).where(F.col(self.key).isNotNull()).select(self.bucket(F.col(self.key)).alias("bucket")))
        if not touched:
            return
        if self.exists(self.path):
            old = self.spark.read.option("mergeSchema", "true").parquet(self.path).where(F.col("bucket").isin(touched))
            new = old.unionByName(new, allowMissingColumns=True)
        first = F.row_number().over(Window.partitionBy("bucket", self.key).orderBy(F.desc(self.time), F.desc(strength(F.col("state")))))
        latest = new.withColumn("__n", first).where("__n = 1").drop("__n")
        latest.write.mode("overwrite").partitionBy("bucket").parquet(self.staged)
        self.recover()

    def recover(self) -> None:
        """Put buckets in place that were written as a whole; forget ones that weren't."""
        if not self.exists(self.staged):
            return
        if self.exists(f"{self.staged}/_SUCCESS"):
            ready = self.spark.read.option("mergeSchema", "true").parquet(self.staged)
            ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        fs, p = self._file(self.staged)
        fs.delete(p, True)
