"""An index of stored ids for streams: a batch looks only where its ids can be.

``path/bucket=B/batch=K/*.parquet`` holds the ids that batch K stored whose hash falls in
bucket B, and nothing else. A micro-batch collects the bucket numbers of its own ids (at most
``buckets`` integers) and reads those partitions, literal numbers in the partition filter; the
stored posts are not read at all. The check is exact and reaches back to the first batch, so
a duplicate that comes years late is found.

A batch that is handed over again after a crash leaves its own rows out of the look-up and
overwrites what it wrote before, so it stores the same posts again, once. Batches are told
apart by the query's id (it stays in the checkpoint) and the batch number.

``compact`` merges the files that many batches left in a bucket. It must not run beside the
stream that writes the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.tables import path_exists
from ..sources.versioned import _children, _fs

BUCKETS = 256


def batch_name(spark: SparkSession, batch_id: int) -> str:
    """A name for a micro-batch that a restarted query gives to the same batch again."""
    return f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'direct'}-{batch_id}"


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace exactly the partitions that ``df`` has rows for."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by).parquet(path))


class IdIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "id", buckets: int = BUCKETS):
        # the number of buckets is part of the folder's name: another number is another index
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path = f"{path.rstrip('/')}/of-{buckets}"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def stored(self, batch: DataFrame, name: str) -> DataFrame | None:
        """The indexed ids of the buckets that ``batch`` needs, without those of batch ``name``."""
        if not path_exists(self.spark, self.path):
            return None
        needed = [r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect()]
        self.spark.catalog.refreshByPath(self.path)
        kind = batch.schema[self.key].dataType.simpleString()
        index = self.spark.read.schema(f"`{self.key}` {kind}, bucket int, batch string").parquet(self.path)
        return index.where(F.col("bucket").isin(needed) & (F.col("batch") != name)).select(self.key)

    def unseen(self, batch: DataFrame, name: str) -> DataFrame:
        """The rows of ``batch`` whose id no other batch has stored (null ids are equal)."""
        stored = self.stored(batch, name)
        if stored is None:
            return batch
        stored = stored.select(F.col(self.key).alias("_stored"))
        return batch.join(stored, F.col(self.key).eqNullSafe(F.col("_stored")), "left_anti")

    def add(self, batch: DataFrame, name: str) -> None:
        """Index the ids of ``batch`` under ``name``; again: instead of what was there."""
        ids = batch.select(self.key, self.bucket().alias("bucket"), F.lit(name).alias("batch")).distinct()
        overwrite_partitions(ids.repartition("bucket"), self.path, "bucket", "batch")

    def compact(self, name: str = "compacted") -> None:
        """One batch folder per bucket. The merged ids are written before the old folders go, so a
        compaction that dies leaves some ids twice and none missing."""
        index = self.spark.read.parquet(self.path)
        old = [f.getPath().toString() for b in _children(self.spark, self.path) if b.isDirectory()
               for f in _children(self.spark, b.getPath().toString()) if f.getPath().getName() != f"batch={name}"]
        merged = reliable_checkpoint(index.select(self.key, "bucket").distinct())
        overwrite_partitions(merged.withColumn("batch", F.lit(name)).repartition("bucket"), self.path, "bucket", "batch")
        for folder in old:
            fs, p = _fs(self.spark, folder)
            fs.delete(p, True)
        self.spark.catalog.refreshByPath(self.path)
