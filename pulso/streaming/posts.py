"""Structured Streaming forms of the incremental state.

The reference keeps manual state between daily runs: a ``processed`` flag,
pending days, whole-day replacement. Here the same work runs as streaming
queries over a file source, with checkpointed offsets in place of the flag.
Posts may arrive any time late; nothing is dropped by a watermark.

* R1 ``dedup_sink``: each micro-batch is deduplicated by id against the stored
  posts and appended (first arrival wins);
  ``indexed_dedup_sink`` does it with an id index (``IdIndex``) and reads no stored post;
* R2 ``stream_clean``: stateless cleaning of new posts only;
* R3 ``stream_daily_means``: tumbling one-day windows in update mode; the state
  is one row per day, so all days stay open; each micro-batch's updated windows
  are appended and the newest value per day is read;
* R4 ``upsert_days_sink``: appends new posts to the raw table (anti-join on id),
  recomputes the days of the incoming batch from it and replaces exactly those
  day partitions (dynamic partition overwrite); ``indexed_upsert_days_sink`` likewise with
  an id index.

Every sink may be handed the same batch again after a crash at any point: appended
posts are found stored, and the days are taken from the whole incoming batch, so
their recomputation is not lost. Checkpoints stand under the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_post_text
from ..operators.daily import SCORES
from ..operators.state import dedup_first
from ..session import reliable_checkpoint
from ..sources.tables import nan_to_null, path_exists
from .id_index import IdIndex, batch_name, overwrite_partitions


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A file-source stream with an explicit schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


def dedup_sink(path: str, key: str = "id", order=("createdAt",)):
    """``foreachBatch`` function appending the batch's posts whose id is not
    stored in ``path`` yet; repeated ids within the batch keep the first by ``order``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = dedup_first(batch, key, order=order)
        if path_exists(spark, path):
            spark.catalog.refreshByPath(path)
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)
    return sink


def daily_aggregate_of(raw: DataFrame, scores=SCORES) -> DataFrame:
    """The per-day table R4 maintains (means of the scores and the count)."""
    return (raw.where(F.col("date").isNotNull()).groupBy("date")
            .agg(*[F.avg(c).alias(c) for c in scores], F.count(F.lit(1)).alias("n_posts")))


def indexed_dedup_sink(path: str, index: IdIndex, order=("createdAt",)):
    """R1 with an id index: as ``dedup_sink``, but a batch reads the index buckets of its own
    ids and no stored post. Posts lie in a partition per batch (``_batch``), which a replayed
    batch replaces."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        name = batch_name(batch.sparkSession, batch_id)
        fresh = reliable_checkpoint(index.unseen(dedup_first(batch, index.key, order=order), name))
        index.add(fresh, name)
        overwrite_partitions(fresh.withColumn("_batch", F.lit(name)), path, "_batch")
    return sink


def indexed_upsert_days_sink(raw_path: str, out_path: str, index: IdIndex, aggregate=daily_aggregate_of):
    """R4 with an id index: as ``upsert_days_sink``; besides the index buckets of its ids a batch
    reads the day partitions it touches, which are recomputed. Stored posts lie in partitions by
    day and batch."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = batch_name(spark, batch_id)
        dated = nan_to_null(batch).withColumn("date", F.to_date("createdAt"))
        days = [r[0] for r in dated.select("date").distinct().collect() if r[0] is not None]
        new = reliable_checkpoint(index.unseen(dedup_first(dated, index.key, order=("createdAt",)), name))
        index.add(new, name)
        overwrite_partitions(new.withColumn("_batch", F.lit(name)), raw_path, "date", "_batch")
        if not days:
            return
        spark.catalog.refreshByPath(raw_path)
        raw = spark.read.parquet(raw_path)
        overwrite_partitions(aggregate(raw.where(F.col("date").isin(days))), out_path, "date")
    return sink


def stream_clean(sdf: DataFrame, text: str = "text", **kw) -> DataFrame:
    """R2: clean the text of arriving posts; rows that clean to nothing drop."""
    from ..operators.terms import with_non_null
    return with_non_null(sdf, clean_post_text(text, **kw), text)


def stream_daily_means(sdf: DataFrame, ts: str = "createdAt", scores=SCORES) -> DataFrame:
    """Per one-day tumbling window, the mean of each score and the count. For
    update mode; without a watermark no window closes, and the state grows by one row
    a day only. ``ts`` must be a ``timestamp`` column."""
    return (nan_to_null(sdf)
            .groupBy(F.window(ts, "1 day").alias("w"))
            .agg(*[F.avg(c).alias(c) for c in scores], F.count(F.lit(1)).alias("n_posts"))
            .select(F.to_date(F.col("w.start")).alias("date"), *scores, "n_posts"))


def run_available_now(sdf: DataFrame, checkpoint: str, *, sink_path: str | None = None,
                      fmt: str = "parquet", mode: str = "append", foreach_batch=None,
                      timeout_s: float | None = None) -> None:
    """Process everything available, then stop (the ``availableNow`` trigger)."""
    w = sdf.writeStream.option("checkpointLocation", checkpoint).outputMode(mode) \
        .trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).start(sink_path)
    q.awaitTermination(timeout_s)
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def window_upsert_sink(path: str):
    """R3 sink: append each micro-batch's updated windows with its batch id;
    ``latest_windows`` reads the newest value per day."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(path)
    return sink


def latest_windows(spark: SparkSession, path: str, key: str = "date") -> DataFrame:
    t = spark.read.parquet(path)
    cols = [c for c in t.columns if c not in (key, "_batch")]
    best = t.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("_batch")).alias("_r"))
    return best.select(key, *[F.col("_r")[c].alias(c) for c in cols])


def upsert_days_sink(raw_path: str, out_path: str, key: str = "id", aggregate=daily_aggregate_of):
    """``foreachBatch`` function keeping ``raw_path`` (posts, deduplicated
    by id, existing rows win) and ``out_path`` (one row per day, partitioned
    by day) up to date. Only the days touched by the batch are recomputed and
    rewritten."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = nan_to_null(batch).withColumn("date", F.to_date("createdAt"))
        # the days of the whole batch, before posts already stored are left out: a batch
        # that is replayed after the append still recomputes its days. A handful of dates.
        days = [r[0] for r in fresh.select("date").distinct().collect() if r[0] is not None]
        if path_exists(spark, raw_path):
            existing = spark.read.parquet(raw_path)
            fresh = fresh.join(existing.select(key), key, "left_anti")
        # ``new`` is defined against the raw table it is appended to: it must be
        # fixed before the append (re-evaluated afterwards it would be empty).
        # A reliable checkpoint in the shared folder also survives executor loss.
        new = reliable_checkpoint(dedup_first(fresh, key, order=("createdAt",)))
        new.write.mode("append").partitionBy("date").parquet(raw_path)
        # the append added files under existing day folders: drop any cached
        # listing of the path before reading it back
        spark.catalog.refreshByPath(raw_path)
        raw = spark.read.parquet(raw_path)
        if not days:
            return
        # literal dates: only these partitions are listed and read
        touched = aggregate(raw.where(F.col("date").isin(days)))
        (touched.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("date").parquet(out_path))
    return sink
