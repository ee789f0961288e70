"""Catalogue: streaming forms of the incremental state.

Each query runs a Structured Streaming job over the test tables with the
``availableNow`` trigger into a fresh folder under the shared checkpoint
folder, then returns the sink read back as a batch frame. The duplicate
source is the same events file read by two streams (no data is copied).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.daily import SCORES
from ..session import scratch_path
from ..sources import fixtures as fx
from ..streaming import posts as ST
from ..streaming.id_index import IdIndex
from . import sql_text as S
from .registry import r, register, rounded, with_ctes


def _events_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    src = ST.read_stream(spark, f"{d.rstrip('/')}/events*.parquet", schema)
    return fx.posts_of_events(src, ts_type="timestamp")


def _doubled_events_stream(spark, d):
    return _events_stream(spark, d).unionByName(_events_stream(spark, d))


@register("stream_dedup", with_ctes("SELECT id, createdAt FROM posts", posts=fx.SQL_POSTS))
def q_stream_dedup(spark, d):
    base = scratch_path(spark, "stream_dedup")
    q = _doubled_events_stream(spark, d).select("id", "createdAt")
    index = IdIndex(spark, f"{base}/ids", buckets=16)
    ST.run_available_now(q, f"{base}/ckpt", foreach_batch=ST.indexed_dedup_sink(f"{base}/out", index))
    out = spark.read.parquet(f"{base}/out")
    return out.select("id", F.col("createdAt").cast("timestamp_ntz").alias("createdAt"))


@register("stream_clean", with_ctes(
    "SELECT id, clean AS text FROM (SELECT id, " + S.clean_post_text("text")
    + " AS clean FROM tp) x WHERE clean IS NOT NULL", tp=fx.SQL_TEXT_POSTS))
def q_stream_clean(spark, d):
    base = scratch_path(spark, "stream_clean")
    docs = ST.read_stream(spark, f"{d.rstrip('/')}/documents*.parquet",
                          fx.table(spark, d, "documents").schema)
    pages = fx.table(spark, d, "pages").select("page_id", "url")
    tp = fx.text_posts_of(docs, pages, pages.count())
    q = ST.stream_clean(tp).select("id", "text")
    ST.run_available_now(q, f"{base}/ckpt", sink_path=f"{base}/out")
    return spark.read.parquet(f"{base}/out")


SQL_DAILY = with_ctes(
    "SELECT date, " + ", ".join(f"{r(f'avg({c})')} AS {c}" for c in SCORES)
    + ", count(*) AS n_posts FROM posts WHERE date IS NOT NULL GROUP BY date", posts=fx.SQL_POSTS)


@register("stream_daily_means", SQL_DAILY)
def q_stream_daily_means(spark, d):
    base = scratch_path(spark, "stream_daily")
    q = ST.stream_daily_means(_events_stream(spark, d))
    ST.run_available_now(q, f"{base}/ckpt", mode="update",
                         foreach_batch=ST.window_upsert_sink(f"{base}/out"))
    return rounded(ST.latest_windows(spark, f"{base}/out").select("date", *SCORES, "n_posts"))


@register("stream_upsert_days", SQL_DAILY)
def q_stream_upsert_days(spark, d):
    base = scratch_path(spark, "stream_upsert")
    cols = ["id", "createdAt", *SCORES]
    q = _doubled_events_stream(spark, d).select(*cols)
    ST.run_available_now(q, f"{base}/ckpt",
                         foreach_batch=ST.indexed_upsert_days_sink(
                             f"{base}/raw", f"{base}/out", IdIndex(spark, f"{base}/ids", buckets=16)))
    out = spark.read.parquet(f"{base}/out")
    return rounded(out.select("date", *SCORES, "n_posts"))
