"""Catalogue: incremental state (S3-S15, A16), table operators (S1, S2,
F1, F4, F5) and harvests / replies (S9, S10, W8, J8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily as D
from ..operators import replies as RP
from ..operators import state as ST
from ..sources import fixtures as fx
from ..sources import tables as TB
from ..sources.versioned import read_current, replace_table, write_data
from ..session import scratch_path
from .catalog_daily import SQL_CALENDAR, sql_daily, sql_stats
from .registry import r, register, rounded, with_ctes

# ------------------------------------------------------------------ fixtures


def _split(spark, d):
    """existing = id % 4 < 3; new = id % 4 >= 2 with likeCount + 1000."""
    p = fx.posts(spark, d).select("id", "date", "author", "likeCount")
    k = F.col("id").cast("long") % 4
    existing = p.where(k < 3)
    new = p.where(k >= 2).withColumn("likeCount", F.col("likeCount") + 1000)
    return existing, new


SQL_EXISTING = "SELECT id, date, author, likeCount FROM posts WHERE CAST(id AS BIGINT) % 4 < 3"
SQL_NEW = ("SELECT id, date, author, likeCount + 1000 AS likeCount FROM posts "
           "WHERE CAST(id AS BIGINT) % 4 >= 2")


@register("append_dedup", with_ctes(
    "SELECT * FROM ex UNION ALL SELECT * FROM nw WHERE id NOT IN (SELECT id FROM ex)",
    posts=fx.SQL_POSTS, ex=SQL_EXISTING, nw=SQL_NEW), headline=True)
def q_append_dedup(spark, d):
    existing, new = _split(spark, d)
    return ST.append_dedup(existing, new, key="id")


@register("dedup_posts", with_ctes(
    "SELECT author, date, id, createdAt FROM (SELECT *, row_number() OVER "
    "(PARTITION BY author, date ORDER BY createdAt, id) AS rn FROM posts "
    "WHERE date IS NOT NULL) x WHERE rn = 1", posts=fx.SQL_POSTS))
def q_dedup_posts(spark, d):
    p = fx.posts(spark, d).where(F.col("date").isNotNull()).select("author", "date", "id", "createdAt")
    return ST.dedup_first(p, key=["author", "date"], order=("createdAt", "id"))


UPSERT_SPLIT = ("2024-01-20", "2024-01-18")


@register("upsert_days", with_ctes(
    f"SELECT date, {r('score_negative')} AS score_negative, batch FROM ("
    f"SELECT date, score_negative, 'existing' AS batch FROM daily "
    f"WHERE date <= DATE '{UPSERT_SPLIT[0]}' AND date NOT IN "
    f"(SELECT date FROM daily WHERE date >= DATE '{UPSERT_SPLIT[1]}') "
    f"UNION ALL SELECT date, score_negative, 'fresh' FROM daily "
    f"WHERE date >= DATE '{UPSERT_SPLIT[1]}') u",
    posts=fx.SQL_POSTS, stats=sql_stats(), daily=sql_daily(weighted=False)))
def q_upsert_days(spark, d):
    daily = D.daily_means(fx.posts(spark, d), counts=()).select("date", "score_negative")
    existing = daily.where(F.col("date") <= F.lit(UPSERT_SPLIT[0]).cast("date")) \
                    .withColumn("batch", F.lit("existing"))
    fresh = daily.where(F.col("date") >= F.lit(UPSERT_SPLIT[1]).cast("date")) \
                 .withColumn("batch", F.lit("fresh"))
    return rounded(ST.replace_days(existing, fresh))


@register("pending_days", with_ctes(
    "SELECT CAST(unnest(generate_series(max(date) + 1, max(date) + 4, INTERVAL 1 DAY)) AS DATE) "
    "AS date FROM posts", posts=fx.SQL_POSTS))
def q_pending_days(spark, d):
    p = fx.posts(spark, d)
    return ST.pending_days(p, F.date_add(F.max("date"), 4))


@register("missing_days", with_ctes(
    "SELECT date FROM (SELECT CAST(unnest(generate_series(min(date), max(date) + 2, "
    "INTERVAL 1 DAY)) AS DATE) AS date FROM posts) c "
    "WHERE date NOT IN (SELECT date FROM posts WHERE day(date) % 3 = 0 AND date IS NOT NULL)",
    posts=fx.SQL_POSTS))
def q_missing_days(spark, d):
    p = fx.posts(spark, d)
    b = p.agg(F.min("date").alias("s"), F.date_add(F.max("date"), 2).alias("e")).first()
    done = p.where(F.dayofmonth("date") % 3 == 0)
    return ST.missing_days(spark, b["s"], b["e"], done)


@register("month_windows", with_ctes(
    "SELECT CAST(ws AS DATE) AS window_start, CAST(least(ws + INTERVAL 1 MONTH, e) AS DATE) "
    "AS window_end FROM (SELECT unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS ws, e FROM b) x "
    "WHERE ws < e",
    b="SELECT CAST(min(o_orderdate) AS DATE) + 14 AS s, CAST(max(o_orderdate) AS DATE) AS e "
      "FROM orders"))
def q_month_windows(spark, d):
    o = fx.table(spark, d, "orders")
    b = o.agg(F.date_add(F.to_date(F.min("o_orderdate")), 14).alias("start"),
              F.to_date(F.max("o_orderdate")).alias("end"))
    return ST.month_windows_of(b)


@register("unprocessed", with_ctes(
    "SELECT id, date FROM posts WHERE NOT processed", posts=fx.SQL_POSTS))
def q_unprocessed(spark, d):
    return ST.unprocessed(fx.posts(spark, d)).select("id", "date")


@register("mark_processed", with_ctes(
    "SELECT id, CASE WHEN id IN (SELECT id FROM done) THEN TRUE ELSE processed END AS processed "
    "FROM posts", posts=fx.SQL_POSTS,
    done="SELECT id FROM posts WHERE CAST(id AS BIGINT) % 7 = 0"))
def q_mark_processed(spark, d):
    p = fx.posts(spark, d)
    done = p.where(F.col("id").cast("long") % 7 == 0)
    return ST.mark_processed(p, done).select("id", "processed")


@register("reset_processed", with_ctes(
    "SELECT id, FALSE AS processed FROM posts", posts=fx.SQL_POSTS))
def q_reset_processed(spark, d):
    return ST.reset_processed(fx.posts(spark, d)).select("id", "processed")


def _sql_quality(stage: str, src: str) -> str:
    return (f"SELECT '{stage}' AS stage, count(*) AS n_rows, count(DISTINCT date) AS n_days, "
            f"count(*) FILTER (WHERE date IS NULL) AS n_null_days FROM {src}")


@register("stage_quality", with_ctes(
    " UNION ALL ".join([_sql_quality("raw", "posts"),
                        _sql_quality("unprocessed", "(SELECT * FROM posts WHERE NOT processed) u"),
                        _sql_quality("text", "(SELECT CAST(createdAt AS DATE) AS date FROM tp) t")]),
    posts=fx.SQL_POSTS, tp=fx.SQL_TEXT_POSTS))
def q_stage_quality(spark, d):
    # measured while the stages are written, without a pass of their own
    p = fx.posts(spark, d)
    base = scratch_path(spark, "stages")
    text = fx.text_posts(spark, d).select("id", F.to_date("createdAt").alias("date"))
    return TB.quality_table(spark, [TB.write_observed(df, f"{base}/{name}", name) for name, df in (
        ("raw", p), ("unprocessed", ST.unprocessed(p)), ("text", text))])


# ------------------------------------------------------------------ tables


@register("complete_rows", with_ctes(
    "SELECT date, " + r("prediccion_aprobacion") + " AS prediccion_aprobacion, "
    + r("prediccion_desaprobacion") + " AS prediccion_desaprobacion FROM pred "
    "WHERE prediccion_aprobacion IS NOT NULL AND prediccion_desaprobacion IS NOT NULL",
    posts=fx.SQL_POSTS, polls=fx.SQL_POLLS,
    calp=SQL_CALENDAR,
    pred=fx.SQL_PREDICTIONS))
def q_complete_rows(spark, d):
    pred = fx.predictions(spark, d)
    out = TB.complete_rows(pred, ["prediccion_aprobacion", "prediccion_desaprobacion"])
    return rounded(out.select("date", "prediccion_aprobacion", "prediccion_desaprobacion"))


@register("posts_of_day", with_ctes(
    "SELECT id, author, createdAt FROM posts WHERE date = DATE '2024-01-15'", posts=fx.SQL_POSTS))
def q_posts_of_day(spark, d):
    return TB.posts_of_day(fx.posts(spark, d), "2024-01-15").select("id", "author", "createdAt")


@register("lang_filter", with_ctes(
    "SELECT id, author FROM tp WHERE lang = 'es'", tp=fx.SQL_TEXT_POSTS))
def q_lang_filter(spark, d):
    return TB.lang_filter(fx.text_posts(spark, d), "es").select("id", "author")


@register("csv_roundtrip", with_ctes(
    "SELECT id, createdAt, date, author, likeCount, processed FROM posts", posts=fx.SQL_POSTS))
def q_csv_roundtrip(spark, d):
    p = fx.posts(spark, d).select("id", "createdAt", "date", "author", "likeCount", "processed")
    path = scratch_path(spark, "csv_roundtrip")
    TB.write_table(p, path, fmt="csv")
    return TB.read_table(spark, path, TB.schema_of(p), fmt="csv", date_cols=("date",))


@register("replace_while_read", with_ctes(
    "SELECT CAST(1 AS BIGINT) AS version, author, count(*) AS n, count(*) FILTER (WHERE processed) AS n_processed "
    "FROM posts GROUP BY author UNION ALL "
    "SELECT 2, author, count(*), count(*) FILTER (WHERE processed OR likeCount > 50) FROM posts "
    "WHERE author <> 'error' GROUP BY author", posts=fx.SQL_POSTS))
def q_replace_while_read(spark, d):
    """A table replaced by what is computed from it, beside a reader of the old version and
    a writer that died before its commit."""
    path = scratch_path(spark, "replaced")
    replace_table(fx.posts(spark, d).select("id", "author", "likeCount", "processed"), path)
    old = read_current(spark, path)
    write_data(old.limit(1), path)
    flag = F.coalesce(F.col("processed"), F.lit(False)) | F.coalesce(F.col("likeCount") > 50, F.lit(False))
    replace_table(old.where("author <> 'error'").withColumn("processed", flag), path)

    def counts(df, version):
        return df.groupBy(F.lit(version).cast("long").alias("version"), "author").agg(
            F.count("*").alias("n"), F.count_if("processed").alias("n_processed"))

    return counts(old, 1).unionByName(counts(read_current(spark, path), 2))


# ------------------------------------------------------------------ harvests / replies

HARVEST = dict(start="1995-01-15", end="2001-08-02", n=30)


@register("harvest_author_windows", with_ctes(
    "SELECT id, author, createdAt, window_start, window_end FROM ("
    "SELECT op.*, w.window_start, w.window_end, row_number() OVER (PARTITION BY op.author, "
    "w.window_start ORDER BY op.createdAt DESC, op.id DESC) AS rn FROM op JOIN w "
    "ON CAST(op.createdAt AS DATE) >= w.window_start AND CAST(op.createdAt AS DATE) < w.window_end"
    f") x WHERE rn <= {HARVEST['n']}",
    op=fx.SQL_ORDER_POSTS,
    w="SELECT CAST(ws AS DATE) AS window_start, CAST(least(ws + INTERVAL 1 MONTH, "
      f"DATE '{HARVEST['end']}') AS DATE) AS window_end FROM (SELECT unnest(generate_series("
      f"DATE '{HARVEST['start']}', DATE '{HARVEST['end']}', INTERVAL 1 MONTH)) AS ws) g "
      f"WHERE ws < DATE '{HARVEST['end']}'"), headline=True)
def q_harvest_author_windows(spark, d):
    out = RP.harvest_author_windows(fx.order_posts(spark, d), **HARVEST)
    return out.select("id", "author", "createdAt", "window_start", "window_end")


MENTION_TERMS = ("los", "las", "de la")


def _sql_mentions() -> str:
    pat = RP.mention_pattern(MENTION_TERMS).replace("(?i)", "")
    return with_ctes(
        "SELECT id, date, author, likeCount FROM (SELECT *, row_number() OVER (PARTITION BY date "
        "ORDER BY likeCount DESC, createdAt DESC, id) AS rn FROM m) x WHERE rn <= 30",
        tp=fx.SQL_TEXT_POSTS,
        m=f"SELECT *, CAST(createdAt AS DATE) AS date FROM tp WHERE lang = 'es' "
          f"AND regexp_matches(text, '{pat}', 'i')")


@register("harvest_mentions", _sql_mentions())
def q_harvest_mentions(spark, d):
    out = RP.harvest_mentions(fx.text_posts(spark, d), MENTION_TERMS, lang="es", k=30)
    return out.select("id", "date", "author", "likeCount")


@register("latest_replies", with_ctes(
    "SELECT id, conv_id, turn, createdAt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id "
    "ORDER BY createdAt DESC, id DESC) AS rn FROM cp WHERE turn > 0) x WHERE rn <= 3",
    cp=fx.SQL_CONVERSATION_POSTS))
def q_latest_replies(spark, d):
    c = fx.conversation_posts(spark, d)
    out = RP.latest_replies(c.where(F.col("turn") > 0), n=3)
    return out.select("id", "conv_id", "turn", "createdAt")


@register("reply_enrichment", with_ctes(
    "SELECT r.id, r.conv_id, r.turn, p.id AS parent_tweet_id, p.text AS parent_text, "
    "p.createdAt AS parent_createdAt FROM (SELECT * FROM cp WHERE turn > 0) r "
    "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id "
    "ORDER BY createdAt, id) AS rn FROM cp WHERE turn = 0) y WHERE rn = 1) p USING (conv_id)",
    cp=fx.SQL_CONVERSATION_POSTS))
def q_reply_enrichment(spark, d):
    c = fx.conversation_posts(spark, d)
    out = RP.reply_enrichment(c.where(F.col("turn") > 0), c.where(F.col("turn") == 0))
    return out.select("id", "conv_id", "turn", "parent_tweet_id", "parent_text", "parent_createdAt")

THREADS_N = 40


@register("author_harvest", with_ctes(
    "SELECT r.id, r.conv_id, r.turn, p.id AS parent_tweet_id, p.text AS parent_text, "
    "p.createdAt AS parent_createdAt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id "
    "ORDER BY createdAt DESC, id DESC) AS rn FROM cp WHERE turn > 0 AND conv_id IN (SELECT conv_id FROM h)) r "
    "LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id "
    "ORDER BY createdAt, id) AS prn FROM h) y WHERE prn = 1) p ON p.conv_id = r.conv_id WHERE r.rn <= 3",
    cp=fx.SQL_CONVERSATION_POSTS,
    b="SELECT min(CAST(createdAt AS DATE)) AS s, CAST(max(CAST(createdAt AS DATE)) + 1 AS DATE) AS e FROM cp",
    w="SELECT CAST(ws AS DATE) AS window_start, CAST(least(ws + INTERVAL 1 MONTH, e) AS DATE) AS window_end "
      "FROM (SELECT unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS ws, e FROM b) g WHERE ws < e",
    h="SELECT * FROM (SELECT cp.*, row_number() OVER (PARTITION BY cp.role, w.window_start "
      "ORDER BY cp.createdAt DESC, cp.id DESC) AS rn FROM cp JOIN w ON CAST(cp.createdAt AS DATE) >= w.window_start "
      f"AND CAST(cp.createdAt AS DATE) < w.window_end WHERE cp.turn = 0) x WHERE rn <= {THREADS_N}"))
def q_author_harvest(spark, d):
    c = fx.conversation_posts(spark, d)
    # the months of the posts' own first to last day: the calendar grows with the table
    span = c.agg(F.to_date(F.min("createdAt")).alias("s"), F.date_add(F.to_date(F.max("createdAt")), 1).alias("e")).first()
    out = RP.harvest_with_replies(c.where(F.col("turn") == 0), c.where(F.col("turn") > 0),
                                  author="role", n_replies=3, start=span.s, end=span.e, n=THREADS_N)
    return out.select("id", "conv_id", "turn", "parent_tweet_id", "parent_text", "parent_createdAt")
