"""Catalogue: daily aggregation, polls, windows, flagship feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import parse_created_at, post_date, target_sunday
from ..operators import daily as D
from ..operators.polls import poll_calendar, week_start_join, with_polls
from ..operators.scaling import fit_robust, robust_scale
from ..operators.vectors import daily_embedding_mean
from ..session import scratch_path
from ..sources import fixtures as fx
from .feature_store import FeatureStore
from .features import daily_features
from .registry import r, r_col, register, rounded, with_ctes

SC = D.SCORES
EN = D.ENGAGEMENT
SHORT = D.SCORE_SHORT

# ------------------------------------------------------------------ SQL parts


def sql_stats(src: str = "posts") -> str:
    parts = []
    for c in EN:
        x = f"CAST({c} AS DOUBLE)"
        q25, q50, q75 = (f"quantile_cont({x}, {p})" for p in (0.25, 0.5, 0.75))
        parts.append(f"{q50} AS m_{c}")
        parts.append(f"CASE WHEN {q75} - {q25} = 0 THEN 1.0 ELSE {q75} - {q25} END AS i_{c}")
    return f"SELECT {', '.join(parts)} FROM {src}"


def sql_mean_cols() -> list[str]:
    cols = [f"avg({s}) AS {s}" for s in SC]
    cols += [f"avg((CAST({c} AS DOUBLE) - s.m_{c}) / s.i_{c}) AS {c}" for c in EN]
    return cols


def sql_weighted_cols() -> list[str]:
    cols = []
    for w in EN:
        wc = f"(CAST({w} AS DOUBLE) - s.m_{w})"
        for v in SC:
            cols.append(
                f"CASE WHEN coalesce(sum({wc}), 0) <> 0 "
                f"THEN coalesce(sum({v} * {wc}), 0) / sum({wc}) ELSE avg({v}) END "
                f"AS weighted_{SHORT[v]}_{w}")
    return cols


def sql_daily(keys=(), means=True, weighted=True, src="posts") -> str:
    k = "".join(f"p.{c}, " for c in keys)
    cols = (sql_mean_cols() if means else []) + (sql_weighted_cols() if weighted else [])
    grp = ", ".join([f"p.{c}" for c in keys] + ["p.date"])
    return (f"SELECT {k}p.date AS date, {', '.join(cols)} "
            f"FROM {src} p, stats s WHERE p.date IS NOT NULL GROUP BY {grp}")


SQL_CALENDAR = """
SELECT c.date AS date, p.aprobacion AS aprobacion, p.desaprobacion AS desaprobacion
FROM (SELECT CAST(unnest(generate_series(min(date), max(date) + 6, INTERVAL 1 DAY)) AS DATE) AS date
      FROM polls) c
LEFT JOIN polls p ON p.date = CAST(c.date + CAST(7 - isodow(c.date) AS INTEGER) AS DATE)
"""


def sql_full_mean(c: str, n: int, part: str = "") -> str:
    w = f"({part}ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN avg({c}) OVER {w} END"


def sql_prev_mean(c: str, n: int, part: str = "") -> str:
    w = f"({part}ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({c}) OVER {w} = {n} THEN avg({c}) OVER {w} END"


FEATURE_ORDER = (
    ["date", *SC, *EN]
    + [f"weighted_{SHORT[v]}_{w}" for w in EN for v in SC]
    + ["aprobacion", "desaprobacion"]
    + [f"{nm}_{x}" for nm in ("approval", "disapproval") for x in ("rolling_7d", "lag_7d", "lag_14d")]
    + [f"{s}_lag_{k}" for k in range(1, 8) for s in SC]
    + ["score_negative_rolling7", "score_negative_rolling3", "sentiment_net",
       "sentiment_net_rolling3", "sentiment_net_rolling7", "sentiment_net_rolling14",
       "sentiment_net_change"]
)


def sql_features() -> str:
    lag = []
    for t, nm in (("aprobacion", "approval"), ("desaprobacion", "disapproval")):
        lag.append(f"{sql_prev_mean(t, 7)} AS {nm}_rolling_7d0")
        lag.append(f"lag({t}, 7) OVER (ORDER BY date) AS {nm}_lag_7d")
        lag.append(f"lag({t}, 14) OVER (ORDER BY date) AS {nm}_lag_14d")
    for k in range(1, 8):
        for s in SC:
            lag.append(f"lag({s}, {k}) OVER (ORDER BY date) AS {s}_lag_{k}")
    lag.append(f"{sql_full_mean('score_negative', 7)} AS score_negative_rolling7")
    lag.append(f"{sql_full_mean('score_negative', 3)} AS score_negative_rolling3")
    lag.append("score_positive - score_negative AS sentiment_net")
    f1 = f"SELECT *, {', '.join(lag)} FROM feat0"
    ff = ("last_value({0}_rolling_7d0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN "
          "UNBOUNDED PRECEDING AND CURRENT ROW) AS {0}_rolling_7d")
    f2 = (f"SELECT *, {ff.format('approval')}, {ff.format('disapproval')}, "
          f"{sql_full_mean('sentiment_net', 3)} AS sentiment_net_rolling3, "
          f"{sql_full_mean('sentiment_net', 7)} AS sentiment_net_rolling7, "
          f"{sql_full_mean('sentiment_net', 14)} AS sentiment_net_rolling14, "
          f"sentiment_net - lag(sentiment_net, 1) OVER (ORDER BY date) AS sentiment_net_change "
          f"FROM feat1")
    sel = ", ".join(c if c == "date" else f"{r(c)} AS {c}" for c in FEATURE_ORDER)
    return with_ctes(
        f"SELECT {sel} FROM feat2",
        posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, stats=sql_stats(),
        daily=sql_daily(), calp=SQL_CALENDAR,
        feat0="SELECT d.*, c.aprobacion, c.desaprobacion FROM daily d LEFT JOIN calp c USING (date)",
        feat1=f1, feat2=f2)


# ------------------------------------------------------------------ queries

# posts with a vector: the row of ``embeddings`` numbered by the id modulo their count
SQL_DAILY_EMBEDDING = (
    "SELECT date, list(" + r("v", 5) + " ORDER BY pos) AS embedding FROM ("
    "SELECT p.date, e.pos, avg(CAST(e.val AS DOUBLE)) AS v FROM posts p JOIN ("
    "SELECT vec_id, unnest(embedding) AS val, unnest(range(0, len(embedding))) AS pos FROM embeddings) e "
    "ON e.vec_id = CAST(p.id AS BIGINT) % (SELECT count(*) FROM embeddings) "
    "WHERE p.date IS NOT NULL GROUP BY p.date, e.pos) x GROUP BY date")


def _posts_with_vectors(spark, d):
    e = fx.table(spark, d, "embeddings")
    vectors = e.select(F.col("vec_id").alias("_vec"), "embedding")
    p = fx.posts(spark, d).withColumn("_vec", F.col("id").cast("long") % F.lit(e.count()))
    return p.join(vectors, "_vec", "left").drop("_vec")


def _rounded_vector(out):
    return out.withColumn("embedding", F.transform("embedding", lambda x: r_col(x, 5)))


@register("daily_features", "SELECT f.*, e.embedding FROM (" + sql_features() + ") f LEFT JOIN ("
          + with_ctes(SQL_DAILY_EMBEDDING, posts=fx.SQL_POSTS) + ") e USING (date)", headline=True)
def q_daily_features(spark, d):
    p = _posts_with_vectors(spark, d)
    out = daily_features(p, fx.polls(spark, d, p), embedding="embedding")
    return _rounded_vector(rounded(out.select(*FEATURE_ORDER, "embedding")))


def _store_of_three_runs(spark, d):
    """A store fed by three runs (posts by id, so that the second and third bring late posts
    for every day), one of them replayed, with a wrong day that a last run replaces."""
    p = fx.posts(spark, d)
    step = F.col("id").cast("long") % 3
    bad = F.dayofmonth("date") == 10
    store = FeatureStore(spark, scratch_path(spark, "features"))
    store.append(p.where(step == 0), 1)
    store.append(p.where((step == 1) & ~bad), 2)
    store.append(p.where((step == 1) & ~bad), 2)            # replayed: no effect
    store.append(p.where(step == 2), 3)
    store.append(p.where(bad), 4, replace_days=True)
    return store, p


@register("daily_features_incremental", sql_features)
def q_daily_features_incremental(spark, d):
    store, p = _store_of_three_runs(spark, d)
    return rounded(store.features(fx.polls(spark, d, p))).select(*FEATURE_ORDER)


@register("robust_quartiles_stored", with_ctes(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r(f'm_{c}')} AS median, {r(f'i_{c}')} AS iqr FROM stats"
        for c in EN) + ") x", posts="SELECT * FROM (" + fx.SQL_POSTS + ") p WHERE date IS NOT NULL",
    stats=sql_stats()))
def q_robust_quartiles_stored(spark, d):
    stats = _store_of_three_runs(spark, d)[0].stats()
    return rounded(spark.createDataFrame([(c, stats.median[c], stats.iqr[c]) for c in EN],
                                         "column_name string, median double, iqr double"))


@register("daily_embedding_mean", with_ctes(SQL_DAILY_EMBEDDING, posts=fx.SQL_POSTS))
def q_daily_embedding_mean(spark, d):
    return _rounded_vector(daily_embedding_mean(_posts_with_vectors(spark, d)))


@register("daily_means", with_ctes(
    "SELECT date, " + ", ".join(f"{r(c)} AS {c}" for c in (*SC, *EN)) + " FROM daily",
    posts=fx.SQL_POSTS, stats=sql_stats(), daily=sql_daily(weighted=False)), headline=True)
def q_daily_means(spark, d):
    return rounded(D.daily_means(fx.posts(spark, d)))


WEIGHTED = [f"weighted_{SHORT[v]}_{w}" for w in EN for v in SC]


@register("weighted_sentiment", with_ctes(
    "SELECT author, date, " + ", ".join(f"{r(c)} AS {c}" for c in WEIGHTED) + " FROM daily",
    posts=fx.SQL_POSTS, stats=sql_stats(), daily=sql_daily(keys=("author",), means=False)),
    headline=True)
def q_weighted_sentiment(spark, d):
    return rounded(D.weighted_sentiment(fx.posts(spark, d), keys=("author",)))


ROLL_COLS = ["score_negative_rolling7", "score_negative_rolling3", "sentiment_net",
             "sentiment_net_rolling3", "sentiment_net_rolling7", "sentiment_net_rolling14",
             "sentiment_net_change"]


def _sql_rolling_author() -> str:
    part = "PARTITION BY author "
    inner = (f"SELECT author, date, score_positive, score_negative, "
             f"score_positive - score_negative AS sentiment_net FROM daily")
    cols = [
        f"{sql_full_mean('score_negative', 7, part)} AS score_negative_rolling7",
        f"{sql_full_mean('score_negative', 3, part)} AS score_negative_rolling3",
        "sentiment_net",
        f"{sql_full_mean('sentiment_net', 3, part)} AS sentiment_net_rolling3",
        f"{sql_full_mean('sentiment_net', 7, part)} AS sentiment_net_rolling7",
        f"{sql_full_mean('sentiment_net', 14, part)} AS sentiment_net_rolling14",
        "sentiment_net - lag(sentiment_net, 1) OVER (PARTITION BY author ORDER BY date) AS sentiment_net_change",
    ]
    outer = ", ".join(["author", "date"] + [f"{r(c)} AS {c}" for c in ROLL_COLS])
    return with_ctes(f"SELECT {outer} FROM (SELECT author, date, {', '.join(cols)} FROM base) x",
                     posts=fx.SQL_POSTS, stats=sql_stats(),
                     daily=sql_daily(keys=("author",), weighted=False), base=inner)


@register("rolling_sentiment", _sql_rolling_author(), headline=True)
def q_rolling_sentiment(spark, d):
    daily = D.daily_means(fx.posts(spark, d), keys=("author",), counts=())
    out = D.rolling_sentiment(daily, keys=("author",))
    return rounded(out.select("author", "date", *ROLL_COLS))


@register("sentiment_net_change", with_ctes(
    "SELECT date, " + r("score_positive - score_negative") + " AS sentiment_net, "
    + r("(score_positive - score_negative) - lag(score_positive - score_negative, 1) "
        "OVER (ORDER BY date)") + " AS sentiment_net_change FROM daily",
    posts=fx.SQL_POSTS, stats=sql_stats(), daily=sql_daily(weighted=False)))
def q_sentiment_net_change(spark, d):
    out = D.sentiment_net(D.daily_means(fx.posts(spark, d), counts=()))
    return rounded(out.select("date", "sentiment_net", "sentiment_net_change"))


@register("negativity_index", with_ctes(
    f"SELECT date, {r('avg(score_negative)')} AS indice_negatividad FROM posts "
    "WHERE date IS NOT NULL GROUP BY date", posts=fx.SQL_POSTS))
def q_negativity_index(spark, d):
    return rounded(D.negativity_index(fx.posts(spark, d)))


@register("poll_calendar", with_ctes(
    "SELECT date, aprobacion, desaprobacion FROM calp",
    posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, calp=SQL_CALENDAR))
def q_poll_calendar(spark, d):
    return rounded(poll_calendar(fx.polls(spark, d)))


@register("daily_with_polls", with_ctes(
    "SELECT d.date, " + r("d.score_positive") + " AS score_positive, "
    + r("d.score_negative") + " AS score_negative, c.aprobacion, c.desaprobacion "
    "FROM daily d LEFT JOIN calp c USING (date)",
    posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, stats=sql_stats(),
    daily=sql_daily(weighted=False), calp=SQL_CALENDAR))
def q_daily_with_polls(spark, d):
    p = fx.posts(spark, d)
    out = with_polls(D.daily_means(p, counts=()), poll_calendar(fx.polls(spark, d, p)))
    return rounded(out.select("date", "score_positive", "score_negative", "aprobacion", "desaprobacion"))


@register("week_start_join", with_ctes(
    "SELECT d.date, CAST(date_trunc('week', d.date) AS DATE) AS week_start, "
    + r("d.score_positive") + " AS score_positive, p.aprobacion, p.desaprobacion "
    "FROM daily d LEFT JOIN polls p ON CAST(date_trunc('week', p.date) AS DATE) = "
    "CAST(date_trunc('week', d.date) AS DATE)",
    posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, stats=sql_stats(), daily=sql_daily(weighted=False)))
def q_week_start_join(spark, d):
    p = fx.posts(spark, d)
    out = week_start_join(D.daily_means(p, counts=()), fx.polls(spark, d, p))
    return rounded(out.select("date", "week_start", "score_positive", "aprobacion", "desaprobacion"))


@register("target_sunday", with_ctes(
    "SELECT DISTINCT date, CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE) AS target_sunday "
    "FROM posts WHERE date IS NOT NULL", posts=fx.SQL_POSTS))
def q_target_sunday(spark, d):
    p = fx.posts(spark, d).where(F.col("date").isNotNull())
    return p.select("date", target_sunday("date").alias("target_sunday")).distinct()


def _poll_daily_sql(body: str) -> str:
    return with_ctes(body, posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, stats=sql_stats(),
                     daily=sql_daily(weighted=False), calp=SQL_CALENDAR,
                     feat0="SELECT d.*, c.aprobacion, c.desaprobacion FROM daily d "
                           "LEFT JOIN calp c USING (date)")


def _poll_daily(spark, d):
    p = fx.posts(spark, d)
    return with_polls(D.daily_means(p, counts=()), poll_calendar(fx.polls(spark, d, p)))


@register("poll_lags", _poll_daily_sql(
    "SELECT date, aprobacion, "
    "lag(aprobacion, 7) OVER w AS approval_lag_7d, lag(aprobacion, 14) OVER w AS approval_lag_14d, "
    "lag(desaprobacion, 7) OVER w AS disapproval_lag_7d, "
    "lag(desaprobacion, 14) OVER w AS disapproval_lag_14d FROM feat0 WINDOW w AS (ORDER BY date)"))
def q_poll_lags(spark, d):
    out = D.poll_lags(_poll_daily(spark, d))
    return rounded(out.select("date", "aprobacion", "approval_lag_7d", "approval_lag_14d",
                              "disapproval_lag_7d", "disapproval_lag_14d"))


@register("poll_rolling_ffill", _poll_daily_sql(
    "SELECT date, aprobacion, "
    f"{r('last_value(a0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS approval_rolling_7d, "
    f"{r('last_value(d0 IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS disapproval_rolling_7d "
    f"FROM (SELECT date, aprobacion, {sql_prev_mean('aprobacion', 7)} AS a0, "
    f"{sql_prev_mean('desaprobacion', 7)} AS d0 FROM feat0) x"))
def q_poll_rolling_ffill(spark, d):
    out = D.poll_rolling_ffill(_poll_daily(spark, d))
    return rounded(out.select("date", "aprobacion", "approval_rolling_7d", "disapproval_rolling_7d"))


LAG_COLS = [f"{s}_lag_{k}" for k in range(1, 8) for s in SC]


@register("score_lags", with_ctes(
    "SELECT author, date, " + ", ".join(
        f"{r(f'lag({s}, {k}) OVER (PARTITION BY author ORDER BY date)')} AS {s}_lag_{k}"
        for k in range(1, 8) for s in SC) + " FROM daily",
    posts=fx.SQL_POSTS, stats=sql_stats(), daily=sql_daily(keys=("author",), weighted=False)))
def q_score_lags(spark, d):
    out = D.score_lags(D.daily_means(fx.posts(spark, d), keys=("author",), counts=()), keys=("author",))
    return rounded(out.select("author", "date", *LAG_COLS))


@register("robust_scale", with_ctes(
    "SELECT p.id, " + ", ".join(f"{r(f'(CAST(p.{c} AS DOUBLE) - s.m_{c}) / s.i_{c}')} AS {c}"
                                for c in EN) + " FROM posts p, stats s",
    posts=fx.SQL_POSTS, stats=sql_stats()))
def q_robust_scale(spark, d):
    p = fx.posts(spark, d)
    return rounded(robust_scale(p, fit_robust(p, EN)).select("id", *EN))


@register("post_date", with_ctes(
    "SELECT id, CAST(createdAt AS DATE) AS date FROM posts", posts=fx.SQL_POSTS))
def q_post_date(spark, d):
    p = fx.posts(spark, d)
    return p.select("id", post_date("createdAt").alias("date"))


# createdAt rendered as text in two formats plus junk, then parsed back
SQL_RAW_TS = """
SELECT CAST(event_id AS VARCHAR) AS id,
       CASE WHEN event_id % 13 = 0 THEN 'not a date'
            WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
            ELSE strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') END AS raw
FROM events
"""


@register("parse_created_at", with_ctes(
    "SELECT id, coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(substr(raw, 5), '%b %d %H:%M:%S +0000 %Y')) AS createdAt, "
    "CAST(coalesce(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), "
    "try_strptime(substr(raw, 5), '%b %d %H:%M:%S +0000 %Y')) AS DATE) AS date FROM raw_ts",
    raw_ts=SQL_RAW_TS))
def q_parse_created_at(spark, d):
    e = fx.table(spark, d, "events")
    eid = F.col("event_id")
    raw = e.select(eid.cast("string").alias("id"),
                   F.when(eid % 13 == 0, F.lit("not a date"))
                   .when(eid % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
                   .otherwise(F.date_format("ts", "EEE MMM dd HH:mm:ss +0000 yyyy")).alias("raw"))
    ts = parse_created_at("raw")
    return raw.select("id", ts.alias("createdAt"), post_date(ts).alias("date"))
