"""Catalogue: daily metrics (P3) and report indicators."""

from __future__ import annotations

from ..functions.sentiment import classify_sentiment
from ..operators import daily as D
from ..operators import kpi as K
from ..operators import metrics as M
from ..sources import fixtures as fx
from .catalog_daily import SQL_CALENDAR, sql_daily, sql_stats
from . import daily_run as DR
from .registry import r, register, rounded, with_ctes

# ------------------------------------------------------------------ SQL parts


def sql_class(ties: str = "drop") -> str:
    m = "greatest(score_positive, score_negative, score_neutral)"
    hits = (f"CAST(score_positive = {m} AS INTEGER) + CAST(score_negative = {m} AS INTEGER) "
            f"+ CAST(score_neutral = {m} AS INTEGER)")
    tie = "neutral" if ties == "neutral" else "tie"
    return (f"CASE WHEN score_positive IS NULL OR score_negative IS NULL OR score_neutral IS NULL "
            f"THEN NULL WHEN {hits} > 1 THEN '{tie}' WHEN score_positive = {m} THEN 'positive' "
            f"WHEN score_negative = {m} THEN 'negative' ELSE 'neutral' END")


def sql_counts(keys=(), ties: str = "drop") -> str:
    k = "".join(f"{c}, " for c in keys)
    cols = ", ".join(f"count(*) FILTER (WHERE cls = '{c}') AS {out}" for c, out in M.CLASS_COLUMNS)
    return (f"SELECT {k}date, {cols} FROM (SELECT *, {sql_class(ties)} AS cls FROM posts "
            f"WHERE date IS NOT NULL AND score_positive IS NOT NULL AND score_negative IS NOT NULL "
            f"AND score_neutral IS NOT NULL) x GROUP BY {k}date")


SQL_SHARE = ("SELECT *, tweets_negativos + tweets_positivos + tweets_neutros AS total_tweets, "
             "CAST(tweets_negativos AS DOUBLE) / nullif(tweets_negativos + tweets_positivos "
             "+ tweets_neutros, 0) AS porcentaje_tweets_negativos FROM counts")


def sql_metrics(keys=()) -> str:
    k = "".join(f"{c}, " for c in keys)
    using = ", ".join([*keys, "date"])
    neg = f"SELECT {k}date, avg(score_negative) AS indice_negatividad FROM daily GROUP BY {k}date"
    return (f"SELECT {k}date, {', '.join(M.METRIC_COLUMNS)} FROM ({neg}) n "
            f"FULL JOIN share USING ({using})")


def metric_ctes(keys=()) -> dict:
    return dict(posts=fx.SQL_POSTS, stats=sql_stats(),
                daily=sql_daily(keys=keys, weighted=False), counts=sql_counts(keys),
                share=SQL_SHARE, metrics=sql_metrics(keys))


def sel_metrics(prefix: str = "", keys=()) -> str:
    out = [*keys, "date"]
    for c in M.METRIC_COLUMNS:
        if c in ("indice_negatividad", "porcentaje_tweets_negativos"):
            out.append(f"{r(prefix + c)} AS {c}")
        else:
            out.append(f"{prefix}{c} AS {c}")
    return ", ".join(out)


def _metrics(spark, d, keys=()):
    p = fx.posts(spark, d)
    return M.daily_metrics(D.daily_means(p, keys=keys, counts=()), p, keys=keys)


# ------------------------------------------------------------------ P3

@register("classify_sentiment", with_ctes(
    f"SELECT id, {sql_class('neutral')} AS sentiment_class FROM posts", posts=fx.SQL_POSTS))
def q_classify_sentiment(spark, d):
    return fx.posts(spark, d).select("id", classify_sentiment(ties="neutral").alias("sentiment_class"))


@register("daily_class_counts", with_ctes(
    "SELECT * FROM counts", posts=fx.SQL_POSTS, counts=sql_counts()), headline=True)
def q_daily_class_counts(spark, d):
    return M.daily_class_counts(fx.posts(spark, d))


@register("negative_share", with_ctes(
    f"SELECT author, date, tweets_negativos, tweets_positivos, tweets_neutros, total_tweets, "
    f"{r('porcentaje_tweets_negativos')} AS porcentaje_tweets_negativos FROM share",
    posts=fx.SQL_POSTS, counts=sql_counts(("author",)), share=SQL_SHARE))
def q_negative_share(spark, d):
    return rounded(M.negative_share(M.daily_class_counts(fx.posts(spark, d), keys=("author",))))


@register("daily_metrics", with_ctes(f"SELECT {sel_metrics()} FROM metrics", **metric_ctes()),
          headline=True)
def q_daily_metrics(spark, d):
    return rounded(_metrics(spark, d))


@register("predictions_with_metrics", with_ctes(
    "SELECT p.date, " + r("p.prediccion_aprobacion") + " AS prediccion_aprobacion, "
    + r("p.prediccion_desaprobacion") + " AS prediccion_desaprobacion, "
    + ", ".join(f"{r('m.' + c)} AS {c}" if c in ("indice_negatividad", "porcentaje_tweets_negativos")
                else f"m.{c} AS {c}" for c in M.METRIC_COLUMNS)
    + " FROM pred p LEFT JOIN metrics m USING (date)",
    **metric_ctes(), polls=fx.SQL_POLLS, calp=SQL_CALENDAR, pred=fx.SQL_PREDICTIONS))
def q_predictions_with_metrics(spark, d):
    p = fx.posts(spark, d)
    pred = fx.predictions(spark, d, p)
    out = M.predictions_with_metrics(pred, M.daily_metrics(D.daily_means(p, counts=()), p))
    return rounded(out.select("date", "prediccion_aprobacion", "prediccion_desaprobacion",
                              *M.METRIC_COLUMNS))


# ------------------------------------------------------------------ P6

KPI_COLS = ("indice_negatividad", "porcentaje_tweets_negativos")


def sql_indicator(name: str, last: str, prev: str) -> list[str]:
    delta = f"(({last}) - ({prev})) * 100.0"
    return [f"{r(f'({last}) * 100.0')} AS {name}_value_pct",
            f"{r(delta)} AS {name}_delta_pp",
            f"CASE WHEN {delta} IS NULL THEN NULL WHEN {delta} > 0 THEN 'up' ELSE 'down' END "
            f"AS {name}_direction",
            f"CASE WHEN ({last}) IS NULL THEN NULL ELSE {r(f'least(({last}) * 100.0, 100.0)')} END "
            f"AS {name}_bar_pct"]


def _sql_kpi_latest() -> str:
    two = ("SELECT author, date, " + ", ".join(KPI_COLS)
           + ", row_number() OVER (PARTITION BY author ORDER BY date DESC) AS rn "
           "FROM metrics WHERE date IS NOT NULL")
    agg = ("SELECT author, max(date) AS date, max(CASE WHEN rn = 2 THEN date END) AS previous_date, "
           + ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS l_{c}, "
                       f"max(CASE WHEN rn = 2 THEN {c} END) AS p_{c}" for c in KPI_COLS)
           + " FROM two WHERE rn <= 2 GROUP BY author")
    cols = ["author", "date", "previous_date"]
    for c in KPI_COLS:
        cols += sql_indicator(c, f"l_{c}", f"p_{c}")
    return with_ctes(f"SELECT {', '.join(cols)} FROM agg", **metric_ctes(("author",)),
                     two=two, agg=agg)


@register("kpi_latest", _sql_kpi_latest())
def q_kpi_latest(spark, d):
    m = _metrics(spark, d, keys=("author",))
    return rounded(K.kpi_latest(m, KPI_COLS, keys=("author",)))


@register("kpi_prev_calendar_day", with_ctes(
    "SELECT a.date, " + r("a.avg_price") + " AS avg_price, "
    + r("a.avg_price - b.avg_price") + " AS avg_price_delta, "
    + r("a.share_f") + " AS share_f, " + r("a.share_f - b.share_f") + " AS share_f_delta "
    "FROM od a LEFT JOIN od b ON b.date = a.date - 1", od=fx.SQL_DAILY_ORDERS))
def q_kpi_prev_calendar_day(spark, d):
    return rounded(K.kpi_prev_calendar_day(fx.daily_orders(spark, d), ["avg_price", "share_f"]))


LAST7_DAY = "2024-01-27"


@register("last7", with_ctes(
    f"SELECT author, date, {r('porcentaje_tweets_negativos')} AS porcentaje_tweets_negativos "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY date DESC) AS rn "
    f"FROM metrics WHERE date <= DATE '{LAST7_DAY}' AND porcentaje_tweets_negativos IS NOT NULL) x "
    f"WHERE rn <= 7", **metric_ctes(("author",))))
def q_last7(spark, d):
    m = _metrics(spark, d, keys=("author",))
    return rounded(K.last_valid(m, "porcentaje_tweets_negativos", LAST7_DAY, 7, keys=("author",)))


CMP = dict(start="2024-01-05", end="2024-01-25", floor="2024-01-03")


@register("comparison_series", with_ctes(
    "SELECT date, serie, " + r("valor") + " AS valor FROM ("
    "SELECT date, 'prediccion_aprobacion' AS serie, prediccion_aprobacion AS valor FROM pr UNION ALL "
    "SELECT date, 'prediccion_desaprobacion', prediccion_desaprobacion FROM pr UNION ALL "
    "SELECT date, 'aprobacion', aprobacion FROM po UNION ALL "
    "SELECT date, 'desaprobacion', desaprobacion FROM po) u",
    posts=fx.SQL_POSTS, polls=fx.SQL_POLLS, calp=SQL_CALENDAR, pred=fx.SQL_PREDICTIONS,
    pr=f"SELECT * FROM pred WHERE date BETWEEN DATE '{CMP['start']}' AND DATE '{CMP['end']}' "
       f"AND date >= DATE '{CMP['floor']}'",
    po=f"SELECT * FROM polls WHERE date BETWEEN DATE '{CMP['start']}' AND DATE '{CMP['end']}' "
       f"AND date >= DATE '{CMP['floor']}'"))
def q_comparison_series(spark, d):
    p = fx.posts(spark, d)
    out = K.comparison_series(fx.predictions(spark, d, p), fx.polls(spark, d, p), **CMP)
    return rounded(out)


@register("series_bounds", with_ctes(
    "SELECT author, min(date) AS min_date, max(date) AS max_date, count(DISTINCT date) AS n_days "
    "FROM posts GROUP BY author", posts=fx.SQL_POSTS))
def q_series_bounds(spark, d):
    return K.series_bounds(fx.posts(spark, d), keys=("author",))


@register("distinct_days", with_ctes(
    "SELECT DISTINCT date FROM posts WHERE date IS NOT NULL", posts=fx.SQL_POSTS))
def q_distinct_days(spark, d):
    return K.distinct_days(fx.posts(spark, d))


@register("date_range", with_ctes(
    "SELECT id, date, author FROM posts WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' "
    "AND date >= DATE '2024-01-10'", posts=fx.SQL_POSTS))
def q_date_range(spark, d):
    out = K.date_range(fx.posts(spark, d), "2024-01-05", "2024-01-25", floor="2024-01-10")
    return out.select("id", "date", "author")


# ------------------------------------------------------------------ P6 report

REPORT_COLS = ("prediccion_aprobacion", "prediccion_desaprobacion", "indice_negatividad",
               "porcentaje_tweets_negativos")


def sql_kpi(src: str, cols, keys=()) -> dict:
    k = "".join(f"{c}, " for c in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    grp = f" GROUP BY {', '.join(keys)}" if keys else ""
    two = (f"SELECT {k}date, {', '.join(cols)}, row_number() OVER ({part}ORDER BY date DESC) AS rn "
           f"FROM {src} WHERE date IS NOT NULL")
    agg = (f"SELECT {k}max(date) AS date, max(CASE WHEN rn = 2 THEN date END) AS previous_date, "
           + ", ".join(f"max(CASE WHEN rn = 1 THEN {c} END) AS l_{c}, "
                       f"max(CASE WHEN rn = 2 THEN {c} END) AS p_{c}" for c in cols)
           + f" FROM two WHERE rn <= 2{grp}")
    out = [*keys, "date", "previous_date"]
    for c in cols:
        out += sql_indicator(c, f"l_{c}", f"p_{c}")
    return dict(two=two, agg=agg, body=f"SELECT {', '.join(out)} FROM agg")


def _sql_report() -> str:
    parts = sql_kpi("pm", REPORT_COLS)
    pm = ("SELECT p.date, p.prediccion_aprobacion, p.prediccion_desaprobacion, m.indice_negatividad, "
          "m.porcentaje_tweets_negativos FROM pred p LEFT JOIN metrics m USING (date)")
    return with_ctes(parts["body"], **metric_ctes(), polls=fx.SQL_POLLS, calp=SQL_CALENDAR,
                     pred=fx.SQL_PREDICTIONS, pm=pm, two=parts["two"], agg=parts["agg"])


@register("kpi_report", _sql_report())
def q_kpi_report(spark, d):
    p = fx.posts(spark, d)
    return rounded(DR.kpi_report(p, fx.predictions(spark, d, p), REPORT_COLS))
