"""Catalogue: forecast (W9, X14, A15, M3-M6, J7) and the ML text scorer (M1)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import forecast as FC
from ..operators.scaling import fit_minmax, minmax_scale
from ..operators.scorer import fit_text_classifier, score_text
from ..sources import fixtures as fx
from .catalog_daily import FEATURE_ORDER, sql_features
from . import daily_run as DR
from .features import daily_features
from .registry import r, register, rounded, with_ctes

SQL_SPLIT = ("SELECT *, row_number() OVER (ORDER BY date) <= floor(0.8 * count(*) OVER ()) "
             "AS in_sample FROM od")


@register("temporal_split", with_ctes(
    "SELECT date, in_sample FROM sp", od=fx.SQL_DAILY_ORDERS, sp=SQL_SPLIT))
def q_temporal_split(spark, d):
    return FC.temporal_split(fx.daily_orders(spark, d)).select("date", "in_sample")


@register("minmax_scale", with_ctes(
    "SELECT date, " + ", ".join(
        f"{r(f'(CAST({c} AS DOUBLE) - s.lo_{c}) / CASE WHEN s.hi_{c} = s.lo_{c} THEN 1.0 ELSE s.hi_{c} - s.lo_{c} END')} AS {c}"
        for c in ("avg_price", "share_f")) + " FROM sp, st s",
    od=fx.SQL_DAILY_ORDERS, sp=SQL_SPLIT,
    st="SELECT min(avg_price) AS lo_avg_price, max(avg_price) AS hi_avg_price, "
       "min(share_f) AS lo_share_f, max(share_f) AS hi_share_f FROM sp WHERE in_sample"))
def q_minmax_scale(spark, d):
    sp = FC.temporal_split(fx.daily_orders(spark, d))
    st = fit_minmax(sp.where(F.col("in_sample")), ["avg_price", "share_f"])
    return rounded(minmax_scale(sp, st).select("date", "avg_price", "share_f"))


@register("regression_metrics", with_ctes(
    f"SELECT {r('avg(abs(share_f - p))')} AS mae, "
    f"{r('1 - sum((share_f - p) * (share_f - p)) / nullif(var_pop(share_f) * count(*), 0)')} AS r2, "
    "count(*) AS n FROM (SELECT share_f, lag(share_f, 7) OVER (ORDER BY date) AS p FROM od) x "
    "WHERE share_f IS NOT NULL AND p IS NOT NULL", od=fx.SQL_DAILY_ORDERS))
def q_regression_metrics(spark, d):
    od = fx.daily_orders(spark, d).withColumn(
        "p", F.lag("share_f", 7).over(Window.orderBy("date")))
    return rounded(FC.regression_metrics(od, "share_f", "p"))


@register("merge_predictions", "WITH f AS (" + sql_features() + ") "
          "SELECT date, a.prediccion_aprobacion, b.prediccion_desaprobacion FROM "
          "(SELECT date, approval_lag_7d AS prediccion_aprobacion FROM f "
          "WHERE approval_lag_7d IS NOT NULL) a FULL JOIN "
          "(SELECT date, disapproval_lag_14d AS prediccion_desaprobacion FROM f "
          "WHERE disapproval_lag_14d IS NOT NULL) b USING (date)")
def q_merge_predictions(spark, d):
    p = fx.posts(spark, d)
    f = rounded(daily_features(p, fx.polls(spark, d, p)).select(*FEATURE_ORDER))
    a = f.where(F.col("approval_lag_7d").isNotNull()).select(
        "date", F.col("approval_lag_7d").alias("prediccion_aprobacion"))
    b = f.where(F.col("disapproval_lag_14d").isNotNull()).select(
        "date", F.col("disapproval_lag_14d").alias("prediccion_desaprobacion"))
    return FC.merge_predictions(a, b)


ORDER_FEATURES = [f"share_f_lag_{k}" for k in range(1, 8)] + ["avg_price_lag_1"]


def _order_features(spark, d):
    w = Window.orderBy("date")
    od = fx.daily_orders(spark, d)
    return od.withColumns({**{f"share_f_lag_{k}": F.lag("share_f", k).over(w) for k in range(1, 8)},
                           "avg_price_lag_1": F.lag("avg_price", 1).over(w)})


@register("train_eval")
def q_train_eval(spark, d):
    _, metrics = FC.train(_order_features(spark, d), ORDER_FEATURES, "share_f")
    return metrics


@register("predict_targets")
def q_predict_targets(spark, d):
    p = fx.posts(spark, d)
    return DR.forecast_targets(p, fx.polls(spark, d, p))[0]


@register("score_sentiment_ml")
def q_score_sentiment_ml(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    lab = fx.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    model = fit_text_classifier(docs.join(lab, "doc_id"), label="label")
    out = score_text(docs, model, classes=("low", "high"))
    return out.select("doc_id", "predicted", "score_label")
