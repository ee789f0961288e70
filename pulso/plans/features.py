"""The daily feature table (scores, engagement, weighted scores, polls,
lags, rolling means, net sentiment), optionally merged into stored rows.

Plan shape: one scan of posts -> one hash aggregate (means + 12 weighted
scores, map-side partial aggregation) -> join with the poll calendar (tiny,
AQE broadcasts it) -> one sort per key for all window columns. The robust
scaler statistics are a separate small aggregate job (fit), then literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.daily import (ENGAGEMENT, SCORES, daily_aggregate, forward_fill,
                               full_window_mean)
from ..operators.polls import poll_calendar, with_polls
from ..operators.scaling import RobustStats, fit_robust
from ..operators.state import replace_days
from ..operators.vectors import daily_embedding_mean

POLL_NAMES = (("aprobacion", "approval"), ("desaprobacion", "disapproval"))


def feature_columns(keys=(), score_lag_n: int = 7) -> dict:
    """Window features over a daily table that already has scores and polls."""
    w = Window.partitionBy(*keys).orderBy("date")
    prev7 = w.rowsBetween(-7, -1)
    cols = {}
    for t, nm in POLL_NAMES:
        cols[f"{nm}_rolling_7d"] = F.when(F.count(F.col(t)).over(prev7) == 7,
                                          F.avg(F.col(t)).over(prev7))
        cols[f"{nm}_lag_7d"] = F.lag(t, 7).over(w)
        cols[f"{nm}_lag_14d"] = F.lag(t, 14).over(w)
    for k in range(1, score_lag_n + 1):
        for s in SCORES:
            cols[f"{s}_lag_{k}"] = F.lag(s, k).over(w)
    cols["score_negative_rolling7"] = full_window_mean("score_negative", 7, w)
    cols["score_negative_rolling3"] = full_window_mean("score_negative", 3, w)
    return cols


def features_of_daily(daily: DataFrame, polls: DataFrame, keys=()) -> DataFrame:
    """Polls and window features beside one row per (keys, day) of scores and engagement."""
    feat = with_polls(daily, poll_calendar(polls))
    feat = feat.withColumns(feature_columns(keys))
    feat = forward_fill(feat, [f"{nm}_rolling_7d" for _, nm in POLL_NAMES], keys)
    w = Window.partitionBy(*keys).orderBy("date")
    feat = feat.withColumn("sentiment_net", F.col("score_positive") - F.col("score_negative"))
    feat = feat.withColumns({
        "sentiment_net_rolling3": full_window_mean("sentiment_net", 3, w),
        "sentiment_net_rolling7": full_window_mean("sentiment_net", 7, w),
        "sentiment_net_rolling14": full_window_mean("sentiment_net", 14, w),
        "sentiment_net_change": F.col("sentiment_net") - F.lag("sentiment_net", 1).over(w),
    })
    return feat


def daily_features(posts: DataFrame, polls: DataFrame, keys=(), existing: DataFrame | None = None,
                   stats: RobustStats | None = None, embedding: str | None = None) -> DataFrame:
    """The feature table, one row per (keys, day). ``embedding`` names a vector
    column of ``posts``: its mean per day is added under that name (an array, null on
    a day without vectors), joined as one row per day."""
    stats = stats or fit_robust(posts, ENGAGEMENT)
    daily = daily_aggregate(posts, keys, stats)
    if embedding:
        daily = daily.join(daily_embedding_mean(posts, keys, embedding), [*keys, "date"], "left")
    feat = features_of_daily(daily, polls, keys)
    if existing is not None:
        feat = replace_days(existing, feat, keys=keys)
    return feat
