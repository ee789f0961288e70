"""Daily aggregation and ordered-window features.

Every operator takes ``keys`` (partition columns such as author); ``()`` is
the single national series. Windows run over ``partitionBy(*keys)
.orderBy("date")`` with *row* frames: offsets count days present, not
calendar days, as in the reference. With no keys the windowed input is one
row per day, so the single window partition is bounded by the number of days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import nan_to_null, require_columns
from .scaling import RobustStats, fit_robust

SCORES = ("score_positive", "score_negative", "score_neutral")
ENGAGEMENT = ("retweetCount", "replyCount", "likeCount", "quoteCount")
SCORE_SHORT = {"score_positive": "positive", "score_negative": "negative",
               "score_neutral": "neutral"}


def _dated(df: DataFrame, cols=()) -> DataFrame:
    # pandas drops null group keys; Spark keeps them -> filter first
    # pandas skips NaN in every mean; Spark does not -> null first
    require_columns(df, ["date", *cols])
    return nan_to_null(df.where(F.col("date").isNotNull()))


def _win(keys) -> Window:
    return Window.partitionBy(*keys).orderBy("date")


# ----------------------------------------------------------------- A1 / A3
def mean_aggs(scores=SCORES, counts=ENGAGEMENT) -> list[Column]:
    """Plain means of scores and of raw engagement counts."""
    return [F.avg(c).alias(c) for c in scores] + [F.avg(F.col(c).cast("double")).alias(c) for c in counts]


def weighted_aggs(stats: RobustStats, scores=SCORES, weights=ENGAGEMENT) -> list[Column]:
    """A3 as plain aggregate expressions (one hash aggregate for all 12).

    ``weighted = sum(v*w)/sum(w)`` if ``sum(w) != 0`` else ``mean(v)`` with
    ``w`` robust-scaled. The IQR cancels in the ratio, so ``w - median`` is
    used; with integer counts and a median that is a multiple of 1/2,
    ``sum(w) - median*count(w)`` is exact, and the zero test is exact.
    Null rules (as pandas): a null value with a weight still counts in the
    denominator; a null weight is skipped; all weights null -> plain mean;
    all values null with non-zero weights -> 0.0.
    Expressed through ``sum(w)``, ``sum(v*w)``, ``sum(v | w not null)`` so the
    partial (map-side) aggregate carries a few numbers per group.
    """
    out = []
    for w in weights:
        med = F.lit(stats.center(w))
        wd = F.col(w).cast("double")
        den = F.coalesce(F.sum(wd) - med * F.count(wd), F.lit(0.0))
        for v in scores:
            vd = F.col(v).cast("double")
            num = (F.coalesce(F.sum(vd * wd), F.lit(0.0))
                   - med * F.coalesce(F.sum(F.when(wd.isNotNull(), vd)), F.lit(0.0)))
            out.append(F.when(den != 0, num / den).otherwise(F.avg(vd))
                       .alias(f"weighted_{SCORE_SHORT.get(v, v)}_{w}"))
    return out


def daily_means(df: DataFrame, keys=(), stats: RobustStats | None = None,
                scores=SCORES, counts=ENGAGEMENT) -> DataFrame:
    """A1: per (keys, day) mean of scores and robust-scaled engagement.

    The mean of a scaled column is the scaled mean, so scaling is applied to
    the per-day aggregate and the partial aggregate stays narrow.
    """
    stats = stats or fit_robust(df, counts)
    agg = _dated(df, [*keys, *scores, *counts]).groupBy(*keys, "date").agg(*mean_aggs(scores, counts))
    return agg.withColumns({
        c: (F.col(c) - F.lit(stats.center(c))) / F.lit(stats.scale(c)) for c in counts})


def weighted_sentiment(df: DataFrame, keys=(), stats: RobustStats | None = None,
                       scores=SCORES, weights=ENGAGEMENT) -> DataFrame:
    """A3 + J4: the 12 engagement-weighted scores per (keys, day), one aggregate."""
    stats = stats or fit_robust(df, weights)
    return _dated(df, [*keys, *scores, *weights]).groupBy(*keys, "date").agg(
        *weighted_aggs(stats, scores, weights))


def daily_sums(df: DataFrame, keys=(), scores=SCORES, counts=ENGAGEMENT) -> DataFrame:
    """What A1 and A3 need of the posts of a (keys, day), as sums that add up over batches
    (``add_sums``): of each value, each weight, each product, and of each value where the
    weight is known, with the numbers of values and weights."""
    aggs = []
    for c in (*scores, *counts):
        x = F.col(c).cast("double")
        aggs += [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"sum_{c}"), F.count(x).alias(f"n_{c}")]
    for w in counts:
        wd = F.col(w).cast("double")
        for v in scores:
            vd = F.col(v).cast("double")
            aggs += [F.coalesce(F.sum(vd * wd), F.lit(0.0)).alias(f"sum_{v}_{w}"),
                     F.coalesce(F.sum(F.when(wd.isNotNull(), vd)), F.lit(0.0)).alias(f"sum_{v}_at_{w}")]
    return _dated(df, [*keys, *scores, *counts]).groupBy(*keys, "date").agg(*aggs)


def add_sums(sums: DataFrame, keys=()) -> DataFrame:
    """The ``daily_sums`` of all rows behind several tables of them, put together."""
    return sums.groupBy(*keys, "date").agg(*[
        F.sum(c).alias(c) for c in sums.columns if c not in (*keys, "date")])


def daily_of_sums(sums: DataFrame, stats: RobustStats, scores=SCORES,
                  counts=ENGAGEMENT) -> DataFrame:
    """A1 and A3 from ``daily_sums`` and the scaler (see ``weighted_aggs`` for the rules)."""
    def mean(c):
        return F.when(F.col(f"n_{c}") > 0, F.col(f"sum_{c}") / F.col(f"n_{c}"))

    keep = [c for c in sums.columns if not c.startswith(("sum_", "n_"))]
    cols = [mean(v).alias(v) for v in scores]
    cols += [((mean(w) - F.lit(stats.center(w))) / F.lit(stats.scale(w))).alias(w) for w in counts]
    for w in counts:
        med = F.lit(stats.center(w))
        den = F.col(f"sum_{w}") - med * F.col(f"n_{w}")
        for v in scores:
            num = F.col(f"sum_{v}_{w}") - med * F.col(f"sum_{v}_at_{w}")
            cols.append(F.when(den != 0, num / den).otherwise(mean(v))
                        .alias(f"weighted_{SCORE_SHORT.get(v, v)}_{w}"))
    return sums.select(*keep, *cols)


def daily_aggregate(df: DataFrame, keys=(), stats: RobustStats | None = None,
                    scores=SCORES, counts=ENGAGEMENT) -> DataFrame:
    """A1 and A3 together in one hash aggregate (one shuffle for both)."""
    stats = stats or fit_robust(df, counts)
    return daily_of_sums(daily_sums(df, keys, scores, counts), stats, scores, counts)


# ----------------------------------------------------------------- windows
def full_window_mean(c: str, n: int, w: Window) -> Column:
    """Mean over the last ``n`` rows incl. the current one; null unless all n present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(c)).over(frame) == n, F.avg(F.col(c)).over(frame))


def poll_lags(df: DataFrame, targets=("aprobacion", "desaprobacion"),
              names=("approval", "disapproval"), lags=(7, 14), keys=()) -> DataFrame:
    """Lag 7 and 14 rows of each poll target."""
    w = _win(keys)
    return df.withColumns({f"{nm}_lag_{k}d": F.lag(t, k).over(w)
                           for t, nm in zip(targets, names) for k in lags})


def poll_rolling_ffill(df: DataFrame, targets=("aprobacion", "desaprobacion"),
                       names=("approval", "disapproval"), n: int = 7, keys=()) -> DataFrame:
    """Mean of the previous ``n`` rows (all required), then forward fill."""
    w = _win(keys)
    prev = w.rowsBetween(-n, -1)
    tmp = df.withColumns({
        f"{nm}_rolling_{n}d": F.when(F.count(F.col(t)).over(prev) == n, F.avg(F.col(t)).over(prev))
        for t, nm in zip(targets, names)})
    return forward_fill(tmp, [f"{nm}_rolling_{n}d" for nm in names], keys)


def forward_fill(df: DataFrame, cols, keys=()) -> DataFrame:
    """Carry the last non-null value forward along ``date`` within keys."""
    upto = _win(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(F.col(c), ignorenulls=True).over(upto) for c in cols})


def score_lags(df: DataFrame, n: int = 7, scores=SCORES, keys=()) -> DataFrame:
    """Lag 1..n rows of every score (21 columns for n=7)."""
    w = _win(keys)
    return df.withColumns({f"{s}_lag_{k}": F.lag(s, k).over(w)
                           for k in range(1, n + 1) for s in scores})


def rolling_mean(df: DataFrame, col: str, n: int, out: str | None = None, keys=()) -> DataFrame:
    """Mean over the last n rows; null until n non-null values are present."""
    return df.withColumn(out or f"{col}_rolling{n}", full_window_mean(col, n, _win(keys)))


def rolling_sentiment(df: DataFrame, keys=()) -> DataFrame:
    """W4 + W5: negative score rolling 7/3, net sentiment rolling 3/7/14 and change."""
    w = _win(keys)
    net = F.col("score_positive") - F.col("score_negative")
    tmp = df.withColumn("sentiment_net", net)
    return tmp.withColumns({
        "score_negative_rolling7": full_window_mean("score_negative", 7, w),
        "score_negative_rolling3": full_window_mean("score_negative", 3, w),
        "sentiment_net_rolling3": full_window_mean("sentiment_net", 3, w),
        "sentiment_net_rolling7": full_window_mean("sentiment_net", 7, w),
        "sentiment_net_rolling14": full_window_mean("sentiment_net", 14, w),
        "sentiment_net_change": F.col("sentiment_net") - F.lag("sentiment_net", 1).over(w),
    })


def sentiment_net(df: DataFrame, keys=()) -> DataFrame:
    """Net sentiment (positive - negative) and its change from the previous row."""
    w = _win(keys)
    tmp = df.withColumn("sentiment_net", F.col("score_positive") - F.col("score_negative"))
    return tmp.withColumn("sentiment_net_change",
                          F.col("sentiment_net") - F.lag("sentiment_net", 1).over(w))


def negativity_index(features: DataFrame, keys=()) -> DataFrame:
    """A4: mean ``score_negative`` per (keys, day) of a features table."""
    return (_dated(features).groupBy(*keys, "date")
            .agg(F.avg("score_negative").alias("indice_negatividad")))

