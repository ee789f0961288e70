"""Daily negativity metrics (A4-A6, F7, J5, J6; pipeline P3).

Class counts are one hash aggregate with a conditional count per fixed
class (the pivot values are known, so every class column always exists and
no pivot pre-pass is needed). The aggregate is partial on the map side, so
a day holding a third of all posts is a few numbers per task before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import classify_sentiment
from ..sources.tables import require_columns
from .daily import SCORES, negativity_index

# Output names of the class counts and metric columns.
CLASS_COLUMNS = (("negative", "tweets_negativos"), ("positive", "tweets_positivos"),
                 ("neutral", "tweets_neutros"))
METRIC_COLUMNS = ("indice_negatividad", "tweets_negativos", "tweets_positivos",
                  "tweets_neutros", "total_tweets", "porcentaje_tweets_negativos")


def daily_class_counts(scored: DataFrame, ties: str = "drop", keys=(),
                       date_col: str = "date") -> DataFrame:
    """A5 + F7: posts per class per (keys, day).

    Rows with a null score are dropped first, and rows without a day are left
    out (null group). ``ties="drop"`` (the metrics job) counts a shared
    maximum in no class, so a day with ties only keeps zeros;
    ``ties="neutral"`` counts it as neutral (the tested classifier).
    """
    require_columns(scored, [date_col, *SCORES, *keys])
    base = scored.where(F.col(date_col).isNotNull() & F.col(SCORES[0]).isNotNull()
                        & F.col(SCORES[1]).isNotNull() & F.col(SCORES[2]).isNotNull())
    cls = classify_sentiment(ties="neutral" if ties == "neutral" else "drop")
    return (base.withColumn("_cls", cls)
            .groupBy(*keys, F.col(date_col).alias("date"))
            .agg(*[F.count_if(F.col("_cls") == c).alias(out) for c, out in CLASS_COLUMNS]))


def negative_share(counts: DataFrame) -> DataFrame:
    """total = negative + positive + neutral; share = negative / total,
    null when the total is 0."""
    total = F.col("tweets_negativos") + F.col("tweets_positivos") + F.col("tweets_neutros")
    return (counts.withColumn("total_tweets", total)
            .withColumn("porcentaje_tweets_negativos",
                        F.try_divide(F.col("tweets_negativos").cast("double"),
                                     F.col("total_tweets").cast("double"))))


def daily_metrics(features: DataFrame, scored: DataFrame, ties: str = "drop",
                  keys=()) -> DataFrame:
    """J5 (P3 core): negativity index of the feature table full-outer-joined
    with the class counts and negative share of the scored posts, by day.

    Both sides are one row per (keys, day), so the join is small; USING
    coalesces the key columns.
    """
    neg = negativity_index(features, keys=keys)
    counts = negative_share(daily_class_counts(scored, ties=ties, keys=keys))
    return neg.join(counts, [*keys, "date"], "full").select(*keys, "date", *METRIC_COLUMNS)


def predictions_with_metrics(pred: DataFrame, metrics: DataFrame, keys=()) -> DataFrame:
    """Predictions left-joined to the metrics by day. Metric columns
    already on the predictions are dropped first, so a re-run replaces them
    instead of duplicating them."""
    stale = [c for c in METRIC_COLUMNS if c in pred.columns]
    m = metrics.select(*keys, "date", *[c for c in METRIC_COLUMNS if c in metrics.columns])
    return pred.drop(*stale).join(m, [*keys, "date"], "left")
