"""Daily features: weighted means, poll alignment, windows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulso.operators import daily as D
from pulso.operators.polls import poll_calendar, week_start_join, with_polls
from pulso.operators.scaling import RobustStats, fit_robust, robust_scale

D0 = dt.date(2025, 4, 14)


def _one(df, col):
    return df.first()[col]


def test_weighted_mean(spark):
    assert _weighted_one(spark, [(0.2, 1), (0.5, 2), (0.8, 3)], "v double, w int") == pytest.approx(3.6 / 6)


def test_zero_weights_fall_back_to_mean(spark):
    assert _weighted_one(spark, [(0.2, 0), (0.5, 0), (0.8, 0)], "v double, w int") == pytest.approx(0.5)


def _weighted_one(spark, rows, schema="v double, w double"):
    df = spark.createDataFrame(rows, schema).withColumn("date", F.lit(D0))
    df = df.withColumnsRenamed({"v": "score_positive", "w": "likeCount"})
    stats = RobustStats({"likeCount": 0.0}, {"likeCount": 1.0})
    out = D.weighted_sentiment(df, stats=stats, scores=("score_positive",), weights=("likeCount",))
    return out.first()["weighted_positive_likeCount"]


def test_weighted_null_rules(spark):
    # a null value with a weight still counts in the denominator
    assert _weighted_one(spark, [(1.0, 1.0), (None, 3.0)]) == pytest.approx(0.25)
    # a null weight is skipped
    assert _weighted_one(spark, [(1.0, 1.0), (0.0, None)]) == pytest.approx(1.0)
    # all weights null -> plain mean
    assert _weighted_one(spark, [(1.0, None), (0.0, None)]) == pytest.approx(0.5)
    # all values null with non-zero weights -> 0.0
    assert _weighted_one(spark, [(None, 1.0), (None, 2.0)]) == pytest.approx(0.0)


def test_weighted_uses_centred_weights(spark):
    # median 2 -> centred weights -1, 0, 1 sum to 0 -> plain mean
    df = spark.createDataFrame([(0.2, 1), (0.5, 2), (0.8, 3)], "score_positive double, likeCount long")
    df = df.withColumn("date", F.lit(D0))
    stats = fit_robust(df, ["likeCount"])
    assert stats.center("likeCount") == 2.0 and stats.scale("likeCount") == 1.0
    out = D.weighted_sentiment(df, stats=stats, scores=("score_positive",), weights=("likeCount",))
    assert out.first()["weighted_positive_likeCount"] == pytest.approx(0.5)


def test_robust_scale_constant_column(spark):
    df = spark.createDataFrame([(5,), (5,), (5,)], "x long")
    stats = fit_robust(df, ["x"])
    assert stats.scale("x") == 1.0
    assert [r.x for r in robust_scale(df, stats).collect()] == [0.0, 0.0, 0.0]


def test_weekly_poll_monday_week(spark):
    daily = spark.createDataFrame([(D0, 0.5, 0.2), (D0 + dt.timedelta(1), 0.4, 0.3)],
                                  "date date, score_positive double, score_negative double")
    polls = spark.createDataFrame([(D0 + dt.timedelta(1), 31.0, 60.0)],
                                  "date date, aprobacion double, desaprobacion double")
    out = week_start_join(daily, polls).orderBy("date").collect()
    assert [r.aprobacion for r in out] == [31.0, 31.0]


def test_poll_calendar_sunday_rule(spark):
    sun = dt.date(2024, 1, 7)
    polls = spark.createDataFrame(
        [(sun, 0.3, 0.6), (sun + dt.timedelta(7), 0.4, 0.5), (sun + dt.timedelta(9), 0.9, 0.1)],
        "date date, aprobacion double, desaprobacion double")
    cal = {r.date: r.aprobacion for r in poll_calendar(polls).collect()}
    # calendar runs from the first poll to the last poll + 6 days
    assert min(cal) == sun and max(cal) == sun + dt.timedelta(15)
    assert cal[sun] == 0.3
    assert cal[sun + dt.timedelta(1)] == 0.4          # Monday -> next Sunday's poll
    assert cal[sun + dt.timedelta(7)] == 0.4
    # a poll not dated on a Sunday never matches
    assert all(v != 0.9 for v in cal.values())


def test_two_polls_one_sunday_fan_out(spark):
    sun = dt.date(2024, 1, 7)
    polls = spark.createDataFrame([(sun, 0.3, 0.6), (sun, 0.5, 0.4)],
                                  "date date, aprobacion double, desaprobacion double")
    assert poll_calendar(polls).where(F.col("date") == sun).count() == 2


def _series(spark, vals, start=D0, gaps=()):
    rows, d = [], start
    for i, v in enumerate(vals):
        while d in gaps:
            d += dt.timedelta(1)
        rows.append((d, v, 0.1))
        d += dt.timedelta(1)
    return spark.createDataFrame(rows, "date date, score_negative double, score_positive double")


def test_rolling_needs_full_window(spark):
    df = _series(spark, [0.1, 0.2, None, 0.4, 0.5, 0.6])
    out = D.rolling_mean(df, "score_negative", 3).orderBy("date").collect()
    got = [r.score_negative_rolling3 for r in out]
    assert got[:5] == [None, None, None, None, None]
    assert got[5] == pytest.approx(0.5)


def test_lags_count_rows_not_days(spark):
    gaps = {D0 + dt.timedelta(2)}
    df = _series(spark, [0.1, 0.2, 0.3, 0.4], gaps=gaps)
    out = D.score_lags(df, n=1, scores=("score_negative",)).orderBy("date").collect()
    assert [r.score_negative_lag_1 for r in out] == [None, 0.1, 0.2, 0.3]


def test_poll_rolling_excludes_today_then_ffill(spark):
    vals = [float(i) for i in range(1, 11)]
    rows = [(D0 + dt.timedelta(i), None if i == 8 else v, 0.0) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "date date, aprobacion double, desaprobacion double")
    out = D.poll_rolling_ffill(df, targets=("aprobacion",), names=("approval",)).orderBy("date").collect()
    got = [r.approval_rolling_7d for r in out]
    assert got[:7] == [None] * 7
    assert got[7] == pytest.approx(4.0)          # mean of rows 1..7
    assert got[8] == pytest.approx(5.0)
    assert got[9] == pytest.approx(5.0)          # window has a null -> forward fill


def test_keys_partition_windows(spark):
    rows = [("a", D0, 0.1, 0.0), ("a", D0 + dt.timedelta(1), 0.2, 0.0),
            ("b", D0, 0.9, 0.0), ("b", D0 + dt.timedelta(1), 0.8, 0.0)]
    df = spark.createDataFrame(rows, "author string, date date, score_negative double, score_positive double")
    out = D.sentiment_net(df, keys=("author",)).orderBy("author", "date").collect()
    assert [r.sentiment_net_change for r in out] == [None, pytest.approx(-0.1), None, pytest.approx(0.1)]


def test_daily_features_plan_has_one_aggregate_exchange(spark, sf001):
    from pulso.sources import fixtures as fx
    p = fx.posts(spark, sf001)
    stats = fit_robust(p, D.ENGAGEMENT)
    plan = D.daily_aggregate(p, stats=stats)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_with_polls_left_join_keeps_days(spark):
    daily = _series(spark, [0.1, 0.2, 0.3])
    cal = spark.createDataFrame([(D0, 0.3, 0.6)], "date date, aprobacion double, desaprobacion double")
    out = with_polls(daily, cal).orderBy("date").collect()
    assert [r.aprobacion for r in out] == [0.3, None, None]


def test_quartiles_are_exact_at_any_size(spark, monkeypatch):
    """Against numpy on skewed, negative, constant, fractional and nearly empty columns;
    few buckets force many passes."""
    import numpy as np

    from pulso.operators import scaling as SC
    g = np.random.default_rng(5)
    cols = {"a": g.pareto(1, 3000) * 1e6, "b": g.integers(-3, 4, 3000).astype(float), "c": np.full(3000, 7.0),
            "d": np.where(np.arange(3000) == 17, 2.5, np.nan), "e": g.normal(size=3000), "f": np.full(3000, np.nan)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols.values())],
                               ", ".join(f"{c} double" for c in cols))
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for buckets in (1024, 4):
        monkeypatch.setattr(SC, "BUCKETS", buckets)
        got = SC.order_statistics(df, list(cols), probs)
        for c, v in cols.items():
            v = v[~np.isnan(v)]
            assert got[c] == (pytest.approx(list(np.quantile(v, probs)), rel=1e-12) if len(v) else [None] * 6)
    ids = spark.range(0, 1000).select(F.col("id").cast("double").alias("x"))
    stats = SC.fit_robust(ids, ["x"])
    assert (stats.center("x"), stats.scale("x")) == (499.5, 499.5)
    asked = SC.fit_robust(ids, ["x"], approx=True)
    assert asked.center("x") == pytest.approx(499.5, abs=1.0)


def test_nan_counts_as_missing(spark):
    nan = float("nan")
    rows = [(D0, 0.2, nan, 1.0), (D0, nan, 0.4, nan), (D0, 0.6, 0.4, 3.0)]
    df = spark.createDataFrame(rows, "date date, score_positive double, score_negative double, likeCount double")
    out = D.daily_means(df, scores=("score_positive", "score_negative"), counts=("likeCount",),
                        stats=RobustStats({"likeCount": 0.0}, {"likeCount": 1.0})).first()
    assert (out.score_positive, out.score_negative, out.likeCount) == (
        pytest.approx(0.4), pytest.approx(0.4), pytest.approx(2.0))


def test_scores_alone_fit_no_scaler(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("a pass over the posts that the result does not use")

    from pulso.operators import scaling as SC
    monkeypatch.setattr(SC, "order_statistics", refuse)
    df = spark.createDataFrame([(D0, 0.1, 0.2, 0.7)], "date date, score_positive double, score_negative double, score_neutral double")
    assert D.daily_means(df, counts=()).first().score_neutral == pytest.approx(0.7)


def test_features_carry_the_mean_embedding(spark):
    from pulso.plans.features import daily_features
    day = dt.timedelta(1)
    rows = [(str(i), D0 + day * (i // 2), 0.1, 0.2, 0.7, 1, 1, 1, i, [float(i), 1.0] if i != 3 else None) for i in range(6)]
    posts = spark.createDataFrame(rows, "id string, date date, score_positive double, score_negative double, "
                                  "score_neutral double, retweetCount long, replyCount long, likeCount long, "
                                  "quoteCount long, embedding array<double>")
    polls = spark.createDataFrame([(D0, 0.3, 0.6)], "date date, aprobacion double, desaprobacion double")
    out = {r.date: r.embedding for r in daily_features(posts, polls, embedding="embedding").collect()}
    assert out == {D0: [0.5, 1.0], D0 + day: [2.0, 1.0], D0 + 2 * day: [4.5, 1.0]}


def test_poll_calendar_join_is_broadcast(spark, sf001):
    from pulso.plans.features import daily_features
    from pulso.sources import fixtures as fx
    p = fx.posts(spark, sf001)
    out = daily_features(p, fx.polls(spark, sf001, p))
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
