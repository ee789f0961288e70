"""Stored state: incremental features, mergeable quartiles, versioned tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulso.operators import scaling as SC
from pulso.operators.daily import ENGAGEMENT
from pulso.plans.feature_store import FeatureStore
from pulso.plans.features import daily_features
from pulso.session import scratch_path
from pulso.sources import fixtures as fx
from pulso.sources import versioned as V


def same(a, b, keys):
    """Equal tables up to the last bits of sums in another order."""
    assert a.columns == b.columns
    left, right = (sorted((tuple(r) for r in d.collect()), key=lambda r: tuple(map(str, r[:len(keys) + 1])))
                   for d in (a, b))
    assert len(left) == len(right) > 0
    for x, y in zip(left, right):
        for c, u, v in zip(a.columns, x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-9), (c, x[:2], u, v)
            else:
                assert u == v, (c, x[:2], u, v)


def batches(spark, sf001):
    p = fx.posts(spark, sf001).cache()
    late = F.col("id").cast("long") % 7 == 0
    old = F.dayofmonth("date") <= 12
    return p, [p.where(old & ~late), p.where(~old & ~late), p.where(late)]


@pytest.mark.parametrize("keys", [(), ("author",)])
def test_store_equals_rebuild_after_each_run(spark, sf001, keys):
    p, parts = batches(spark, sf001)
    polls = fx.polls(spark, sf001, p)
    store = FeatureStore(spark, scratch_path(spark, "store"), keys)
    seen = None
    for n, part in enumerate(parts, 1):
        assert store.append(part, n)
        seen = part if seen is None else seen.unionByName(part)
        got = store.features(polls)
        same(got, daily_features(seen, polls, keys).select(*got.columns), keys)
    assert not store.append(parts[1], 2)                    # replay: nothing happens
    with pytest.raises(ValueError):
        store.append(parts[1], 0)
    assert store.compact() == 4
    got = store.features(polls)
    same(got, daily_features(p, polls, keys).select(*got.columns), keys)


def test_replaced_days_and_a_run_that_died(spark, sf001):
    p, parts = batches(spark, sf001)
    polls = fx.polls(spark, sf001, p)
    day = F.dayofmonth("date") == 5
    store = FeatureStore(spark, scratch_path(spark, "store"))
    store.append(p.where(~day).unionByName(p.where(day).withColumn("likeCount", F.lit(10 ** 6).cast("long"))), 1)
    # a run that wrote its folders and died before the commit is not seen ...
    p.limit(5).transform(lambda d: SC.value_counts(d, ENGAGEMENT, by=("date",))).select(
        "*", F.lit(False).alias("whole")).write.parquet(f"{store.path}/counts/batch=2")
    assert store.batches() == [1]
    # ... and is written again under its number
    store.append(p.where(day), 2, replace_days=True)
    same(store.features(polls), daily_features(p, polls).select(*store.features(polls).columns), ())


def test_a_run_reads_no_old_posts(spark, sf001, tmp_path):
    p, _ = batches(spark, sf001)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    cut = F.dayofmonth("date") <= 12
    p.where(cut).write.parquet(old)
    p.where(~cut).write.parquet(new)
    store = FeatureStore(spark, scratch_path(spark, "store"))
    store.append(spark.read.parquet(old), 1)
    store.append(spark.read.parquet(new), 2)
    files = store.features(fx.polls(spark, sf001, p)).inputFiles()
    assert not [f for f in files if old in f or new in f]
    assert [f for f in files if "/sums/batch=" in f]


def test_quartiles_of_merged_counts_are_exact(spark):
    g = np.random.default_rng(5)
    rows = [(f"2024-01-{1 + int(d):02d}", int(a), float(b) if k % 9 else None)
            for k, (d, a, b) in enumerate(zip(g.integers(0, 9, 900), g.zipf(1.3, 900) % 10 ** 9, g.normal(0, 1e6, 900)))]
    df = spark.createDataFrame(rows, "date string, a long, b double")
    parts = [df.where(F.col("a") % 2 == k) for k in (0, 1)]
    state = SC.merge_value_counts(*[SC.value_counts(x, ["a", "b"], by=("date",)) for x in parts], by=("date",))
    # a day is replaced
    fresh = SC.value_counts(df.where("date = '2024-01-03'").withColumn("a", F.col("a") + 5), ["a", "b"], by=("date",))
    state = state.where("date <> '2024-01-03'").unionByName(fresh)
    got = SC.fit_robust_counts(SC.merge_value_counts(state), ["a", "b", "none"])
    want = {"a": [x + 5 if d == "2024-01-03" else x for d, x, _ in rows], "b": [x for *_, x in rows if x is not None]}
    for c, x in want.items():
        q = np.quantile(np.array(x, float), [0.25, 0.5, 0.75])
        assert got.median[c] == q[1] and got.iqr[c] == q[2] - q[0]
    assert (got.median["none"], got.iqr["none"]) == (0.0, 1.0)


def test_a_table_is_replaced_while_it_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).withColumn("x", F.lit(1))
    with pytest.raises(FileNotFoundError):
        V.read_current(spark, path)
    assert V.read_current(spark, path, df.schema).count() == 0
    assert V.replace_table(df, path) == 1
    reader = V.read_current(spark, path)
    assert V.replace_table(reader.where("id < 50").withColumn("x", F.col("x") + 1), path) == 2
    assert reader.agg(F.sum("x"), F.count("*")).first()[:] == (100, 100)
    now = V.read_current(spark, path)
    assert now.agg(F.sum("x"), F.count("*")).first()[:] == (100, 50)
    assert V.read_current(spark, path, version=1).count() == 100


def test_a_writer_that_dies_before_the_swap_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    V.replace_table(spark.range(10), path)
    left = V.write_data(spark.range(999), path)             # written, not committed
    assert V.read_current(spark, path).count() == 10 and V.current_version(spark, path) == 1
    (tmp_path / "t" / V.COMMITS / "0000000002").write_text("data-ha")   # a marker cut short
    assert V.current_version(spark, path) == 1
    (tmp_path / "t" / V.COMMITS / "0000000002").unlink()
    assert V.vacuum(spark, path) == []                      # the folder may belong to a running job
    assert V.vacuum(spark, path, orphan_seconds=-5) == [left]
    assert V.read_current(spark, path).count() == 10


def test_two_writers_cannot_both_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    V.replace_table(spark.range(1), path)
    V.replace_table(spark.range(2), path, base=1)
    with pytest.raises(V.CommitConflict):
        V.replace_table(spark.range(3), path, base=1)
    assert V.read_current(spark, path).count() == 2
    V.replace_table(spark.range(4), path)
    assert len(V.vacuum(spark, path, keep=1)) == 2
    assert V.read_current(spark, path).count() == 4 and V.current_version(spark, path) == 3


def test_quality_is_measured_while_a_stage_is_written(spark, tmp_path):
    from pulso.operators.state import stage_quality
    from pulso.sources.tables import quality_table, write_observed
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01"), (3, None), (4, "2024-01-02")], "id long, d string")
    df = df.select("id", F.to_date("d").alias("date"))
    got = [write_observed(x, str(tmp_path / name), name) for name, x in (("all", df), ("none", df.where("false")))]
    want = stage_quality(df, "all").unionByName(stage_quality(df.where("false"), "none"))
    assert sorted(quality_table(spark, got).collect()) == sorted(want.collect())
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4


def test_models_can_be_applied_after_metrics_were_observed(spark, tmp_path):
    from pulso.operators.scorer import fit_text_classifier, score_text
    from pulso.operators.topics import cluster_topics
    from pulso.sources.tables import write_observed
    df = spark.createDataFrame([(i, "bueno lindo" if i % 2 else "malo feo", float(i % 2), [float(i % 3), 1.0])
                                for i in range(30)], "id long, text string, label double, embedding array<double>")
    write_observed(df.withColumn("date", F.lit(None).cast("date")), str(tmp_path / "seen"), "seen")
    assert score_text(df, fit_text_classifier(df)).count() == 30
    assert len(score_text(df, fit_text_classifier(df)).collect()) == 30
    assert len(cluster_topics(df, k=2).collect()) == 30
