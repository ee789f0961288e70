"""Driver contract and catalogue checks on the smallest test tables."""

import __spark_entry__ as E

ROWS_ONLY = {"cluster_topics", "predict_targets", "score_sentiment_ml", "train_eval"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert "date" in df.columns and df.count() >= 0


def test_every_query_has_an_oracle_or_is_model_fitting():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    from pulso.plans import catalog

    assert set(catalog.queries()) - set(o) == ROWS_ONLY


def test_catalogue_needs_no_file_of_the_pyspark_install(monkeypatch):
    """The stop words are a resource of the package: every query and oracle is
    there even where the jars cannot be looked up."""
    import glob
    import zipfile

    from pulso.plans import catalog
    from pulso.sources import stopwords

    def refuse(*a, **k):
        raise FileNotFoundError("no look-up inside the PySpark installation")

    monkeypatch.setattr(glob, "glob", refuse)
    monkeypatch.setattr(zipfile, "ZipFile", refuse)
    stopwords.default_list.cache_clear()
    assert len(stopwords.default_list("spanish")) > 300
    assert "de" in stopwords.post_stopwords()
    assert len(catalog.oracle_sql()) >= 72


def test_stream_equals_batch(spark, sf001):
    qs = E.queries()
    s = sorted(map(tuple, qs["stream_upsert_days"](spark, sf001).collect()))
    b = sorted(map(tuple, qs["stream_daily_means"](spark, sf001).collect()))
    assert s == b and len(s) > 0
    ids = qs["stream_dedup"](spark, sf001)
    assert ids.count() == ids.select("id").distinct().count()


def test_stream_upsert_late_data_and_restart(spark, sf001):
    """Late posts of old days and replayed duplicates arrive in a second run on
    the same checkpoint; the day table then equals the batch result, and a
    third run (nothing new) changes nothing."""
    from pyspark.sql import functions as F

    from pulso.operators.daily import SCORES
    from pulso.session import scratch_path
    from pulso.sources import fixtures as fx
    from pulso.streaming import posts as ST

    base = scratch_path(spark, "stream_restart")
    events = fx.table(spark, sf001, "events")
    events.where(F.col("event_id") % 2 == 0).write.parquet(f"{base}/src/a")

    def run():
        src = ST.read_stream(spark, f"{base}/src/*", events.schema)
        q = fx.posts_of_events(src, ts_type="timestamp").select("id", "createdAt", *SCORES)
        ST.run_available_now(q, f"{base}/ckpt",
                             foreach_batch=ST.upsert_days_sink(f"{base}/raw", f"{base}/out"))
        out = spark.read.parquet(f"{base}/out").select("date", *SCORES, "n_posts")
        return sorted((r.date, r.n_posts) + tuple(round(getattr(r, c), 9) for c in SCORES)
                      for r in out.collect())

    first = run()
    events.where(F.col("event_id") % 2 == 1).write.parquet(f"{base}/src/b")      # late rows
    events.where(F.col("event_id") % 4 == 0).write.parquet(f"{base}/src/c")      # replayed rows
    second = run()
    third = run()
    want = ST.daily_aggregate_of(fx.posts(spark, sf001)).collect()
    want = sorted((r.date, r.n_posts) + tuple(round(getattr(r, c), 9) for c in SCORES) for r in want)
    assert first != second
    assert len(second) == len(want), (len(second), len(want))
    bad = [(a, b) for a, b in zip(second, want) if a != b]
    assert not bad, bad[:3]
    assert second == third


def _post(i, day, pos=0.5):
    import datetime as dt
    return (str(i), dt.datetime(2024, 1, day, 10), pos, 0.2, 0.3)


POST = "id string, createdAt timestamp, score_positive double, score_negative double, score_neutral double"


def test_late_posts_are_kept_by_every_stream(spark):
    """A second file brings a post ten days late and a repeated id."""
    from pulso.operators.daily import SCORES
    from pulso.session import scratch_path
    from pulso.streaming import posts as ST

    base = scratch_path(spark, "stream_late")
    first = spark.createDataFrame([_post(1, 20), _post(2, 20, 0.7)], POST)
    late = spark.createDataFrame([_post(3, 10), _post(1, 20, 0.9), _post(4, 20, 0.3)], POST)

    def run(sink, name, make=lambda s: s, mode="append"):
        q = make(ST.read_stream(spark, f"{base}/src/*", first.schema))
        ST.run_available_now(q, f"{base}/ckpt-{name}", foreach_batch=sink, mode=mode)

    for part, df in (("a", first), ("b", late)):
        df.write.parquet(f"{base}/src/{part}")
        run(ST.dedup_sink(f"{base}/ids"), "ids")
        run(ST.window_upsert_sink(f"{base}/windows"), "windows", ST.stream_daily_means, "update")
        run(ST.upsert_days_sink(f"{base}/raw", f"{base}/days"), "days")
    assert sorted(r.id for r in spark.read.parquet(f"{base}/ids").collect()) == ["1", "2", "3", "4"]
    windows = {r.date.day: (r.n_posts, round(r.score_positive, 9)) for r in ST.latest_windows(spark, f"{base}/windows").collect()}
    assert windows == {10: (1, 0.5), 20: (4, round((0.5 + 0.7 + 0.9 + 0.3) / 4, 9))}
    days = {r.date.day: (r.n_posts, round(r.score_positive, 9)) for r in spark.read.parquet(f"{base}/days").select(
        "date", *SCORES, "n_posts").collect()}
    assert days == {10: (1, 0.5), 20: (3, 0.5)}


def test_a_batch_replayed_after_a_crash_still_updates_its_days(spark):
    """The driver dies between the append and the day table; the batch comes again."""
    import pytest

    from pulso.session import scratch_path
    from pulso.streaming import posts as ST

    base = scratch_path(spark, "stream_crash")

    def die(raw):
        raise RuntimeError("driver lost")

    good = ST.upsert_days_sink(f"{base}/raw", f"{base}/days")
    good(spark.createDataFrame([_post(1, 5)], POST), 0)
    batch = spark.createDataFrame([_post(2, 5, 0.9), _post(3, 6)], POST)
    with pytest.raises(RuntimeError):
        ST.upsert_days_sink(f"{base}/raw", f"{base}/days", aggregate=die)(batch, 1)
    good(batch, 1)
    assert spark.read.parquet(f"{base}/raw").count() == 3
    assert {r.date.day: r.n_posts for r in spark.read.parquet(f"{base}/days").collect()} == {5: 2, 6: 1}
