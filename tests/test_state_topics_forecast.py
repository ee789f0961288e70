"""Incremental state, harvests, vectors, topics, forecast, table I/O."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulso.operators import forecast as FC
from pulso.operators import replies as RP
from pulso.operators import state as ST
from pulso.operators import topics as TP
from pulso.operators import vectors as V
from pulso.session import scratch_path
from pulso.sources import tables as TB

TODAY = dt.date(2025, 4, 16)


def _days(df):
    return sorted(r.date for r in df.collect())


def test_nothing_pending(spark):
    posts = spark.createDataFrame([("1", TODAY - dt.timedelta(1)), ("2", TODAY)], "id string, date date")
    assert _days(ST.pending_days(posts, TODAY)) == []


def test_first_run_pending_last_three_days(spark):
    empty = TB.empty(spark, "id string, date date")
    assert _days(ST.pending_days(empty, TODAY)) == [TODAY - dt.timedelta(2), TODAY - dt.timedelta(1), TODAY]


def test_pending_after_last_day(spark):
    posts = spark.createDataFrame([("1", TODAY - dt.timedelta(3))], "id string, date date")
    assert _days(ST.pending_days(posts, TODAY)) == [TODAY - dt.timedelta(2), TODAY - dt.timedelta(1), TODAY]


def test_append_dedup_existing_wins_and_is_idempotent(spark):
    ex = spark.createDataFrame([("1", 10), ("2", 20)], "id string, likes long")
    new = spark.createDataFrame([("2", 99), ("3", 30)], "id string, likes long")
    once = ST.append_dedup(ex, new)
    twice = ST.append_dedup(once, new)
    got = sorted((r.id, r.likes) for r in once.collect())
    assert got == [("1", 10), ("2", 20), ("3", 30)]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert ST.append_dedup(None, new).count() == 2


def test_append_dedup_is_unique_from_the_first_write(spark):
    schema = "id string, v string"
    first = ST.append_dedup(None, spark.createDataFrame([("1", "a"), ("1", "b"), (None, "x"), (None, "y")], schema))
    assert sorted(map(str, map(tuple, first.collect()))) == ["('1', 'a')", "(None, 'x')"]
    then = ST.append_dedup(first, spark.createDataFrame([("1", "c"), ("2", "d"), (None, "z")], schema))
    assert sorted(((r.id or ""), r.v) for r in then.collect()) == [("", "x"), ("1", "a"), ("2", "d")]


def test_mark_dropped(spark):
    raw = spark.createDataFrame([("1", False), ("2", False), ("3", True), ("4", None)], "id string, processed boolean")
    done = raw.where("id = '1'")
    flags = lambda df: {r.id: r.processed for r in df.collect()}
    assert flags(ST.mark_processed(raw, done)) == {"1": True, "2": False, "3": True, "4": None}
    assert flags(ST.mark_processed(raw, done, mark_dropped=True)) == {"1": True, "2": True, "3": True, "4": None}


def test_append_dedup_int_and_string_ids_after_cast(spark):
    ex = spark.createDataFrame([(1, 10)], "id long, likes long").withColumn("id", F.col("id").cast("string"))
    new = spark.createDataFrame([("1", 99)], "id string, likes long")
    assert ST.append_dedup(ex, new).count() == 1


def test_replace_days_idempotent(spark):
    d = dt.date(2025, 4, 1)
    ex = spark.createDataFrame([(d, 1.0), (d + dt.timedelta(1), 2.0)], "date date, v double")
    fresh = spark.createDataFrame([(d + dt.timedelta(1), 5.0), (d + dt.timedelta(2), 6.0)], "date date, v double")
    once = ST.replace_days(ex, fresh)
    twice = ST.replace_days(once, fresh)
    want = [(d, 1.0), (d + dt.timedelta(1), 5.0), (d + dt.timedelta(2), 6.0)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))


def test_missing_days(spark):
    d = dt.date(2025, 4, 1)
    done = spark.createDataFrame([(d,), (d + dt.timedelta(2),)], "date date")
    assert _days(ST.missing_days(spark, d, d + dt.timedelta(3), done)) == [d + dt.timedelta(1), d + dt.timedelta(3)]


def test_month_windows(spark):
    w = ST.month_windows(spark, "2024-01-31", "2024-04-15").orderBy("window_start").collect()
    assert [(r.window_start.isoformat(), r.window_end.isoformat()) for r in w] == [
        ("2024-01-31", "2024-02-29"), ("2024-02-29", "2024-03-31"), ("2024-03-31", "2024-04-15")]
    with pytest.raises(ValueError):
        ST.month_windows(spark, "2024-02-01", "2024-02-01")


def test_processed_flags(spark):
    raw = spark.createDataFrame([("1", False), ("2", None), ("3", True)], "id string, processed boolean")
    assert sorted(r.id for r in ST.unprocessed(raw).collect()) == ["1"]
    done = spark.createDataFrame([("1",)], "id string")
    got = {r.id: r.processed for r in ST.mark_processed(raw, done).collect()}
    assert got == {"1": True, "2": None, "3": True}
    assert {r.processed for r in ST.reset_processed(raw).collect()} == {False}


def test_harvest_author_windows_newest_n(spark):
    rows = [(str(i), "a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(60)]
    posts = spark.createDataFrame(rows, "id string, author string, createdAt timestamp")
    out = RP.harvest_author_windows(posts, "2024-01-05", "2024-02-20", n=3)
    got = {}
    for r in out.collect():
        got.setdefault(r.window_start.isoformat(), []).append(r.createdAt.date().isoformat())
    assert sorted(got) == ["2024-01-05", "2024-02-05"]
    assert sorted(got["2024-01-05"]) == ["2024-02-02", "2024-02-03", "2024-02-04"]
    assert sorted(got["2024-02-05"]) == ["2024-02-17", "2024-02-18", "2024-02-19"]


def test_reply_enrichment_and_latest(spark):
    t0 = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame(
        [("p", 1, 0, "root", t0), ("r1", 1, 1, "a", t0 + dt.timedelta(minutes=1)),
         ("r2", 1, 2, "b", t0 + dt.timedelta(minutes=2)), ("r3", 2, 1, "c", t0)],
        "id string, conv_id long, turn long, text string, createdAt timestamp")
    out = {r.id: r for r in RP.reply_enrichment(c.where("turn > 0"), c.where("turn = 0")).collect()}
    assert out["r1"].parent_tweet_id == "p" and out["r1"].parent_text == "root"
    assert out["r3"].parent_tweet_id is None
    latest = RP.latest_replies(c.where("turn > 0"), n=1).collect()
    assert sorted(r.id for r in latest) == ["r2", "r3"]


def test_embedding_length_and_zero_vector(spark):
    table = spark.createDataFrame([(i, [float(i)] * 8) for i in range(4)], "vec_id long, embedding array<double>")
    df = spark.createDataFrame([("1", "hola mundo"), ("2", None)], "id string, text string")
    out = {r.id: r.embedding for r in V.embed_posts_hashed(df, table, 8).collect()}
    assert len(out["1"]) == 8 and out["2"] == [0.0] * 8
    tv = V.hashed_token_vectors(spark.createDataFrame([("hola",), ("mundo",)], "token string"), table)
    out2 = {r.id: r.embedding for r in V.embed_posts(df, tv, 8).collect()}
    assert out2["1"] == pytest.approx(out["1"])


def test_seed_topics_null_text_and_shared_ids(spark):
    """One plan whatever the number of seeds: a row in, a row out."""
    docs = spark.createDataFrame(
        [("1", "afp"), ("1", "salud"), ("2", None), ("3", ""), ("4", "afp"), (None, "salud salud afp")],
        "id string, clean_text string")
    seeds = [(0, "afp"), (1, "salud")]
    for more in (0, 300):
        sd = spark.createDataFrame(seeds + [(i + 2, f"nada{i}") for i in range(more)], "seed_id int, keyword string")
        got = sorted(((r.id or ""), r.topic) for r in TP.seed_topics(docs, sd, min_size=1).collect())
        assert got == [("", 1), ("1", 0), ("1", 1), ("2", -1), ("3", -1), ("4", 0)]


def test_seed_topics_ties_and_min_size(spark):
    seeds = TP.clean_seeds(spark.createDataFrame(
        [(0, "AFP"), (1, "reforma de pensiones"), (1, "afp"), (2, "salud")], "seed_id int, keyword string"),
        stop=("de",))
    docs = spark.createDataFrame(
        [("1", "c", "afp reforma pensiones"), ("2", "c", "afp salud"), ("3", "c", "nada aqui"),
         ("4", "d", "salud salud afp")], "id string, candidate string, clean_text string")
    got = {r.id: r.topic for r in TP.seed_topics(docs, seeds, min_size=1, keep=("candidate",)).collect()}
    assert got == {"1": 1, "2": 0, "3": -1, "4": 2}
    got2 = {r.id: r.topic for r in TP.seed_topics(docs, seeds, min_size=2, keep=("candidate",)).collect()}
    assert got2 == {"1": -1, "2": -1, "3": -1, "4": -1}


def test_topic_share_sums_to_100(spark):
    labelled = spark.createDataFrame(
        [("a", "x"), ("a", "x"), ("a", "Otros"), ("b", "y")], "candidate string, label string")
    share = TP.topic_share(labelled)
    sums = {r.candidate: r.s for r in share.groupBy("candidate").agg(F.sum("share").alias("s")).collect()}
    assert sums["a"] == pytest.approx(100.0) and sums["b"] == pytest.approx(100.0)
    labels = spark.createDataFrame([(0, "x"), (1, "y"), (-1, "Otros")], "topic_id int, label string")
    with pytest.raises(ValueError, match="not listed"):
        TP.topic_matrix(share, labels, ["a"])
    m = {r.label: r for r in TP.topic_matrix(share, labels).collect()}
    assert set(m) == {"x", "y"} and m["y"].a == 0.0 and m["y"].b == pytest.approx(100.0)
    norm = {(r.candidate, r.label): r.share_norm for r in TP.topic_profile_norm(share).collect()}
    assert norm[("a", "x")] == pytest.approx(1.0)


def test_centroid_topics(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 1), (3, [-1.0, -1.0], 0)],
                               "vec_id long, embedding array<double>, label int")
    cents = TP.fit_centroids(df)
    got = {r.vec_id: r.topic for r in TP.centroid_topics(df, cents, threshold=0.8).collect()}
    assert got[2] == 1 and got[3] == -1


def test_centroid_blocks_equal_one_matrix(spark, monkeypatch):
    rows = [(i, [float(i % 5 - 2), float(i % 3 - 1)], i % 4) for i in range(30)] + [(99, None, 0), (98, [0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cents = spark.createDataFrame([(t, [float(t), 1.0 - t]) for t in range(-3, 4)], "topic_id int, centroid array<double>")

    def run():
        return sorted((r.vec_id, r.topic, round(r.similarity, 9)) for r in TP.centroid_topics(df, cents, 0.3).collect())
    whole = run()
    monkeypatch.setattr(TP, "BLOCK_NUMBERS", 4)             # two centroids a block
    assert run() == whole
    assert (98, -1, -2.0) in whole and (99, -1, -2.0) in whole


def _feature_frame(spark, n=40, with_nulls=False):
    rows = []
    for i in range(n):
        f1 = None if with_nulls and i % 5 == 0 else float(i)
        rows.append((dt.date(2025, 1, 1) + dt.timedelta(i), f1, float(i % 7), 0.2 + 0.01 * i))
    return spark.createDataFrame(rows, "date date, feat1 double, feat2 double, aprobacion_boric double")


def test_temporal_split(spark):
    df = _feature_frame(spark, 10)
    got = [r.in_sample for r in FC.temporal_split(df).orderBy("date").collect()]
    assert got == [True] * 8 + [False] * 2


def test_train_predict_complete_rows_only(spark):
    df = _feature_frame(spark, 40, with_nulls=True)
    bundle, metrics = FC.train(df, ["feat1", "feat2"], "aprobacion_boric", max_iter=20)
    m = metrics.first()
    assert m.n > 0 and m.mae is not None
    pred = FC.predict_target(df, bundle, "prediccion_aprobacion")
    complete = {r.date for r in df.na.drop(subset=["feat1", "feat2"]).collect()}
    got = {r.date for r in pred.collect()}
    assert got and got <= complete
    path = scratch_path(spark, "bundle")
    bundle.save(path)
    again = FC.Bundle.load(path)
    p2 = FC.predict_target(df, again, "prediccion_aprobacion")
    assert sorted(map(tuple, p2.collect())) == sorted(map(tuple, pred.collect()))


def test_robust_scaler_option(spark):
    df = _feature_frame(spark, 40)
    bundle, m = FC.train(df, ["feat1", "feat2"], "aprobacion_boric", scaler="robust", max_iter=5)
    assert bundle.scale_x.lo["feat1"] == 15.5 and m.first().mae is not None    # median of rows 0..31
    assert FC.predict_target(df, bundle, "p").count() == 40


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 3.0)], "y double, p double")
    m = FC.regression_metrics(df, "y", "p").first()
    assert m.mae == pytest.approx(1 / 3) and m.r2 == pytest.approx(1 - 1 / 2)


def test_csv_roundtrip_and_missing_table(spark):
    df = spark.createDataFrame([("1", dt.datetime(2024, 1, 1, 12, 0, 0, 123456), dt.date(2024, 1, 1))],
                               "id string, createdAt timestamp_ntz, date date")
    path = scratch_path(spark, "t")
    TB.write_table(df, path, fmt="csv")
    back = TB.read_table(spark, path, df.schema, fmt="csv", date_cols=("date",))
    assert back.collect() == df.collect()
    with pytest.raises(FileNotFoundError):
        TB.read_table(spark, path + "-absent", df.schema)
    assert TB.read_table(spark, path + "-absent", df.schema, missing_ok=True).count() == 0


def test_preprocess_flags_only_survivors(spark):
    from pulso.plans.preprocess import STAGES, hashed_embedder, lexicon_scorer, preprocess
    raw = spark.createDataFrame(
        [("1", "buen dia para todos los vecinos", False), ("2", "corto", False),
         ("3", "ya procesado antes hoy mismo", True)], "id string, text string, processed boolean")
    lex = spark.createDataFrame([("buen", 0.0, 0.0, 1.0)], "word string, neg double, neu double, pos double")
    vecs = spark.createDataFrame([(i, [float(i)] * 4) for i in range(3)], "vec_id long, embedding array<double>")
    out = scratch_path(spark, "p1")
    res = preprocess(raw, lexicon_scorer(lex), hashed_embedder(vecs, 4), out=out)
    assert all(TB.path_exists(spark, f"{out}/{s}") for s in STAGES)
    new = {r.id: r for r in res.new_rows.collect()}
    assert set(new) == {"1"} and new["1"].sentiment_label == "Positive" and len(new["1"].embedding) == 4
    flags = {r.id: r.processed for r in res.raw.collect()}
    assert flags == {"1": True, "2": False, "3": True}     # "2" was dropped by cleaning: retried later


def test_any_scorer_fits_the_pipeline(spark):
    from pulso.operators.plugin import external_sentiment, lexicon_model
    from pulso.operators.scorer import fit_text_classifier, ml_sentiment
    from pulso.plans.preprocess import hashed_embedder, preprocess
    texts = ["muy buen dia vecinos todos", "terrible pesima mala jornada", "jornada normal calle centro"]
    raw = spark.createDataFrame([(str(i), texts[i % 3], False) for i in range(12)], "id string, text string, processed boolean")
    vecs = spark.createDataFrame([(i, [float(i)] * 2) for i in range(3)], "vec_id long, embedding array<double>")
    train = spark.createDataFrame([(t, float(k)) for k, t in ((2, texts[0]), (0, texts[1]), (1, texts[2]))] * 5,
                                  "text string, label double")
    model = fit_text_classifier(train)
    for scorer in (lambda df: ml_sentiment(df, model),
                   lambda df: external_sentiment(df, lexicon_model([("buen", 0.0, 0.0, 3.0), ("terrible", 3.0, 0.0, 0.0),
                                                                    ("normal", 0.0, 3.0, 0.0)]))):
        rows = preprocess(raw, scorer, hashed_embedder(vecs, 2)).new_rows.collect()
        assert {(int(r.id) % 3, r.sentiment_label) for r in rows} == {(0, "Positive"), (1, "Negative"), (2, "Neutral")}
        for r in rows:
            assert r.score_negative + r.score_neutral + r.score_positive == pytest.approx(1.0)
            assert r.score_label == pytest.approx(max(r.score_negative, r.score_neutral, r.score_positive))
    blank = ml_sentiment(spark.createDataFrame([(" ",), (None,)], "text string"), model).collect()
    assert [(r.sentiment_label, r.score_label) for r in blank] == [("Neutral", 0.0)] * 2


def test_range_check_and_required_columns(spark):
    from pulso.operators import daily as D
    from pulso.operators.kpi import date_range
    df = spark.createDataFrame([(dt.date(2024, 1, 2),)], "date date")
    with pytest.raises(ValueError):
        date_range(df, "2024-02-01", "2024-01-01")
    assert date_range(df, "2024-01-01", "2024-01-31", floor="2024-01-02").count() == 1
    with pytest.raises(ValueError, match="missing columns"):
        D.daily_means(df, stats=None)


def test_kpi_calendar_day_and_report_numbers(spark):
    from pulso.operators import kpi as K
    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(d, 0.30), (d + dt.timedelta(1), 0.35), (d + dt.timedelta(3), 0.20)],
                               "date date, v double")
    got = {r.date: r.v_delta for r in K.kpi_prev_calendar_day(df, ["v"]).collect()}
    assert got[d] is None and got[d + dt.timedelta(1)] == pytest.approx(0.05)
    assert got[d + dt.timedelta(3)] is None                # previous calendar day missing
    r = K.kpi_latest(df, ["v", "absent"]).first()
    assert r.date == d + dt.timedelta(3) and r.previous_date == d + dt.timedelta(1)
    assert r.v_value_pct == pytest.approx(20.0) and r.v_delta_pp == pytest.approx(-15.0)
    assert r.v_direction == "down" and r.v_bar_pct == pytest.approx(20.0)
    assert r.absent_value_pct == 0.0                        # missing column counts as 0
    one = K.kpi_latest(df.limit(1), ["v"]).first()
    assert one.v_delta_pp is None and one.v_direction is None


def test_comparison_series_long_form(spark):
    from pulso.operators import kpi as K
    d = dt.date(2024, 1, 10)
    pred = spark.createDataFrame([(d, 0.3, 0.6)], "date date, prediccion_aprobacion double, "
                                                  "prediccion_desaprobacion double")
    polls = spark.createDataFrame([(d, 0.31, 0.59), (d - dt.timedelta(30), 0.2, 0.7)],
                                  "date date, aprobacion double, desaprobacion double")
    out = K.comparison_series(pred, polls, d - dt.timedelta(5), d, series=("prediccion_aprobacion", "aprobacion"))
    assert sorted((r.serie, r.valor) for r in out.collect()) == [("aprobacion", 0.31), ("prediccion_aprobacion", 0.3)]


def test_harvest_mentions_top_k_per_day(spark):
    t0 = dt.datetime(2024, 1, 1, 10)
    rows = [("1", "Viva Boric hoy", "es", t0, 5), ("2", "boricua no cuenta", "es", t0, 9),
            ("3", "presidente BORIC habla", "es", t0, 7), ("4", "Boric in english", "en", t0, 99),
            ("5", "otra vez boric", "es", t0 + dt.timedelta(days=1), 1)]
    df = spark.createDataFrame(rows, "id string, text string, lang string, createdAt timestamp, likeCount long")
    out = RP.harvest_mentions(df, ["boric", "presidente boric"], lang="es", k=1)
    assert sorted(r.id for r in out.collect()) == ["3", "5"]


def test_stage_quality(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (None,), (dt.date(2024, 1, 1),)], "date date")
    r = ST.stage_quality(df, "raw").first()
    assert (r.stage, r.n_rows, r.n_days, r.n_null_days) == ("raw", 3, 1, 1)
