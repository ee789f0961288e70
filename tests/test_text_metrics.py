"""Text cleaning, sentiment, metrics and term counts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulso.functions import text as T
from pulso.functions.dates import parse_created_at
from pulso.functions.sentiment import classify_sentiment, lexicon_sentiment, softmax_label
from pulso.operators import metrics as M
from pulso.operators import terms as TM


def _clean(spark, texts, fn=T.clean_post_text, **kw):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [r.c for r in df.select(fn("text", **kw).alias("c")).collect()]


def test_cleaning_reference_case(spark):
    out = _clean(spark, ["Gabriel Boric miente otra vez en cadena nacional https://noticias.cl"])[0]
    assert out is not None
    assert "http" not in out and "@" not in out and "#" not in out
    assert 3 <= len(out.split()) <= 50


def test_cleaning_mentions_hashtags_unicode(spark):
    out = _clean(spark, ["Hola @José mira #Chile ahora www.x.cl ¡qué día! 🎉 niño"], stop=())[0]
    assert out == "hola mira chile ahora qué día niño"


def test_cleaning_word_bounds(spark):
    words = lambda n: " ".join(f"w{i}" for i in range(n))
    out = _clean(spark, [words(2), words(3), words(50), words(51), None, ""], stop=())
    assert out[0] is None and out[1] == words(3) and out[2] == words(50)
    assert out[3] is None and out[4] is None and out[5] is None


def test_cleaning_drops_stop_words(spark):
    out = _clean(spark, ["el gobierno de la gente y los trabajadores del norte"])[0]
    assert out.split() == ["gobierno", "trabajadores", "norte"]


def test_topic_cleaning_drops_hashtag_and_digits(spark):
    out = _clean(spark, ["reforma #Pensiones 2024 sistema salud publico"], fn=T.clean_topic_text,
                 stop=())[0]
    assert out == "reforma sistema salud publico"


def test_strip_articles(spark):
    df = spark.createDataFrame([("Él dijo que el plan y ÉL, el otro; ELLA no",)], "t string")
    assert df.select(T.strip_articles("t").alias("x")).first().x == "dijo que plan y , otro; ELLA no"


def test_parse_created_at_mixed_formats(spark):
    df = spark.createDataFrame([("2025-04-16T13:05:00",), ("Wed Apr 16 13:05:00 +0000 2025",),
                                ("garbage",), (None,)], "s string")
    got = [r.t for r in df.select(parse_created_at("s").alias("t")).collect()]
    assert got[0] == got[1] == dt.datetime(2025, 4, 16, 13, 5)
    assert got[2] is None and got[3] is None


def test_classify_reference_cases(spark):
    df = spark.createDataFrame([(0.2, 0.7, 0.1), (0.5, 0.5, 0.5), (0.6, 0.2, 0.2)],
                               "score_positive double, score_negative double, score_neutral double")
    got = [r.c for r in df.select(classify_sentiment().alias("c")).collect()]
    assert got == ["negative", "neutral", "positive"]


def test_daily_counts_drop_ties(spark):
    d = dt.date(2025, 4, 15)
    rows = [(d, 0.5, 0.5, 0.1), (d, 0.1, 0.8, 0.1), (d + dt.timedelta(1), 0.3, 0.3, 0.3)]
    df = spark.createDataFrame(rows, "date date, score_positive double, score_negative double, "
                                     "score_neutral double")
    out = {r.date: r for r in M.negative_share(M.daily_class_counts(df)).collect()}
    assert out[d].tweets_negativos == 1 and out[d].total_tweets == 1
    assert out[d].porcentaje_tweets_negativos == 1.0
    tie_day = out[d + dt.timedelta(1)]           # ties only: zeros and a null share
    assert tie_day.total_tweets == 0 and tie_day.porcentaje_tweets_negativos is None
    neutral = {r.date: r for r in M.daily_class_counts(df, ties="neutral").collect()}
    assert neutral[d].tweets_neutros == 1


def test_predictions_with_metrics_idempotent(spark):
    d = dt.date(2025, 4, 15)
    pred = spark.createDataFrame([(d, 0.3, 0.6)], "date date, prediccion_aprobacion double, "
                                                  "prediccion_desaprobacion double")
    met = spark.createDataFrame([(d, 0.4, 1, 2, 3, 6, 1 / 6)],
                                "date date, indice_negatividad double, tweets_negativos long, "
                                "tweets_positivos long, tweets_neutros long, total_tweets long, "
                                "porcentaje_tweets_negativos double")
    once = M.predictions_with_metrics(pred, met)
    twice = M.predictions_with_metrics(once, met)
    assert once.columns == twice.columns
    assert once.collect() == twice.collect()


def test_empty_text_sentiment(spark):
    df = spark.createDataFrame([("",)], "text string")
    r = df.select(softmax_label(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("text")).alias("s")) \
          .select("s.*").first()
    assert r.sentiment_label == "Neutral"
    assert (r.score_label, r.score_negative, r.score_neutral, r.score_positive) == (0.0, 0.0, 0.0, 0.0)


def test_softmax_first_max_wins(spark):
    df = spark.range(1)
    r = df.select(softmax_label(F.array(F.lit(2.0), F.lit(1.0), F.lit(2.0))).alias("s")).select("s.*").first()
    assert r.sentiment_label == "Negative"
    assert r.score_negative + r.score_neutral + r.score_positive == pytest.approx(1.0)


def test_lexicon_sentiment(spark):
    lex = spark.createDataFrame([("bueno", 0.0, 0.0, 2.0), ("malo", 2.0, 0.0, 0.0)],
                                "word string, neg double, neu double, pos double")
    df = spark.createDataFrame([("1", "Muy bueno bueno"), ("2", "malo"), ("3", " ")], "id string, text string")
    out = {r.id: r for r in lexicon_sentiment(df, lex).collect()}
    assert out["1"].sentiment_label == "Positive" and out["2"].sentiment_label == "Negative"
    assert out["3"].sentiment_label == "Neutral" and out["3"].score_label == 0.0


def test_lexicon_sentiment_shared_ids_and_repeated_words(spark):
    """Each row is scored by its own text; a word listed twice counts for both rows; the plan
    is the same for a long lexicon."""
    rows = [("bueno", 0.0, 0.0, 1.0), ("bueno", 0.0, 0.0, 1.0), ("malo", 1.5, 0.0, 0.0)]
    df = spark.createDataFrame([("1", "bueno malo"), ("1", "malo"), (None, "malo"), ("2", None), ("3", "malo")],
                               "id string, text string")
    for more in (0, 2000):
        lex = spark.createDataFrame(rows + [(f"w{i}", 9.0, 0.0, 0.0) for i in range(more)],
                                    "word string, neg double, neu double, pos double")
        got = sorted((r.id or "", r.text or "", r.sentiment_label) for r in lexicon_sentiment(df, lex).collect())
        assert got == [("", "malo", "Negative"), ("1", "bueno malo", "Positive"), ("1", "malo", "Negative"),
                       ("2", "", "Neutral"), ("3", "malo", "Negative")]


def test_urls_end_at_every_space(spark):
    """No-break and other wide spaces end a URL, as in Python: the next word stays."""
    import re
    from pulso.functions.text import clean_post_text, clean_topic_text
    spaces = ["\u00a0", "\u2003", "\u3000", "\u2028", "\x0b", "\x85", " "]
    rows = [(f"antes hoy www.sitio.cl/a?b=1{s}despues mucho http://x.cl{s}final ayer",) for s in spaces]
    df = spark.createDataFrame(rows, "text string")
    for clean in (clean_post_text, clean_topic_text):
        for (text,), r in zip(rows, df.select("text", clean("text", stop=()).alias("c")).collect()):
            assert r.c.split() == re.sub(r"http\S+|www\S+", "", text).split()


def test_daily_terms_reference_case(spark):
    ts = dt.datetime(2025, 4, 15, 10)
    text = "boric presidente boric economía chile cambio futuro boric chile"
    df = spark.createDataFrame([(ts, text)] * 3, "createdAt timestamp, text string")
    out = {r.term: r["count"] for r in TM.daily_top_terms(df).collect()}
    assert out == {"economía": 3, "cambio": 3, "futuro": 3}


def test_daily_terms_phrases_first_and_top_n(spark):
    ts = dt.datetime(2025, 4, 15, 10)
    df = spark.createDataFrame([(ts, "gabriel boric habla"), (ts, "habla mucho x")],
                               "createdAt timestamp, text string")
    out = TM.daily_top_terms(df, n=1).collect()
    assert [(r.term, r["count"], r.weight) for r in out] == [("habla", 2, 1.0)]


def test_daily_bigrams(spark):
    ts = dt.datetime(2025, 4, 15, 10)
    df = spark.createDataFrame([(ts, "alza precios luz"), (ts, "alza precios pan")],
                               "createdAt timestamp, text string")
    out = {r.bigram: r["count"] for r in TM.daily_top_bigrams(df, min_count=2).collect()}
    assert out == {"alza precios": 2}


def test_cleaning_stays_in_jvm(spark):
    df = spark.createDataFrame([("hola mundo otra vez",)], "text string")
    plan = TM.clean_posts(df)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_external_model_plugin_matches_native(spark):
    from pulso.operators.plugin import external_sentiment, lexicon_model
    rows = [("bueno", 0.0, 0.0, 2.0), ("malo", 2.0, 0.0, 0.0)]
    lex = spark.createDataFrame(rows, "word string, neg double, neu double, pos double")
    df = spark.createDataFrame([("1", "Muy bueno bueno"), ("2", "malo"), ("3", " "), ("4", None)],
                               "id string, text string")
    native = {r.id: tuple(r)[2:] for r in lexicon_sentiment(df, lex).collect()}
    plug = {r.id: tuple(r)[2:] for r in external_sentiment(df, lexicon_model(rows)).collect()}
    assert plug == native
    wide = df.withColumn("likeCount", F.lit(7)).withColumn("tags", F.array(F.lit("a")))
    out = external_sentiment(wide, lexicon_model(rows))
    assert out.columns[:4] == ["id", "text", "likeCount", "tags"]
    assert {(r.likeCount, tuple(r.tags)) for r in out.collect()} == {(7, ("a",))}
