"""What the text operators send, write and read again: in proportion to their input."""

import os

import pytest
from pyspark.sql import functions as F

from pulso.operators import scorer, state, terms as TM, vectors as V
from pulso.operators.lemmas import apply_lemma_table
from pulso.plans.preprocess import STAGES, hashed_embedder, lexicon_scorer, preprocess
from pulso.sources import fixtures as fx


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_are_sent_once_for_a_chunk_of_posts(spark, monkeypatch):
    """Before, each token of each text was sent with its vector."""
    table = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [3.0, None]), (1, [5.0, None]), (2, None), (None, [9.0, 9.0])],
        "vec_id long, embedding array<double>")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, None]), ("b", [5.0, None]), ("c", None)],
                                    "token string, vector array<double>")
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "b"), (3, "c"), (4, "zzz"), (5, ""), (6, None), (7, "a a c")]
                               + [(i, "a a b") for i in range(100, 300)], "id long, text string")
    out = V.embed_posts(df, vectors, 2)
    assert "_text_key" not in optimized(out)
    got = sorted(((r.id, r.embedding) for r in out.collect()), key=str)
    few = [x for x in got if x[0] < 100]
    assert few == [(1, [3.0, 2 / 3]), (1, [3.0, 2 / 3]), (2, [4.0, None]), (3, [None, None]), (4, [0.0, 0.0]), (5, [0.0, 0.0]),
                   (6, [0.0, 0.0]), (7, [1.0, 2.0])]
    assert [x[1] for x in got if x[0] >= 100] == [[2.5, 1.0]] * 200
    monkeypatch.setattr(V, "CHUNK_BITS", 1)         # chunks of two posts at most
    assert sorted(((r.id, r.embedding) for r in V.embed_posts(df, vectors, 2).collect()), key=str) == got
    assert V.embed_posts(df.where("false"), vectors, 2).count() == 0
    none = V.embed_posts_hashed(df, table.where("false"), 2).collect()
    assert len(none) == 208 and all(r.embedding == [0.0, 0.0] for r in none)
    assert len(V.embed_posts_hashed(df, table, 2).collect()) == 208


def test_new_rows_are_sent_once_to_the_stored_keys(spark):
    """Before, they were deduplicated and then sent again, to be joined."""
    stored = spark.createDataFrame([("1", "old"), (None, "old")], "id string, text string")
    new = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("2", "a", 3), (None, "x", 4)], "id string, text string, n int")
    out = state.append_dedup(stored, new)
    assert "LeftAnti" not in optimized(out)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(
        [("1", "old", None), (None, "old", None), ("2", "a", 3)], key=str)


def test_only_marked_lines_meet_the_pages(spark):
    docs = spark.createDataFrame([(1, "\n".join("abcdef"), "en", "s"), (3, None, "en", "s"), (None, "\n" * 5, "en", "s")],
                                 "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "u1"), (1, "u2"), (0, None)], "page_id long, url string")
    out = fx.text_posts_of(docs, pages, 2)
    assert "Union" in optimized(out)
    texts = [r.text for r in out.collect()]
    assert sorted(t for t in texts if t in tuple("abcdf")) == list("abcdf") and len(texts) == 13
    assert sorted(t for t in texts if len(t) > 1) == [" @user_1 #tema ", "e @user_1 #tema u1", "e @user_1 #tema u2"]


def test_posts_out_of_bounds_and_repeated_words_don_t_meet_the_lemmas(spark, sf001, monkeypatch):
    met = []
    monkeypatch.setattr(TM, "apply_lemma_table", lambda df, *a: (met.append(df.count()), apply_lemma_table(df, *a))[1])
    lemmas = spark.createDataFrame([("gatos", "gato")], "token string, lemma string")
    df = spark.createDataFrame([(1, "gatos perros casas"), (2, "gatos"), (3, "gatos " * 60)], "id long, text string")
    assert [r.text for r in TM.clean_posts(df, lemmas=lemmas).collect()] == ["gato perros casas"]
    assert met == [1]
    # the words of the table are made distinct before their lemmas are compared
    least = fx.lemmas(spark, sf001).groupBy("token").agg({"lemma": "min"})
    assert optimized(least).count("Aggregate [") == 2


@pytest.mark.parametrize("text", ["a b c d\x1ce", "ñandú áéíóúñü ３ x_y", "", "  ", "a​b 😀 c"])
def test_clean_text_splits_as_raw_text_does(spark, text):
    from pulso.functions import text as T
    import pyspark.sql.functions as F
    df = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_replace("t", f"[^{T.WORD}{T.SPACE}áéíóúñü]", "").alias("t"))
    a, b = df.select(T.split_words("t"), T.split_clean("t")).first()
    assert a == b


def test_term_cloud_joins_pairs_to_each_word_once(spark, monkeypatch):
    plans = []
    keep = TM.reliable_checkpoint
    monkeypatch.setattr(TM, "reliable_checkpoint", lambda df: (plans.append(optimized(df)), keep(df))[1])
    df = spark.createDataFrame([(i, "red cats red cat buss bus as") for i in range(9)], "id long, text string").selectExpr(
        "id", "text", "timestamp_ntz'2024-01-01 00:00:00' AS createdAt")
    out = {r.term: r["count"] for r in TM.daily_term_cloud(df, threshold=1e9).collect()}
    assert out == {"red": 18, "cat": 18, "buss": 9, "bus": 9, "as": 9}
    assert sum(p.count("Join ") for p in plans) == 3


def test_training_reads_its_texts_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    from pyspark.sql import functions as F
    df = spark.createDataFrame([(f"good {i}" if i % 2 else f"bad {i}", float(i % 2)) for i in range(40)], "t string, label double")
    see = F.udf(seen, "string").asNondeterministic()
    model = scorer.fit_text_classifier(df.select(see("t").alias("text"), "label"), num_features=1 << 10, max_iter=5)
    assert read.value == 40
    got = scorer.score_text(spark.createDataFrame([("good x",), ("bad x",)], "text string"), model).collect()
    assert [r.predicted for r in got] == ["1", "0"]


def test_pieces_share_a_chunk_and_exact_sums_are_floats(spark, monkeypatch):
    """Before, a chunk ended where a task's rows did, so that each task's chunks were sent their own
    vectors, as doubles."""
    vectors = spark.createDataFrame([("a", [0.5, 2.0]), ("b", [0.1, None]), ("c", [float("nan"), float("inf")])],
                                    "token string, vector array<double>")
    df = spark.createDataFrame([(i, "a b" if i % 2 else "a") for i in range(160)] + [(999, "c")], "id long, text string").repartition(16)
    sent = []
    table_type = type(df)
    join = table_type.join
    monkeypatch.setattr(table_type, "join", lambda self, other, on=None, how=None: (
        sent.append(self.count()) if on == "_unit" else None, join(self, other, on, how))[1])
    got = {r.id: r.embedding for r in V.embed_posts(df, vectors, 2).collect()}
    assert sent == [3]                                  # three tokens in all the tasks' posts
    assert got[0] == [0.5, 2.0] and got[1] == [0.3, 1.0]
    assert got[999][0] != got[999][0] and got[999][1] == float("inf")
    monkeypatch.setattr(V, "PIECE_BITS", 0)
    monkeypatch.setattr(V, "CHUNK_BITS", 2)             # some forty chunks of single posts
    again = {r.id: r.embedding for r in V.embed_posts(df, vectors, 2).collect()}
    assert {k: v for k, v in again.items() if k != 999} == {k: v for k, v in got.items() if k != 999}


def test_stages_that_are_not_kept_and_shuffles_go_as_the_run_goes_on(spark, tmp_path):
    """Before, all five stages of ``preprocess_quality`` and all shuffle files stayed to the end."""
    raw = spark.createDataFrame([(f"{i % 30}", f"uno perro gato casa{i} sol", i % 3 == 0) for i in range(60)],
                                "id string, text string, processed boolean").repartition(4)
    vecs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    lex = spark.createDataFrame([("perro", 1.0, 0.0, 0.0)], "word string, neg double, neu double, pos double")
    stored = raw.limit(3).select("id", "text")

    def run(name, **options):
        return preprocess(raw, lexicon_scorer(lex), hashed_embedder(vecs, 2), stored=stored, out=f"{tmp_path}/{name}",
                          day=F.lit(None).cast("date"), **options)

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    whole, bare = run("whole"), run("bare", keep=())
    assert spark.conf.get(key, None) == before
    assert whole.quality == bare.quality and [q["stage"] for q in whole.quality] == list(STAGES)
    assert sorted(os.listdir(tmp_path / "whole")) == sorted(STAGES) and os.listdir(tmp_path / "bare") == []
    assert whole.new_rows.count() == whole.quality[2]["n_rows"] > 0 and whole.raw.count() == 60
