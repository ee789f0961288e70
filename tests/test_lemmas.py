"""Lemma tables: position-keeping token join."""

import os
import random

from pulso.operators import lemmas as L
from pulso.operators import terms as TM
from pulso.operators.lemmas import apply_lemma_table
from pulso.session import ensure_checkpoint_dir

LEMMAS = [("gatos", "gato"), ("perros", "perro"), ("casas", "casa"), ("same", "same"), ("dos", "b"), ("dos", "a"),
          (None, "x"), ("y", None), ("los", "el")]


def table(spark):
    return spark.createDataFrame(LEMMAS, "token string, lemma string")


def test_words_keep_their_places(spark):
    rows = [(1, ["gatos", "y", "perros", "gatos", "dos", None]), (2, []), (3, None), (4, ["same", "zzz"]),
            (1, ["gatos", "y", "perros", "gatos", "dos", None])]
    df = spark.createDataFrame(rows, "id long, ws array<string>")
    got = sorted(((r.id, r.ws) for r in apply_lemma_table(df, "ws", table(spark)).collect()), key=str)
    assert got == [(1, ["gato", "y", "perro", "gato", "a", None])] * 2 + [(2, []), (3, None), (4, ["same", "zzz"])]
    assert apply_lemma_table(df, "ws", table(spark).where("false")).count() == 5
    assert apply_lemma_table(df.where("false"), "ws", table(spark)).columns == ["id", "ws"]


def test_a_table_gives_what_a_map_gives(spark):
    texts = ["Los gatos! y perros corren @x http://a.b", "casas casas casas", "uno gatos", None, "",
             "Los gatos! y perros corren @x http://a.b", " ".join(["perros"] * 51), "gatos 12 perros casas #tema"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    literal = {"gatos": "gato", "perros": "perro", "casas": "casa", "dos": "a", "los": "el"}
    for step in (TM.clean_posts, TM.clean_topic_posts):
        a = sorted(map(tuple, step(df, lemmas=literal).collect()))
        b = sorted(map(tuple, step(df, lemmas=table(spark)).collect()))
        assert a == b and a


def test_plan_has_no_literal_map(spark):
    df = spark.createDataFrame([(1, "gatos perros casas")], "id long, text string")
    plan = TM.clean_posts(df, lemmas=table(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "gatos" not in plan.replace("gatos perros casas", "") and "Python" not in plan


def test_a_common_text_meets_the_lemmas_once(spark):
    df = spark.createDataFrame([(i, "gatos perros casas" if i % 3 else f"gatos perros w{i}") for i in range(300)],
                               "id long, text string")
    got = {r.id: r.text for r in TM.clean_posts(df, stop=(), lemmas=table(spark)).collect()}
    assert got == {i: "gato perro casa" if i % 3 else f"gato perro w{i}" for i in range(300)}


def test_copies_of_a_text_do_not_add_up(spark):
    """Scores that depend on a text alone are the same however many posts have the text."""
    from pulso.operators import topics as TP
    seeds = spark.createDataFrame([(0, "gato"), (1, "perro"), (1, "casa")], "seed_id int, keyword string")
    docs = spark.createDataFrame([(i, "gato gato perro casa casa" if i < 50 else "perro gato gato") for i in range(60)],
                                 "id long, clean_text string")
    got = {r.id: r.topic for r in TP.seed_topics(docs, seeds, min_size=1).collect()}
    assert got == {i: 1 if i < 50 else 0 for i in range(60)}


def _random_posts(spark, seed, n=400):
    """Posts of 1 to 130 words: with and without lemmas, stop words, digits, and words whose lemma is
    a stop word or digits, or that are stop words with another lemma."""
    rnd = random.Random(seed)
    literal = {"gatos": "gato", "perros": "perro", "siendo": "ser", "uno": "1", "los": "lobo", "12": "doce", "eran": "ser"}
    words = [*literal, "de", "la", "que", "7", "casa", "sol", "mar", "luz", "gato"]
    texts = []
    for i in range(n):
        some = rnd.sample(words, rnd.randrange(1, 9))
        texts.append(" ".join(rnd.choice(some) for _ in range(rnd.choice([1, 2, 3, 4, 20, 49, 50, 51, 52, 60, 90, 130]))))
    df = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "id long, text string, more string")
    return df, literal, spark.createDataFrame([*literal.items(), *LEMMAS[3:4]], "token string, lemma string")


def test_bounds_told_before_the_lemmas_are_those_after(spark, monkeypatch):
    df, literal, lemmas = _random_posts(spark, 1)
    want = sorted(map(tuple, TM.clean_topic_posts(df, lemmas=literal).collect()))
    assert 50 < len(want) < 350
    assert sorted(map(tuple, TM.clean_topic_posts(df, lemmas=lemmas).collect())) == want
    monkeypatch.setattr(TM, "DROPPED_TOKENS", 0)            # more tokens than are looked for
    assert sorted(map(tuple, TM.clean_topic_posts(df, lemmas=lemmas).collect())) == want


def test_chunks_blocks_and_buckets_of_any_size(spark, monkeypatch):
    df, literal, lemmas = _random_posts(spark, 2)
    for bits, block, buckets in ((0, 40, 1), (2, 300, 3)):
        for name, value in (("CHUNK_BITS", bits), ("BLOCK_WORDS", block), ("BUCKETS", buckets)):
            monkeypatch.setattr(L, name, value)
        for step in (TM.clean_posts, TM.clean_topic_posts):
            want = sorted(map(tuple, step(df, lemmas=literal).collect()))
            assert sorted(map(tuple, step(df, lemmas=lemmas).collect())) == want


def test_a_lemma_table_takes_less_disk_than_the_texts(spark):
    """Before, texts and all their words were written uncompressed: 1.8 times the texts here, and
    texts too long for the bounds too."""
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([30, 200]))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(base) for f in names)
    before = size()
    assert TM.clean_topic_posts(df, lemmas=table(spark)).count() == sum(len(t.split()) == 30 for t in texts)
    assert 0 < size() - before < sum(map(len, texts)) / 4
