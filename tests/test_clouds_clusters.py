"""Term clouds with collocations (A13, A14), anchored clusters and topic words (M7, M8)."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pulso.operators import clustering as CL
from pulso.operators import terms as TM


def ratio(c12, c1, c2, n):
    if n <= c1 or n <= c2:
        return 0

    def lo(k, m, x):
        return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (m - k)
    p, p1, p2 = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    return -2 * (lo(c12, c1, p) + lo(c2 - c12, n - c1, p) - lo(c12, c1, p1) - lo(c2 - c12, n - c1, p2))


def cloud(posts, threshold, n):
    """One day's cloud of token lists."""
    words, pairs = Counter(w for t in posts for w in t), Counter(p for t in posts for p in zip(t, t[1:]))
    std = {w: w[:-1] if w.endswith("s") and not w.endswith("ss") and w[:-1] in words else w for w in words}
    single, folded = Counter(), Counter()
    for w, c in words.items():
        single[std[w]] += c
    for (a, b), c in pairs.items():
        folded[a, b[:-1] if b.endswith("s") and not b.endswith("ss") and (a, b[:-1]) in pairs else b] += c
    out = Counter(single)
    for (a, b), c in folded.items():
        if ratio(c, single[std[a]], single[std[b]], sum(words.values())) > threshold:
            out[std[a]] -= c
            out[std[b]] -= c
            out[f"{a} {b}"] = c
    return sorted(((t, c) for t, c in out.items() if c > 0), key=lambda x: (-x[1], x[0]))[:n]


def test_term_cloud_equals_brute_force(spark):
    rnd = random.Random(4)
    phrase = ["plaza nueva", "plazas nuevas", "casa", "casas", "boss", "bos", "gas", "ga", "mesa redonda", "mesa redondas"]
    rows, per_day = [], {}
    for i in range(160):
        day = rnd.choice([1, 1, 1, 2, 3])
        words = " ".join(rnd.choice(phrase) if rnd.random() < 0.4 else f"p{rnd.randrange(9)}{rnd.choice(['', 's'])}"
                         for _ in range(rnd.randrange(12))).split()
        rows.append((" ".join(words), dt.datetime(2024, 1, day, 5), "k"))
        per_day.setdefault(dt.date(2024, 1, day), []).append(words)
    rows += [(None, dt.datetime(2024, 1, 1), "k"), ("nada aqui", None, "k"), ("", dt.datetime(2024, 1, 2), "k")]
    df = spark.createDataFrame(rows, "text string, createdAt timestamp, word string")
    for threshold in (5.0, TM.COLLOCATION):
        got = {}
        for r in TM.daily_term_cloud(df, n=25, threshold=threshold).collect():
            got.setdefault(r.date, []).append((r.term, r["count"]))
        want = {d: cloud(p, threshold, 25) for d, p in per_day.items()}
        assert {d: sorted(x, key=lambda y: (-y[1], y[0])) for d, x in got.items()} == want
    assert any(" " in t for x in want.values() for t, _ in x)
    assert TM.daily_term_cloud(df.where("false")).collect() == []


def test_a_pair_is_taken_off_its_words(spark):
    posts = ["santa fe linda"] * 30 + ["otra cosa mas"] * 30 + [f"linda otra x{i}" for i in range(30)]
    df = spark.createDataFrame([(p, dt.datetime(2024, 1, 1)) for p in posts], "text string, createdAt timestamp")
    got = {r.term: r["count"] for r in TM.daily_term_cloud(df).collect()}
    assert got["santa fe"] == 30 and "santa" not in got and "fe" not in got


def brute_anchored(ids, x, anchors, free, rounds):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.array([a / np.linalg.norm(a) for a in anchors])
    for _ in range(free):
        near = (x @ c.T).max(axis=1)
        k = min(range(len(ids)), key=lambda i: (near[i], ids[i]))
        c = np.vstack([c, x[k]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for t in range(len(anchors), len(c)):
            total = x[own == t].sum(axis=0)
            if (own == t).any() and np.linalg.norm(total):
                c[t] = total / np.linalg.norm(total)
    return (x @ c.T).argmax(axis=1)


def test_anchored_topics_equal_brute_force(spark):
    g = np.random.default_rng(2)
    true = g.standard_normal((5, 12))
    x = np.concatenate([true[i] + 0.3 * g.standard_normal((60, 12)) for i in range(5)])
    ids = list(range(100, 400))
    rows = [(i, [float(c) for c in v], "t") for i, v in zip(ids, x)]
    odd = [(1, None, "t"), (2, [0.0] * 12, "t"), (3, [float("nan")] * 12, "t"), (4, [1.0], "t")]
    schema = "id long, embedding array<double>, n string"
    df = spark.createDataFrame(rows, schema).repartition(6)
    anchors = spark.createDataFrame([(t, [float(c) for c in true[t]]) for t in (0, 1, 2)],
                                    "topic_id int, centroid array<double>")
    model = CL.fit_anchored(df.unionByName(spark.createDataFrame(odd, schema)), anchors, 2, 3)
    kept = {r.topic_id: r.anchored for r in model.collect()}
    assert kept == {0: True, 1: True, 2: True, 3: False, 4: False}
    got = {r.id: r.topic for r in CL.anchored_topics(df, anchors, 2, 3).collect()}
    want = brute_anchored(ids, x, true[:3], 2, 3)
    assert [got[i] for i in ids] == want.tolist()
    sizes = Counter(got.values())
    assert set(sizes) == {0, 1, 2, 3, 4} and min(sizes.values()) > 40
    # the anchors keep their ids whatever the free topics do; small free topics are given up
    few = {r.id: r.topic for r in CL.anchored_topics(df, anchors, 2, 3, min_size=100).collect()}
    assert set(few.values()) == {-1, 0, 1, 2} and all(few[i] == t for i, t in got.items() if t < 3)


def test_anchors_alone_free_topics_alone_and_no_rows(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 2.0]), ("d", None)],
                               "id string, embedding array<double>")
    none = spark.createDataFrame([], "topic_id int, centroid array<double>")
    got = {r.id: r.topic for r in CL.anchored_topics(df, none, 2, 5).collect()}
    assert got["b"] == got["c"] != got["a"] and {got["a"], got["b"]} == {0, 1}
    assert CL.fit_anchored(df.where("false"), none, 3).collect() == []
    one = spark.createDataFrame([(7, [1.0, 1.0])], "topic_id int, centroid array<double>")
    assert {r.topic for r in CL.anchored_topics(df, one, 0).collect() if r.id != "d"} == {7}


def test_topic_words(spark):
    docs = [(0, ["a", "a", "b"]), (0, ["a", "c"]), (1, ["c", "c", "d"]), (None, ["z"]), (1, []), (1, None)]
    df = spark.createDataFrame(docs, "topic int, words array<string>")
    got = [(r.topic, r["rank"], r.word, r["count"]) for r in CL.topic_words(df, F.col("words"), 2).orderBy("topic", "rank").collect()]
    assert got == [(0, 1, "a", 3), (0, 2, "b", 1), (1, 1, "c", 2), (1, 2, "d", 1)]
    score = {(r.topic, r.word): r.score for r in CL.topic_words(df, "words").collect()}
    assert math.isclose(score[0, "a"], 3 / 5 * math.log(1 + 4 / 3)) and math.isclose(score[1, "c"], 2 / 3 * math.log(1 + 4 / 3))
    assert CL.topic_words(df.where("false"), "words").collect() == []
