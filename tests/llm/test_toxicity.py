import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pulso.llm import toxicity as T

from .helpers import ALNUM, documents, lower, prose

BAD = ["grumble", "snarled", "blargish"]


def texts_of(rnd, n):
    out, labels = [], []
    for _ in range(n):
        words = prose(rnd, rnd.randrange(5, 60), 400).split()
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "s", "ness"]))
        out.append(" ".join(words))
        labels.append(int(toxic))
    return out, labels


def label_rows(spark, labels):
    return spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")


def test_terms_equal_python():
    texts = ["Idiots éé ab-cd", None, "abcdefg abcdefg"]
    got = [Counter(), Counter(), Counter()]
    for key, doc in T.terms(pa.array(texts)):
        for k, d in zip(key.tolist(), doc.tolist()):
            got[d][k] += 1
    for t, c in zip(texts, got):
        want = Counter()
        for w in ALNUM.findall(lower(t)):
            want[w] += 1
            for n in T.PREFIXES:
                if len(w.encode()) > n:
                    want[n, w.encode()[:n]] += 1
        assert sorted(c.values()) == sorted(want.values())


def test_nearest_equals_full_cosine():
    rnd = random.Random(12)
    rows = [(i * 3, rnd.randrange(2), ks := sorted(rnd.sample(range(1, 21), rnd.randrange(0, 6))),
             [rnd.randrange(1, 4) for _ in ks]) for i in range(700)]
    model = T.BlockMax(list(range(1, 21)), rows)
    place = {int(k): i for i, k in enumerate(model.keys.view(np.int64))}
    dense = np.zeros((len(rows), 20))
    for i, (t, w) in enumerate(model.vectors):
        dense[i, t] = w
    for _ in range(150):
        counted = sorted((place[k], rnd.randrange(1, 5)) for k in rnd.sample(range(1, 21), rnd.randrange(1, 5)))
        t, w = model.vector(counted)
        assert math.isclose(float((w * w).sum()), 1)
        full = np.round(dense[:, t] @ w, 12)
        want = sorted(((-s, i) for i, s in enumerate(full) if s > 0))[:T.NEIGHBOURS]
        got = model.nearest(t, w)
        assert [i for _, i in got] == [i for _, i in want]
        assert np.allclose([s for s, _ in got], [-s for s, _ in want], atol=1e-9)


def test_held_out_accuracy(spark):
    texts, labels = texts_of(random.Random(13), 600)
    docs = documents(spark, texts + [None, ""])
    model = T.train(docs, label_rows(spark, labels))
    rows = T.score(docs, model).withColumn("held_out", T.held_out(T.F.col("doc_id"))).collect()
    assert len(rows) == 602
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= T.THRESHOLD)
        assert all(e.toxic == labels[e.doc_id] for e in r.evidence)
        assert all(zlib.crc32(str(e.doc_id).encode()) % 3 != 1 for e in r.evidence)
    held = [r for r in rows if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97
    kept = {r.doc_id for r in T.without_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}


def test_labels_that_cannot_be_learnt(spark):
    docs = documents(spark, ["a b c d", "a b c d", "e f g h"])
    for labels in ([], [0, 0, 0], [1, 1, 1], [None, None, None]):
        frame = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)] + [(None, 1, 1)],
                                      "doc_id long, quality int, toxic int")
        rows = T.score(docs, T.train(docs, frame)).collect()
        assert len({r.score for r in rows}) == 1 and len(rows) == 3
        assert rows[0].score == (1.0 if labels and labels[0] == 1 else 0.0)
    none = docs.where("false")
    assert T.score(none, T.train(none, label_rows(spark, []))).collect() == []


def test_document_counts_cover_the_corpus(spark):
    texts, labels = texts_of(random.Random(14), 300)
    docs = documents(spark, texts + [None, ""] + texts[:40])
    model = T.train(docs, label_rows(spark, labels))
    n, df = T.document_counts(docs, [int(k) for k in model.keys.view(np.int64)])
    assert n == 342 and len(df) == len(model.keys) > 0
    want = np.zeros(len(df), int)
    for t in texts + texts[:40]:
        for key in {int(k) for part, _ in T.terms(pa.array([t])) for k in part}:
            want[model.keys == np.uint64(key)] += 1
    assert df.tolist() == want.tolist()
    assert np.allclose(model.idf, np.log((n + 1) / (want + 1)) + 1)


def test_no_clear_term_is_left_out(spark):
    bad = [f"bad{chr(97 + i)}{chr(97 + j)}x" for i in range(15) for j in range(10)]
    rnd = random.Random(15)
    texts = [prose(rnd, 20) + (" " + " ".join(bad) if i % 3 == 0 else "") for i in range(120)]
    model = T.train(documents(spark, texts), label_rows(spark, [int(i % 3 == 0) for i in range(120)]))
    assert len(model.keys) >= len(bad)
