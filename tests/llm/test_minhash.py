import random

import numpy as np
import pyarrow as pa

from pulso.llm import minhash as M
from pulso.llm import words as W
from pulso.llm.components import components

from .helpers import SPACED, documents, lower, prose


def shingle_set(text, size=5):
    w = SPACED.findall(lower(text))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def classes(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    return [(i, len(s), c) for (i, s), c in zip(enumerate(sets), classes(range(len(sets)), links).values())]


def near(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"n{rnd.randrange(999)}"
    return " ".join(w)


def collection(rnd):
    base = [prose(rnd, n, 5000) for n in (150, 300, 60, 120)]
    texts = []
    for b in base:
        texts += [near(rnd, b, rnd.randrange(0, 8)) for _ in range(25)]
    texts += [base[0]] * 10 + ["a b c", "A  b\tc", "a b d", "x", "X", "x x", "", None, " \n", "é É é", prose(rnd, 3000, 9000)]
    texts += [prose(rnd, 100, 5000) for _ in range(30)]
    rnd.shuffle(texts)
    return texts


def test_classes_equal_brute_force(spark):
    texts = collection(random.Random(9))
    got = sorted(map(tuple, M.link(documents(spark, texts)).collect()))
    assert got == brute(texts)
    kept = sorted(r.doc_id for r in M.keep_one(documents(spark, texts)).collect())
    assert kept == [i for i, _, c in brute(texts) if i == c]


def test_large_buckets_are_searched_whole(spark, monkeypatch):
    """Copies with independent edits: most pairs share a bucket and few are links, so classes
    are found only if every block meets every other one."""
    monkeypatch.setattr(M, "BLOCK", 8)
    rnd = random.Random(10)
    base = prose(rnd, 150, 9000)
    texts = [near(rnd, base, rnd.randrange(2, 12)) for _ in range(90)]
    assert sorted(map(tuple, M.link(documents(spark, texts)).collect())) == brute(texts)


def small_pairs(rnd, part, whole, n=400):
    """Texts of 6 to 40 words, each with one that has one to three words changed, added or
    left out and is still similar enough."""
    texts = []
    while len(texts) < 2 * n:
        a = [f"v{rnd.randrange(10**6)}" for _ in range(rnd.randrange(6, 41))]
        b = list(a)
        for _ in range(rnd.randrange(1, 4)):
            k, word = rnd.choice([0, len(b) - 1, len(b) - 1, rnd.randrange(len(b))]), f"v{rnd.randrange(10**6)}"
            b[k:k + 1] = rnd.choice([[word], [word, b[k]], [b[k], word], []])
        x, y = (shingle_set(" ".join(t)) for t in (a, b))
        if x != y and whole * len(x & y) >= part * len(x | y):
            texts += [" ".join(a), " ".join(b)]
    return texts


def test_links_of_short_texts_equal_brute_force(spark):
    texts = small_pairs(random.Random(12), *M.THRESHOLD)
    assert sorted(map(tuple, M.link(documents(spark, texts)).collect())) == brute(texts)


def test_short_texts_in_large_buckets(spark, monkeypatch):
    """Sets on both sides of ``SMALL``, in blocks that meet each other."""
    monkeypatch.setattr(M, "BLOCK", 8)
    rnd = random.Random(13)
    base = [prose(rnd, n, 9000) for n in (12, 40, M.SMALL + 6)]
    texts = [near(rnd, b, rnd.randrange(0, 3)) + rnd.choice(["", " end", " the end"]) for b in base for _ in range(50)]
    assert sorted(map(tuple, M.link(documents(spark, texts)).collect())) == brute(texts)


def test_repeated_and_missing_ids(spark):
    same = "one two three four five six seven"
    docs = documents(spark, [same, same, "other words that stand here alone", same, None, same],
                     ids=[5, 5, 5, 7, None, None])
    rows = sorted(((r.doc_id or -1), r.n_shingles, (r.component_id or -1)) for r in M.link(docs).collect())
    assert rows == [(-1, 0, -1), (-1, 3, -1), (5, 2, 5), (5, 3, 5), (5, 3, 5), (7, 3, 5)]
    kept = [r.doc_id for r in M.keep_one(docs).collect()]
    assert sorted(kept, key=str) == [5, None, None]


def test_empty_table(spark):
    none = documents(spark, ["a"]).where("false")
    assert M.link(none).collect() == [] and M.keep_one(none).collect() == []


def test_sketches_estimate_high_similarity():
    g = np.random.default_rng(3)
    for share in (0.85, 0.95):
        seen = []
        for _ in range(40):
            u = W.mix(g.integers(1, 1 << 63, 400, dtype=np.uint64))
            both = int(share * 400)
            a = np.sort(u[:both + (400 - both) // 2])
            b = np.sort(np.concatenate([u[:both], u[both + (400 - both) // 2:]]))
            sketch = M.odd_sketch(M.min_hashes(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))).view(np.uint64)
            seen.append(int(M.odd_bits(sketch[0], sketch[1])))
        assert max(seen) <= M.MAX_ODD
        assert abs(M.estimate(float(np.mean(seen))) - share) < 0.02


def test_shingles_of_a_batch():
    values, starts = M.shingles(pa.array(["a b c d e f", "A B C D E F", "a b", None, "a b c d e a b c d e"]))
    sets = [set(values[a:b].tolist()) for a, b in zip(starts, starts[1:])]
    assert sets[0] == sets[1] and [len(s) for s in sets] == [2, 2, 1, 0, 5]
    assert len(sets[0] & sets[4]) == 1


def test_components_equal_brute_force(spark):
    rnd = random.Random(11)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)]
    links += [(900, i) for i in range(901, 960)] + [(3, 3), (None, 4)]
    df = spark.createDataFrame(links, "a long, b long")
    true = [(a, b) for a, b in links if a is not None and a != b]
    ids = sorted({x for p in true for x in p})
    assert {r.node: r.component for r in components(df).collect()} == classes(ids, true)
    assert components(df.where("false")).collect() == []


def test_texts_of_a_repeated_id_all_link(spark):
    rnd = random.Random(21)
    a, b = prose(rnd, 80, 9000), prose(rnd, 80, 9000)
    docs = documents(spark, [a, a + " x", b + " x", b], ids=[1, 5, 5, 7])
    assert sorted({(r.doc_id, r.component_id) for r in M.link(docs).collect()}) == [(1, 1), (5, 1), (7, 1)]
    long_a, long_b = prose(rnd, 600, 90000), prose(rnd, 600, 90000)
    docs = documents(spark, [long_a, long_a + " x", long_b + " x", long_b], ids=[1, 5, 5, 7])
    assert sorted({(r.doc_id, r.component_id) for r in M.link(docs).collect()}) == [(1, 1), (5, 1), (7, 1)]


def test_copies_just_below_the_threshold(spark, monkeypatch):
    """Texts that share a base and differ so much that few of the many pairs are links: what goes
    on to be confirmed stays in proportion to the texts."""
    monkeypatch.setattr(M, "BLOCK", 16)
    rows = []
    confirm = M.confirm
    monkeypatch.setattr(M, "confirm", lambda pairs, *a: (rows.append(pairs.count()), confirm(pairs, *a))[1])
    counts = {}
    for n in (60, 120):
        rnd = random.Random(22)
        base = prose(rnd, 150, 9000)
        texts = [near(rnd, base, rnd.randrange(4, 9)) for _ in range(n)]
        rows.clear()
        assert sorted(map(tuple, M.link(documents(spark, texts)).collect())) == brute(texts)
        counts[n] = sum(rows)
    assert counts[120] <= 3 * counts[60] + 60


def test_the_session_keeps_its_batch_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    M.link(documents(spark, ["a b c d e f", "a b c d e f g"])).collect()
    assert spark.conf.get(key) == before
