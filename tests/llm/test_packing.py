import random

from pulso.llm import packing as P

from .helpers import SPACED, documents, lower, prose


def brute(items, capacity, limit):
    """Best fit by trying every bin."""
    bins, out = [], []
    for size, source, cluster in items:
        best = None
        for b, (free, sources, clusters) in enumerate(bins):
            if (free >= size and sources.count(source) < limit and not (cluster and cluster in clusters)
                    and (best is None or (free, b) < (bins[best][0], best))):
                best = b
        if best is None:
            best = len(bins)
            bins.append([capacity, [], []])
        out.append((best, capacity - bins[best][0]))
        bins[best][0] -= size
        bins[best][1].append(source)
        bins[best][2].append(cluster)
    return out


def test_best_fit_equals_brute_force():
    rnd = random.Random(2)
    for _ in range(40):
        limit = rnd.choice([1, 2, 4])
        items = sorted(((rnd.randrange(1, 60), 1 << rnd.randrange(5), rnd.choice([0, 1, 2, 4])) for _ in range(120)),
                       key=lambda x: -x[0])
        assert P.best_fit(items, 64, limit) == brute(items, 64, limit)


def test_pack_keeps_every_word_and_every_rule(spark):
    rnd = random.Random(3)
    texts = [prose(rnd, rnd.randrange(0, 70)) for _ in range(150)] + [prose(rnd, 500)] + ["a b c"] * 20 + [None, "", " \t "]
    docs = documents(spark, texts, sources=[rnd.choice(["hot", "hot", "x", None]) for _ in texts])
    rows = P.pack(docs, capacity=64, max_per_source=2, shard_words=1500).collect()
    n_words = [len(SPACED.findall(lower(t))) for t in texts]
    got, bins = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    source = {r.doc_id: r.source for r in docs.collect()}
    for i, n in enumerate(n_words):
        assert sum(x for _, x in got[i]) == n
        assert sorted(got[i])[0][0] == 0
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert own[0].bin_offset == 0
        assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(own, own[1:]))
        assert sum(r.n_words for r in own) == own[0].bin_words <= 64
        for s in {source[r.doc_id] for r in own}:
            assert sum(source[r.doc_id] == s for r in own) <= 2
        said = [texts[r.doc_id] for r in own]
        assert len(set(said)) == len(said)          # copies never share a bin
    assert all(r.bin_id is None for r in rows if n_words[r.doc_id] == 0)


def test_pack_of_nothing(spark):
    assert P.pack(documents(spark, []).where("doc_id < 0")).collect() == []
    rows = P.pack(documents(spark, ["a b", "a b"], ids=[None, None])).collect()
    assert len(rows) == 2 and rows[0].bin_id != rows[1].bin_id


def test_rows_without_id_spread_over_the_shards(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, 20) for _ in range(600)]
    docs = documents(spark, texts, ids=[None if i % 3 else i for i in range(600)])
    rows = P.pack(docs, capacity=64, shard_words=600).collect()
    shards = {}
    for r in rows:
        shards[r.bin_id >> 32] = shards.get(r.bin_id >> 32, 0) + 1
    assert len(rows) == 600 and len(shards) > 12 and max(shards.values()) < 4 * 600 / len(shards)


def test_near_copies_of_a_class_never_share_a_bin(spark):
    docs = documents(spark, ["a b c", "a b d", "a b e", "x y z"], ids=[1, 2, 3, 4])
    classes = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1), (None, 9)], "doc_id long, component_id long")
    alone = {r.doc_id: r.bin_id for r in P.pack(docs, capacity=64).collect()}
    assert len(set(alone.values())) == 1
    apart = {r.doc_id: r.bin_id for r in P.pack(docs, capacity=64, classes=classes).collect()}
    assert len({apart[1], apart[2], apart[3]}) == 3 and apart[4] in (apart[1], apart[2], apart[3])


def test_a_shard_equals_brute_force(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, rnd.randrange(1, 50)) for _ in range(120)] + ["k l m"] * 6
    rnd.shuffle(texts)
    sources = [f"s{rnd.randrange(4)}" for _ in texts]
    rows = P.pack(documents(spark, texts, sources=sources), capacity=64, max_per_source=2).collect()
    order = sorted(range(len(texts)), key=lambda i: (-len(texts[i].split()), i))
    copies = {t: k for k, t in enumerate({t for t in texts if texts.count(t) > 1})}
    items = [(len(texts[i].split()), sources[i], copies[texts[i]] + 1 if texts[i] in copies else 0) for i in order]
    want = {i: placed for i, placed in zip(order, brute(items, 64, 2))}
    assert {r.doc_id: (r.bin_id, r.bin_offset) for r in rows} == want
