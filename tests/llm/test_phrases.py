import random

from pyspark.sql import functions as F

from pulso.llm import phrases as P

from .helpers import ALNUM, documents, lower, prose


def brute(texts, items, width=10):
    out = []
    for t in texts:
        words, hit, found = ALNUM.findall(lower(t)), set(), set()
        for item, said in items:
            own = ALNUM.findall(lower(said))
            size = min(width, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                for j in range(len(words) - size + 1):
                    if words[j:j + size] == own[i:i + size]:
                        hit.update(range(j, j + size))
                        found.update([str(item)] if item is not None else [])
        out.append((len(words), len(hit), sorted(found)))
    return out


def case(rnd):
    items = [(k, prose(rnd, rnd.choice([0, 1, 3, 10, 25]), 40)) for k in range(12)]
    items += [(100, items[3][1]), (101, None), (7, prose(rnd, 12))]
    texts = []
    for _ in range(60):
        parts = [prose(rnd, rnd.randrange(0, 30), 40)]
        if rnd.random() < 0.5:
            parts.insert(rnd.randrange(2), rnd.choice(items)[1] or "")
        texts.append(", ".join(parts).title())
    return texts + [None, "", "..."], items


def test_find_equals_brute_force_also_in_blocks(spark):
    texts, items = case(random.Random(4))
    texts.append(" ".join(f"u{i}" for i in range(12)))
    items.append((None, texts[-1]))                      # found, but without a name
    docs = documents(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(texts, items)
    assert any(hit and not found for _, hit, found in want)
    for size in (P.BLOCK_WINDOWS, 40):
        rows = sorted(P.find(docs, bench, block_windows=size).collect(), key=lambda r: r.doc_id)
        assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == want
    clean = {r.doc_id for r in P.without_matches(docs, bench).collect()}
    assert clean == {i for i, w in enumerate(want) if not w[1]}


def test_phrases_never_cross_documents_and_spans_say_where(spark):
    phrase = " ".join("abcdefghij")
    docs = documents(spark, ["x a b c d e", "f g h i j", f"q {phrase} r {phrase}", phrase], ids=[1, 2, 3, 3])
    bench = spark.createDataFrame([(5, phrase)], "item_id long, text string")
    rows = P.find(docs, bench).collect()
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in rows) == [
        (1, []), (2, []), (3, [(0, 10)]), (3, [(1, 11), (12, 22)])]


def test_proximity(spark):
    docs = documents(spark, ["one two three four", "one two x three four", "one three two four", "four one"])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    hit = lambda slop: [bool(r["items"]) for r in sorted(
        P.find(docs, bench, slop=slop).collect(), key=lambda r: r.doc_id)]
    assert hit(0) == [True, False, False, False]
    assert hit(1) == [True, True, False, False]
    assert hit(2) == [True, True, True, False]


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = documents(spark, ["a b"]).where(F.lit(False))
    assert P.find(none, bench).collect() == []
    row = P.digest(P.find(documents(spark, ["a b"]), bench.where(F.lit(False)))).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    texts, items = case(random.Random(8))
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(P, "filter_of", lambda found: b"\xff" * 8)
    rows = sorted(P.find(documents(spark, texts), bench).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == brute(texts, items)
