import random
import re
from collections import Counter

import pytest

from pulso.llm import collocations as C
from tests.llm.helpers import lower

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, prefix string"


def brute(rows, least=10, top=2000):
    f, size = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            size[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    f3 = {k: v for k, v in f.items() if len(k) == 4 and v >= least}
    out = {}
    for key, a in f.items():
        lang, *p = key
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(lang == g[0] and (list(g[1:3]) == p or list(g[2:]) == p) and 100 * v >= 50 * a
                               for g, v in f3.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[(lang, *p[:k])], f[(lang, *p[k:])]
            cuts.append((10 ** 6 * a * a // (left * right), k, left, right))
        s, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, size[lang], -s)
                  for lang, found in out.items()
                  for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def corpus(n=150, seed=1):
    rnd = random.Random(seed)
    common = ["New York City", "los angeles", "ä ö ü", "a a a a a", "don't stop", " x y", "日本 語"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rnd.randrange(60)):
            words.append(rnd.choice(common) if rnd.random() < 0.3 else f"w{rnd.randrange(12)}")
            words.append(rnd.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "!", "\x0b"]))
        rows.append((i, "".join(words), rnd.choice(["en", "en", "de", None, ""]), "x", 1, "p"))
    rows += [(500, None, "en", "x", 1, "p"), (501, "", None, "x", 1, "p"), (502, " \t.\n", "fr", "x", 1, "p")]
    return rows + rows[:20] + [(None, "the end " * 3000, "en", "x", 1, "p")]


@pytest.mark.parametrize("flush,segment,top", [(2_000_000, 10_000, 2000), (50, 7, 2000), (300, 1, 9)])
def test_equal_to_brute_force(spark, monkeypatch, flush, segment, top):
    monkeypatch.setattr(C, "FLUSH", flush)
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, C.mine(df, top=top).collect())) == brute(rows, top=top)


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", 64)                  # every phrase hits
    rows = corpus(60, 2)
    got = C.mine(spark.createDataFrame(rows, SCHEMA), least=5).collect()
    assert sorted(map(tuple, got)) == brute(rows, least=5)


def test_large_counts_stay_exact(spark):
    big = 3_000_000_019
    df = spark.createDataFrame([(big, big + 2, big + 4)], "a long, l long, r long")
    assert df.select(C._score("a", "l", "r")).first()[0] == 10 ** 6 * big * big // ((big + 2) * (big + 4))


def test_no_phrases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rare = spark.createDataFrame([(1, "one two three", "en", "", 0, "")], SCHEMA)
    assert C.mine(empty).collect() == [] and C.mine(rare).collect() == []
    assert C.mine(empty).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
