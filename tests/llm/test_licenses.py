from pulso.llm import licenses as L

from .helpers import ALNUM, documents, lower


def test_hundreds_of_rules_each_with_keyword_and_regex():
    assert len(L.rules()) > 250
    assert all(L.WORD.findall(k) for _, _, k, _ in L.rules())


def labels(text):
    return {f[0] for f in L.scan_text(lower(text))[1]}


def test_rules_and_suppression():
    assert labels("Licensed under the Apache License,\nVersion 2.0.") == {"apache-2.0"}
    assert labels("the GNU General Public License, version 3 or later") == {"gpl-3.0"}
    assert labels("under the GNU Lesser General Public License v2.1") == {"lgpl-2.1"}
    assert labels("GNU Affero General Public License") == {"agpl"}
    assert labels("SPDX-License-Identifier: GPL-2.0-only") == {"gpl-2.0"}
    assert labels("CC BY-NC 4.0") == {"cc-by-nc-4.0"}
    assert labels("released under the MIT License, see also BSD 3-Clause") == {"mit", "bsd-3-clause"}
    assert labels("an emitted license") == set()
    # contained and outranked detections go, apart ones stay
    assert L.resolve([("a", 0, 5, 5), ("b", 1, 3, 5), ("c", 4, 8, 3), ("d", 9, 10, 3)]) == [
        ("a", 0, 5, 5), ("d", 9, 10, 3)]


def test_base_places_equal_brute_force(spark):
    texts = ["MIT License mit-license MIT\tLICENSE", "mit licenses", "the general public. license", None, "",
             "x " * 5000 + "apache license", "ÉMIT license mit license"]
    rows = sorted(L.digest(L.scan(documents(spark, texts))).collect(), key=lambda r: r.doc_id)
    for t, r in zip(texts, rows):
        words = ALNUM.findall(lower(t))
        at = [(i, v) for p, v in L.PHRASES.items() for i in range(len(words))
              if words[i:i + len(p.split())] == p.split()]
        assert r.n_words == len(words) and r.n_base == len(at)
        assert r.first_word == min([i for i, _ in at], default=None)
        assert r.last_word == max([i for i, _ in at], default=None)
        assert r.base_labels == ",".join(sorted({v for _, v in at}))
        assert {v for _, v in at} <= set(r.labels.split(",")) | ({""} if not at else set())
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_empty_table(spark):
    assert L.digest(L.scan(documents(spark, ["a"]).where("false"))).collect() == []
