import hashlib
import random

import numpy as np

from pulso.llm import bwt as B

from .helpers import documents


def brute(ids, texts, length):
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, t in zip(ids, raw):
        if i is not None:
            for k in range(len(t) - length + 1):
                s = t[k:k + length]
                first[s] = min(i, first.get(s, i))
    out = []
    for i, t in zip(ids, raw):
        gone = bytearray(len(t))
        if i is not None:
            for k in range(len(t) - length + 1):
                if first[t[k:k + length]] < i:
                    gone[k:k + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((-1 if i is None else i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans,
                   hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


def collection(rnd):
    passages = ["".join(rnd.choice("abcdefgh é漢") for _ in range(rnd.randrange(30, 200))) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = ["".join(rnd.choice("abcdefghijklm ") for _ in range(rnd.randrange(0, 120))) for _ in range(3)]
        for _ in range(rnd.randrange(3)):
            parts.insert(rnd.randrange(len(parts)), rnd.choice(passages))
        texts.append("".join(parts))
    texts += [passages[0] * 3, "a" * 400, "a" * 300, "ab" * 300, "b" + "ab" * 200, "x" * 49, "x" * 50, "x" * 50, None, "", texts[0], texts[0]]
    rnd.shuffle(texts)
    return texts


def test_removal_equals_brute_force(spark):
    texts = collection(random.Random(14))
    ids = random.Random(1).sample(range(1000), len(texts))
    assert result(B.remove(documents(spark, texts, ids).repartition(3))) == brute(ids, texts, 50)


def test_large_bins_and_cut_indexes(spark, monkeypatch):
    texts = collection(random.Random(15))
    ids = list(range(len(texts)))
    want = brute(ids, texts, 50)
    monkeypatch.setattr(B, "BIN_BYTES", 300)
    assert result(B.remove(documents(spark, texts, ids))) == want


def test_repeated_and_missing_ids(spark):
    p = "".join(random.Random(2).choice("abcdef") for _ in range(80))
    texts, ids = [p, p, "z" + p, p, "y" + p, p], [4, 4, 4, 9, None, 2]
    assert result(B.remove(documents(spark, texts, ids))) == brute(ids, texts, 50)


def test_empty_table(spark):
    assert B.remove(documents(spark, ["a"]).where("false")).collect() == []


def test_index_equals_counting():
    rnd = random.Random(16)
    for length in (3, 20, 50):
        for alphabet in (b"ab", b"abcdefgh"):
            base = bytes(rnd.choice(alphabet) for _ in range(300))
            segs = [base[a:a + rnd.randrange(length, length + 20)] for a in (rnd.randrange(200) for _ in range(20))]
            docs = np.array([rnd.randrange(50) for _ in segs])
            offs = np.cumsum([0] + [len(s) + 1 for s in segs])
            index = B.RunLengthIndex(np.frombuffer(b"\xff".join(segs) + b"\xff", np.uint8), offs[1:] - 1, docs, length)
            first = {}
            for s, d in zip(segs, docs):
                for i in range(len(s) - length + 1):
                    first[s[i:i + length]] = min(int(d), first.get(s[i:i + length], 99))
            got = index.stream(offs[:-1], np.diff(offs) - length)
            assert got.tolist() == [first[s[i:i + length]] for s in segs for i in range(len(s) - length + 1)]
            assert index.runs < offs[-1]                      # repeats make runs
            row = index.find(segs[0][:length])                # backward search finds the class
            assert row == index.class_start[index.class_of[index.row_of[0]]]
            head, tail = index.samples                        # suffixes at the ends of each run
            assert len(head) == len(tail) == index.runs


def test_equal_windows_get_equal_keys():
    rnd = random.Random(17)
    shared = "".join(rnd.choice("abcd ") for _ in range(90))
    texts = [("x" * rnd.randrange(60) + "yz " * rnd.randrange(30) + shared + "w" * rnd.randrange(60)).encode() for _ in range(20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0] + [len(t) for t in texts])
    key, own, start, count = B.window_runs(data, offs)
    of: dict = {}
    seen = [0] * len(texts)
    for k, o, s, c in zip(key.tolist(), own.tolist(), start.tolist(), count.tolist()):
        assert 0 < c <= B.RUN
        for w in range(s, s + c):
            assert of.setdefault(texts[o][w:w + 50], k) == k
            seen[o] += 1
    assert seen == [max(0, len(t) - 49) for t in texts]
