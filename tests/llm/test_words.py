import random

import numpy as np
import pyarrow as pa

from pulso.llm import words as W

from .helpers import ALNUM, SPACED, lower


def test_words_and_hashes_equal_python():
    rnd = random.Random(1)
    alphabet = "aB9 \t\x0b\x0c\x1c-É漢_"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(200)]
    texts += ["", None, "x" * (W.CHUNK + 10), " ", "A"]
    data, offs = W.flat(pa.array(texts))
    low = W.lower(data)
    for cls, regex in ((W.SPACED, SPACED), (W.ALNUM, ALNUM)):
        s, e, first = W.bounds(low, offs, cls)
        h = W.hash_words(low, s, e)
        seen = {}
        for k, t in enumerate(texts):
            own = range(first[k], first[k + 1])
            words = [low[s[i]:e[i]].tobytes().decode() for i in own]
            assert words == regex.findall(lower(t))
            for i, w in zip(own, words):
                assert seen.setdefault(w, int(h[i])) == int(h[i])
        assert len(set(seen.values())) == len(seen)


def test_grams_stay_in_their_text():
    data, offs = W.flat(pa.array(["a b c d", "a b", "c d", "b c d"]))
    s, e, first = W.bounds(data, offs, W.SPACED)
    h = W.hash_words(data, s, e)
    g, at = W.grams(h, first, 3)
    assert at.tolist() == [0, 1, 8]
    assert g[1] == g[2] != g[0]


def test_slices_cover_a_batch_in_order():
    texts = ["x" * n for n in (5, 0, 100, 3, 3, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(W.slices(batch, "text", 60))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(6))
    assert np.sum([p.num_rows for p in parts]) == 6 and len(parts) > 1
