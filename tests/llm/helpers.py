"""Rows and brute-force versions shared by the operator tests."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents(spark, texts, ids=None, sources=None):
    """Documents with an extra column whose name clashes with inner ones."""
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t), "x")
            for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(rows, DOCS + ", component string")


def prose(rnd, n, vocabulary=60):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))
