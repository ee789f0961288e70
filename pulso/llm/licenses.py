"""License scan: ordered signature rules behind a keyword prefilter.

``license_rules.txt`` holds the hand-written rules: label, priority, keyword and a
regex over the words of a text. A text is searched once for all keywords (an
Aho-Corasick automaton over the longest word of each); only the regexes whose keyword
occurs are run. Overlapping
detections are resolved in order of priority, then length, then place: one that
lies within an accepted one is suppressed, and so is one that overlaps an accepted
one of higher priority.

Beside the rules, *base phrases* are counted exactly: every place where a phrase's
words stand consecutively. They are never suppressed.

Words: A-Z lower-cased, maximal runs of a-z, digits and characters outside ASCII.
Regexes see the words joined by single spaces, and match whole words only.

Defined cases: null and empty texts have no words, no labels ('') and score 0.
The score is the noisy-or of the accepted detections' confidences (by priority) and of
the base phrases'. Rows are independent; repeated ids and extra columns do no harm.
The scan is one narrow pass; nothing is shuffled.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from importlib import resources

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import small_batches, table

#: Base phrases of the query and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Confidence of a detection by its rule's priority, and of a base phrase.
CONFIDENCE = {9: 0.99, 8: 0.97, 7: 0.95, 6: 0.9, 5: 0.85, 3: 0.5}
BASE_CONFIDENCE = 0.85

#: Keywords up to this length must be words of the text, longer ones may be parts of words.
SHORT = 4

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
_OUT = ("doc_id long, n_words long, places array<struct<phrase:string,word:long>>, "
        "found array<struct<label:string,first:long,stop:long,priority:int>>, score double")
_PLACES = pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())]))
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64()),
                             ("priority", pa.int32())]))


@functools.lru_cache(maxsize=1)
def rules() -> list[tuple[str, int, str, re.Pattern]]:
    """``(label, priority, keyword, regex)`` in the order of the rule file."""
    out = []
    text = resources.files(__package__).joinpath("license_rules.txt").read_text(encoding="utf-8")
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        label, *rest = (x.strip() for x in line.split(" ; "))
        if label != "spdx":
            priority, keyword, pattern = rest
            out.append((label, int(priority), keyword, pattern))
            continue
        for name in rest[0].lower().split():
            plain = " ".join(WORD.findall(name))
            label = re.sub("-(only|or-later)$", "", name)
            out.append((label, 9, "spdx", f"spdx licen[sc]e identifier {plain}"))
            out.append((label, 7, name, f"{plain} licen[sc]e"))
    return [(a, b, c, re.compile(rf"(?<!\S)(?:{p})(?!\S)")) for a, b, c, p in out]


@functools.lru_cache(maxsize=8)
def _automaton(phrases: tuple[str, ...]):
    """Finds keywords: the rules that each opens, and the phrases by their last word."""
    opens: dict[str, list] = {}
    for k, (_, _, keyword, _) in enumerate(rules()):
        opens.setdefault(max(WORD.findall(keyword), key=len), []).append(k)
    for p in phrases:
        opens.setdefault(p.split(" ")[-1], []).append(p)
    a = ahocorasick.Automaton()
    for keyword, what in opens.items():
        a.add_word(keyword, (keyword, tuple(what)))
    a.make_automaton()
    return a


def resolve(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Suppress contained and outranked overlaps among ``(label, first, stop, priority)``."""
    kept: list[tuple[str, int, int, int]] = []
    for d in sorted(set(found), key=lambda d: (-d[3], d[1] - d[2], d[1], d[0])):
        if not any(k[1] <= d[1] and d[2] <= k[2] or
                   k[3] > d[3] and k[1] < d[2] and d[1] < k[2] for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def scan_text(low: str, phrases: tuple[str, ...] = tuple(PHRASES)):
    """Base places ``(phrase, word)`` and resolved detections of one lower-cased text."""
    keywords = {hit for _, hit in _automaton(phrases).iter(low)}
    if not keywords:
        return [], []
    words = WORD.findall(low)
    known = set(words)
    opened = {k for keyword, what in keywords if len(keyword) > SHORT or keyword in known for k in what}
    places = []
    for p in phrases:
        if p in opened:
            parts = p.split(" ")
            places += [(p, i) for i, w in enumerate(words)
                       if w == parts[0] and words[i:i + len(parts)] == parts]
    joined = " ".join(words)
    starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
    found = []
    for k in sorted(x for x in opened if isinstance(x, int)):
        label, priority, _, pattern = rules()[k]
        for m in pattern.finditer(joined):
            found.append((label, bisect_right(starts, m.start()) - 1,
                          bisect_right(starts, m.end() - 1), priority))
    return sorted(places, key=lambda x: (x[1], x[0])), resolve(found)


def scan(docs: DataFrame, phrases: tuple[str, ...] = tuple(PHRASES)) -> DataFrame:
    """Per document: ``n_words``, ``places`` of base phrases, ``found`` detections (in words,
    end exclusive) and ``score``."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "text"):
                data, offs = W.flat(part.column(1))
                low = W.lower(data)
                _, _, first = W.bounds(low, offs, W.ALNUM)
                raw = low.tobytes()
                places, found, score = [], [], []
                for i in range(part.num_rows):
                    p, f = scan_text(raw[offs[i]:offs[i + 1]].decode("utf-8", "replace"), phrases)
                    miss = np.prod([1 - CONFIDENCE[x[3]] for x in f] + [1 - BASE_CONFIDENCE] * len(p))
                    places.append([{"phrase": a, "word": b} for a, b in p])
                    found.append([{"label": a, "first": b, "stop": c, "priority": d} for a, b, c, d in f])
                    score.append(float(1 - miss))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(places, _PLACES),
                     pa.array(found, _FOUND), pa.array(score)],
                    names=["doc_id", "n_words", "places", "found", "score"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, _OUT))


def digest(scanned: DataFrame, labels: dict[str, str] = PHRASES) -> DataFrame:
    label_of = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    base = F.array_distinct(F.transform("places", lambda p: label_of[p["phrase"]]))
    every = F.array_union(base, F.transform("found", lambda d: d["label"]))
    start = F.transform("places", lambda p: p["word"])
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"), "score", "found")


def query(spark, sf_dir):
    return digest(scan(table(spark, sf_dir, "documents"))).drop("found")
