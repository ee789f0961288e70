"""Quality rules as a short-circuit cascade of native expressions.

Each rule is a boolean expression over a text column that is true where the rule rejects
the text. ``cascade`` nests the rules in one CASE expression: a row that an early rule
rejects never evaluates a later one, so the order decides what the filter costs.

1. ``estimate`` draws a sample (``SAMPLE_ROWS`` rows expected, every row equally likely),
   times each rule on it, less the time of an empty pass, and counts which sets of rules
   reject the sample's rows (one aggregate, at most one row per set).
2. ``in_order`` takes the rules greedily by rejection per cost, where rejection is the share
   of the sample's rows that no rule taken before rejects: a rule that only repeats another
   one goes to the end however often it rejects.
3. ``judge`` adds the name of the first rule that rejects, in that order (null: kept).

The sample decides the order and nothing else: which rows are kept is the same in any
order, and no row is left out. The order follows measured times, so the *name* of the first
rule may differ between runs where several rules reject a row; the verdict does not.

Everything is DataFrame functions: no Python in tasks.

Defined results: a null text is read as empty (it has no words and is rejected by
``few_words``); a rule that gives null doesn't reject; repeated rows and ids are judged row
by row; very long texts are judged whole; an empty table gives an empty result with the
rules in their given order; a column that already has the verdict's name is replaced.
Repeated windows are told by 64-bit hashes within one text.
"""

from __future__ import annotations

import time
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import discard, table, written

SAMPLE_ROWS = 2_000         # expected rows of the sample that orders the rules
LEAST_COST = 1e-4           # seconds; below this a measured difference is noise
WINDOW = 8                  # words of a window whose repetition counts

#: Fixed values of the query's contract.
SPACES = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]+"


class Estimate(NamedTuple):
    name: str
    cost: float             # seconds for the sample
    rejected: int           # rows of the sample that the rule rejects


# -- measures of a text ------------------------------------------------------------------

def whole(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \\t-\\r]++")).cast("long")


def n_without(text: Column, pattern: str) -> Column:
    """Code points outside the matches of ``pattern``."""
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.char_length(text).cast("long") - n_without(text, SYMBOLS)


def lines(text: Column) -> Column:
    """The \\n-split lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def n_equal_lines(of_lines: Column) -> Column:
    return (F.size(of_lines) - F.size(F.array_distinct(of_lines))).cast("long")


def n_repeat_words(of_words: Column) -> Column:
    """Words that lie in a window found twice or more. Most texts repeat no window, which a
    hash set of the window hashes tells; only the others sort theirs."""

    def covered(starts):
        out = F.aggregate(
            starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda at, i: F.struct(i.alias("last"), (at.n + F.least(F.lit(WINDOW), i - at.last)).alias("n")))
        return out.n

    def repeated(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p):
            def same(k):                # the window at k has the hash of its predecessor
                return (k > 0) & (k < F.size(p)) & (F.get(p, k).h == F.get(p, k - 1).h)
            return F.transform(F.filter(p, lambda x, k: F.coalesce(same(k) | same(k + 1), F.lit(False))),
                               lambda x: x.i)
        return covered(F.array_sort(let(pairs, starts)))

    def counted(w):
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW),
                             lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
        return F.when(F.size(w) > WINDOW, let(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long"))
        )).otherwise(F.lit(0).cast("long"))

    return let(F.transform(of_words, lambda x: F.xxhash64(x)), counted)


def measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and the base measures of every whole text."""
    t = whole(text)
    held = docs.select(*keep, t.alias("_text"), words(t).alias("_words"), lines(t).alias("_lines"))
    t = F.col("_text")
    return held.select(
        *keep, F.size("_words").cast("long").alias("n_words"),
        n_without(t, SPACES).alias("word_chars"), n_symbols(t).alias("n_symbols"),
        n_equal_lines(F.col("_lines")).alias("n_dup_lines"),
        n_repeat_words(F.col("_words")).alias("n_repeat_words"))


# -- rules -------------------------------------------------------------------------------

def default_rules(text="text", known: dict[str, Column] | None = None) -> dict[str, Column]:
    """Name -> rejecting expression over the raw text, each complete in itself, so that a
    skipped rule costs nothing. The first two are the base rules. ``known``: columns that
    already hold some of the measures (where a caller wants them for every row anyway)."""
    t, known = whole(text), known or {}
    n = known.get("n_words", n_words(t))
    chars = known.get("word_chars", n_without(t, SPACES))
    repeated = (100 * known["n_repeat_words"] > 30 * n if "n_repeat_words" in known else
                let(words(t), lambda w: 100 * n_repeat_words(w) > 30 * F.size(w)))
    return {
        "few_words": n < 20,
        "repeated_words": repeated,
        "many_symbols": 40 * known.get("n_symbols", n_symbols(t)) > F.char_length(t),
        "odd_word_length": let(F.struct(chars.alias("c"), n.alias("n")),
                               lambda x: ~x.c.between(2 * x.n, 12 * x.n)),
        "few_letters": 10 * n_without(t, "\\P{L}+") < 6 * chars,
        "equal_lines": let(lines(t), lambda x: let(n_equal_lines(x), lambda n: (
            (n >= 3) & (100 * n > 30 * F.size(x))))),
        "word_runs": let(words(t), lambda w: 100 * F.size(F.filter(
            w, lambda x, i: x == F.get(w, i + 1))) > 30 * F.size(w)),
        "bullet_lines": let(lines(t), lambda x: 10 * F.size(F.filter(
            x, lambda y: y.rlike("^[ \\t]*[•‣◦*-]"))) > 9 * F.size(x)),
        "cut_lines": let(lines(t), lambda x: 10 * F.size(F.filter(
            x, lambda y: y.rlike("(\\.\\.\\.|…)[ \\t\\r]*$"))) > 3 * F.size(x)),
    }


def _seconds(df: DataFrame, value: Column) -> float:
    """The shorter of two runs over ``df`` (the first compiles the expression)."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count_if(value)).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def estimate(docs: DataFrame, rules: dict[str, Column], columns=("text",),
             rows: int = SAMPLE_ROWS, seed: int = 7) -> tuple[list[Estimate], list[tuple[int, int]]]:
    """Cost and rejections of each rule on a sample, and the sample's rows by the set of rules
    that reject them (bit k of the set: the k-th rule)."""
    total = docs.count()
    sample = written(docs.select(*columns).sample(min(1.0, rows / max(total, 1)), seed), "rule-sample")
    empty = _seconds(sample, F.expr("true"))
    costs = [max(_seconds(sample, r) - empty, LEAST_COST) for r in rules.values()]
    rejects = [F.when(F.coalesce(r, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
               for k, r in enumerate(rules.values())]
    sets = [tuple(x) for x in sample.select(sum(rejects, F.lit(0).cast("long")).alias("s"))
            .groupBy("s").count().collect()]
    discard(sample)
    hits = [sum(n for s, n in sets if s >> k & 1) for k in range(len(rules))]
    return [Estimate(*x) for x in zip(rules, costs, hits)], sets


def in_order(estimates: list[Estimate], sets: list[tuple[int, int]]) -> list[str]:
    """Rules by rejection per cost among the rows that the rules before leave (ties: the
    cheaper one, then the given order)."""
    left, rows, out = list(range(len(estimates))), list(sets), []
    while left:
        best = min(left, key=lambda k: (
            -sum(n for s, n in rows if s >> k & 1) / estimates[k].cost, estimates[k].cost, k))
        left.remove(best)
        rows = [(s, n) for s, n in rows if not s >> best & 1]
        out.append(estimates[best].name)
    return out


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The name of the first rule in ``order`` that rejects, else null. CASE evaluates a
    condition only where all before it are not true."""
    out = F.when(rules[order[0]], F.lit(order[0]))
    for name in order[1:]:
        out = out.when(rules[name], F.lit(name))
    return out


def judge(docs: DataFrame, rules: dict[str, Column] | None = None, columns=("text",),
          verdict: str = "rejected_by") -> DataFrame:
    """``docs`` with the rejecting rule (null: kept). ``columns`` are what the rules read."""
    rules = default_rules() if rules is None else rules
    return docs.withColumn(verdict, cascade(rules, in_order(*estimate(docs, rules, columns))))


def passing(docs: DataFrame, rules: dict[str, Column] | None = None, columns=("text",)) -> DataFrame:
    """The rows that no rule rejects, with their columns."""
    rules = default_rules() if rules is None else rules
    return docs.where(cascade(rules, in_order(*estimate(docs, rules, columns))).isNull())


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = in_order(*estimate(docs, default_rules()))
    out = measures(docs, "doc_id", "text")      # wanted for every row, so the cascade reads them
    known = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words")}
    return out.select(
        "doc_id", *known, "n_dup_lines",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        cascade(default_rules(known=known), order).isNull().alias("kept"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), pos AS (
  SELECT rid, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) > 8
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(words, i, i + 7)) AS c FROM pos
), rep AS (
  SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM win WHERE c > 1
), cov AS (
  SELECT rid, sum(least(8, coalesce(i - p, 8)))::BIGINT AS n FROM rep GROUP BY rid
), m AS (
  SELECT w.*, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(text, '\P{L}', '', 'g')) AS letters,
    len(list_filter(words, lambda x, i: x = words[i + 1])) AS runs,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[ \t]*[•‣◦*-]'))) AS bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS cut
  FROM w LEFT JOIN cov USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 40 * n_symbols > length(text) OR word_chars < 2 * n_words
    OR word_chars > 12 * n_words OR 10 * letters < 6 * word_chars
    OR n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * len(lines)
    OR 100 * runs > 30 * n_words OR 10 * bullets > 9 * len(lines)
    OR 10 * cut > 3 * len(lines)) AS kept
FROM b
"""
