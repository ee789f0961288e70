"""Text operators over post tables: cleaning stages and daily term counts
(X6-X8, X16, A13, A14; pipeline P5).

The reference builds one word cloud per day by concatenating the day's texts
and re-reading the whole table for every day. Here all days are one job:
tokenise each post (native regex, no UDF), explode, count per (day, term)
with a partial aggregate, and keep the top ``n`` per day with
``row_number() <= n`` (planned as a partial ``WindowGroupLimit``, so each
map task forwards at most ``n`` terms per day). A day holding a third of all
posts is spread over many map tasks and arrives pre-counted.

Exclusions work per post: phrases by plain substring replace, then words
as whole tokens. Whole-word removal followed by tokenisation equals dropping
the tokens equal to a word, which needs no look-around regex. (Replacing
phrases in the concatenated day text, as the reference does, could also
cut a phrase spanning two posts; per post it cannot.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import reliable_checkpoint
from ..sources.tables import require_columns
from .lemmas import apply_known, apply_lemma_table, known_lemmas

# Phrases and words the reference removes before its daily term
# counts (already lower case).
EXCLUDED_PHRASES = ("gabriel boric", "presidente boric")
EXCLUDED_WORDS = ("boric", "gabriel", "presidente", "chile", "gobierno")


def with_non_null(df: DataFrame, value, out: str) -> DataFrame:
    """Set ``out`` to ``value`` and keep only rows where it is not null.

    A plain ``withColumn(...).where(out IS NOT NULL)`` lets the optimizer
    push the filter below the projection, which evaluates a long cleaning
    expression twice; exploding a one-element array filtered to non-null
    values evaluates it once and yields no row for a null.
    """
    keep = [F.col(c) for c in df.columns if c != out]
    return df.select(*keep, F.explode(F.filter(F.array(value), lambda x: x.isNotNull())).alias(out))


def clean_posts(df: DataFrame, col: str = "text", out: str | None = None, stop=None,
                lemmas: dict | DataFrame | None = None, lo: int = 3, hi: int = 50) -> DataFrame:
    """X6 + X18 as a table step: clean ``col`` and drop rows whose cleaned
    text is null (too short, too long, or null input). ``lemmas`` is a (token, lemma)
    table of any size, or a literal map for a handful."""
    out = out or col
    if isinstance(lemmas, DataFrame):
        # a lemma takes one word's place: the bounds hold before as after
        words = with_non_null(df, T.post_words(col, stop), "_words").where(F.size("_words").between(lo, hi))
        words = apply_lemma_table(words.drop(out), "_words", lemmas)
        return with_non_null(words, T.bounded_join(F.col("_words"), lo, hi), out).drop("_words")
    return with_non_null(df, T.clean_post_text(col, stop=stop, lemmas=lemmas, lo=lo, hi=hi), out)


# So many tokens whose lemma is dropped are looked for before the lemmas; with more of them all
# long texts go to the lemma table.
DROPPED_TOKENS = 20_000


def _may_fit(words: str, known: DataFrame, stop, lo: int, hi: int):
    """Whether a text may keep ``lo`` to ``hi`` words after its lemmas, told before them. Words only
    go, so one that is too short stays so; a word stays for certain if neither it nor its lemma
    is dropped, so one with more than ``hi`` such words is too long."""
    fits = F.size(words) >= lo
    gone = known.where(T.topic_dropped(F.col("lemma"), stop)).select("token").limit(DROPPED_TOKENS + 1).collect()
    if len(gone) > DROPPED_TOKENS:
        return fits
    stays = T.drop_words(T.topic_kept(F.col(words), stop), [r.token for r in gone])
    return fits & (F.size(stays) <= hi)


def clean_topic_posts(df: DataFrame, col: str = "text", out: str = "clean_text", stop=None,
                      lemmas: dict | DataFrame | None = None, lo: int = 3, hi: int = 50,
                      strip: bool = True) -> DataFrame:
    """X7 then X8: topic cleaning, article removal, rows without text dropped.

    Cleaned text is lower-case words separated by single spaces, so X8's
    whole-word removal is a token filter inside the cleaning (no second
    regex pass over the text). ``lemmas`` as in ``clean_posts``."""
    articles = T.ARTICLES if strip else ()
    if isinstance(lemmas, DataFrame):
        known = known_lemmas(lemmas)
        words = with_non_null(df, T.topic_words(col), "_words").where(_may_fit("_words", known, stop, lo, hi))
        words = apply_known(words.drop(out), "_words", known)
        return with_non_null(words, T.topic_text_of(F.col("_words"), stop, lo, hi, articles), out).drop("_words")
    c = T.clean_topic_text(col, stop=stop, lemmas=lemmas, lo=lo, hi=hi, articles=articles)
    return with_non_null(df, c, out)


def term_tokens(text_col, phrases=EXCLUDED_PHRASES, words=EXCLUDED_WORDS, stop=(),
                min_len: int = 2):
    """Tokens of one post after the exclusions (X16), 2+ characters."""
    t = F.col(text_col) if isinstance(text_col, str) else text_col
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(""))
    toks = T.tokens(t, min_len=min_len)
    drop = tuple(words) + tuple(stop)
    return T.drop_words(toks, drop) if drop else toks


def _top_per_day(counts: DataFrame, term: str, n: int, keys=()) -> DataFrame:
    w = Window.partitionBy(*keys, "date").orderBy(F.col("count").desc(), F.col(term))
    top = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    # the day's maximum is the rank-1 count, already in the kept rows
    peak = F.max("count").over(Window.partitionBy(*keys, "date"))
    return top.withColumn("weight", F.col("count") / peak).drop("_rn")


def daily_top_terms(df: DataFrame, text: str = "text", ts: str = "createdAt", n: int = 200,
                    phrases=EXCLUDED_PHRASES, words=EXCLUDED_WORDS, stop=(),
                    keys=()) -> DataFrame:
    """Per day, the ``n`` most frequent terms with their count and
    weight (count / the day's top count); ties by term."""
    require_columns(df, [text, ts, *keys])
    base = df.where(F.col(ts).isNotNull() & F.col(text).isNotNull()).select(
        *keys, F.to_date(F.col(ts)).alias("date"),
        F.explode(term_tokens(text, phrases, words, stop)).alias("term"))
    counts = base.groupBy(*keys, "date", "term").agg(F.count(F.lit(1)).alias("count"))
    return _top_per_day(counts, "term", n, keys)


def daily_top_bigrams(df: DataFrame, text: str = "text", ts: str = "createdAt", n: int = 200,
                      min_count: int = 2, phrases=EXCLUDED_PHRASES, words=EXCLUDED_WORDS,
                      stop=(), keys=()) -> DataFrame:
    """Per day, the ``n`` most frequent adjacent token pairs (within one
    post, after exclusions) seen at least ``min_count`` times."""
    require_columns(df, [text, ts, *keys])
    toks = term_tokens(text, phrases, words, stop)
    base = df.where(F.col(ts).isNotNull() & F.col(text).isNotNull()).select(
        *keys, F.to_date(F.col(ts)).alias("date"),
        F.explode(T.ngrams(toks, 2)).alias("bigram"))
    counts = (base.groupBy(*keys, "date", "bigram").agg(F.count(F.lit(1)).alias("count"))
              .where(F.col("count") >= min_count))
    return _top_per_day(counts, "bigram", n, keys)


# Fixed value: the log-likelihood ratio from which an adjacent pair counts as a phrase.
COLLOCATION = 30.0


def log_likelihood_ratio(pair, first, second, total):
    """Dunning's statistic for an adjacent pair: how much better two rates of the second word
    (after the first word, and elsewhere) explain the counts than one. 0 where one word is
    all there is. Rates are kept 1e-10 away from 0 and 1."""
    c12, c1, c2, n = (F.col(c).cast("double") for c in (pair, first, second, total))

    def log_of(k, m, rate):
        least = F.lit(1e-10)
        return F.log(F.greatest(rate, least)) * k + F.log(F.greatest(1 - rate, least)) * (m - k)

    one, after, other = c2 / n, c12 / c1, (c2 - c12) / (n - c1)
    value = -2 * (log_of(c12, c1, one) + log_of(c2 - c12, n - c1, one)
                  - log_of(c12, c1, after) - log_of(c2 - c12, n - c1, other))
    return F.when((n <= c1) | (n <= c2), F.lit(0.0)).otherwise(value)


def _stem(word: str, same=()):
    """``word`` without its last letter where it ends in one s, else ``word``. A stem and the stem
    with an s are all that can fold into one, so counts by stem hold a word and its plural.
    Where one of the ``same`` columns is null nothing folds."""
    plural = F.col(word).endswith("s") & ~F.col(word).endswith("ss")
    for c in same:
        plural = plural & F.col(c).isNotNull()
    return F.when(plural, F.expr(f"left(`{word}`, char_length(`{word}`) - 1)")).otherwise(F.col(word))


def _folded(stem: str, known: str):
    """The word that a stem stands for: itself where it is counted too, else its plural."""
    return F.when(F.col(known), F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("s")))


def daily_term_cloud(df: DataFrame, text: str = "text", ts: str = "createdAt", n: int = 200,
                     phrases=EXCLUDED_PHRASES, words=EXCLUDED_WORDS, stop=(), keys=(),
                     threshold: float = COLLOCATION) -> DataFrame:
    """A13 with A14 as the reference's word cloud counts them: per day, words with plurals
    folded into a singular of that day, and adjacent pairs (within a post, folded by their
    second word) whose log-likelihood ratio passes ``threshold`` as terms of their own. The
    occurrences of such pairs are taken off their words; words left with nothing go. The ``n``
    most frequent terms with their weight (count / the day's top count); ties by term.

    A word and its plural have one stem and are counted together, so nothing is joined to fold
    them. Everything after the two counts works on one row per (day, stem) or (day, pair)."""
    require_columns(df, [text, ts, *keys])
    day = [*keys, "date"]
    # the posts are cleaned once for both counts
    posts = reliable_checkpoint(df.where(F.col(ts).isNotNull() & F.col(text).isNotNull()).select(
        *keys, F.to_date(F.col(ts)).alias("date"), term_tokens(text, phrases, words, stop).alias("_tokens")))
    counts = (posts.select(*day, F.explode("_tokens").alias("word"))
              .select(*day, _stem("word", keys).alias("_stem"), "word").groupBy(*day, "_stem")
              .agg(F.count(F.lit(1)).alias("count"), F.bool_or(F.col("word") == F.col("_stem")).alias("_known")))
    counts = reliable_checkpoint(counts.select(*day, "_stem", _folded("_stem", "_known").alias("term"), "count"))
    singles = counts.drop("_stem")
    totals = counts.groupBy(*day).agg(F.sum("count").alias("_total"))

    pairs = posts.select(*day, F.explode(F.arrays_zip(
        F.slice("_tokens", 1, F.greatest(F.size("_tokens") - 1, F.lit(0))).alias("w1"),
        F.slice("_tokens", 2, F.greatest(F.size("_tokens") - 1, F.lit(0))).alias("w2"))).alias("_p"))
    pairs = (pairs.select(*day, "_p.w1", "_p.w2").select(*day, "w1", _stem("w2", keys).alias("w2_stem"), "w2")
             .groupBy(*day, "w1", "w2_stem")
             .agg(F.count(F.lit(1)).alias("count"), F.bool_or(F.col("w2") == F.col("w2_stem")).alias("_known")))
    pairs = pairs.select(*day, "w1", _stem("w1", keys).alias("w1_stem"), "w2_stem",
                         _folded("w2_stem", "_known").alias("w2"), "count")
    for w in ("w1", "w2"):
        of = counts.select(*day, F.col("_stem").alias(f"{w}_stem"), F.col("term").alias(f"{w}_std"),
                           F.col("count").alias(f"{w}_n"))
        pairs = pairs.join(of, [*day, f"{w}_stem"])
    found = pairs.join(totals, day).where(log_likelihood_ratio("count", "w1_n", "w2_n", "_total") > threshold)
    found = reliable_checkpoint(found.select(*day, F.concat_ws(" ", "w1", "w2").alias("term"), "count", "w1_std", "w2_std"))
    taken = (found.select(*day, F.explode(F.array("w1_std", "w2_std")).alias("term"), "count")
             .groupBy(*day, "term").agg(F.sum("count").alias("_taken")))
    left = (singles.join(taken, [*day, "term"], "left")
            .withColumn("count", F.col("count") - F.coalesce("_taken", F.lit(0))).where("count > 0").drop("_taken"))
    return _top_per_day(left.unionByName(found.select(*day, "term", "count")), "term", n, keys)


def pending_top_terms(df: DataFrame, done_days: DataFrame, start=None, text: str = "text",
                      ts: str = "createdAt", **kw) -> DataFrame:
    """P5: daily terms only for days not yet produced (S7 then A13). The
    produced days are one row per day, so the anti-join is against a small
    table (AQE broadcasts it); posts before ``start`` are left out."""
    day = F.to_date(F.col(ts))
    base = df.where(day >= F.lit(start).cast("date")) if start is not None else df
    done = done_days.select(F.col("date").alias("_done"))
    base = base.join(done, day == F.col("_done"), "left_anti")
    return daily_top_terms(base, text=text, ts=ts, **kw)
