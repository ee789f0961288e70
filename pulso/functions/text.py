"""Text cleaning and tokenisation as native column expressions.

No Python UDF: every step is ``lower`` / ``regexp_replace`` / ``split`` /
higher-order array functions, so cleaning runs inside whole-stage codegen.

Regex portability: Python's ``\\w`` is exactly ``[\\p{L}\\p{N}_]``; Java's
``\\w`` is ASCII-only, so the class is written out. Python's ``\\s`` also
covers U+000B, U+001C-001F, U+0085, U+00A0, U+1680, U+2000-200A, U+2028/2029,
U+202F, U+205F and U+3000, which are listed explicitly for the same reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.stopwords import post_stopwords, topic_stopwords

WORD = r"\p{L}\p{N}_"
SPACE = (r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# A URL ends at any white space of SPACE (Java's and RE2's \S know ASCII only).
URL = rf"http[^{SPACE}]+|www[^{SPACE}]+"
MENTION = rf"@[{WORD}]+"
HASHTAG = rf"#[{WORD}]+"
TOKEN = rf"[{WORD}]+"

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_space(c: ColumnOrName) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_c(c), f"[{SPACE}]+", " "))


def words_of(c: ColumnOrName) -> Column:
    """Split normalised text on single spaces; '' gives an empty array.

    The input is referenced once (a filter instead of a ``when`` on the text),
    so a long cleaning chain is not duplicated in the expression tree.
    """
    return F.filter(F.split(_c(c), " "), lambda x: x != "")


def split_words(c: ColumnOrName) -> Column:
    """Words of raw text: split on whitespace runs, empty pieces dropped.
    Equal to ``words_of(normalise_space(c))`` with one regex pass less."""
    return F.filter(F.split(_c(c), f"[{SPACE}]+"), lambda x: x != "")


def split_clean(c: ColumnOrName) -> Column:
    """``split_words`` of text that holds word characters and white space only. A letter is found
    to be one at the first look, to be no white space at the last of a dozen."""
    return F.filter(F.split(_c(c), f"[^{WORD}]+"), lambda x: x != "")


def drop_words(arr: Column, words) -> Column:
    """Remove array elements that are in ``words`` (a literal list).

    ``isin`` with many literals is rewritten by the optimizer to a hash-set
    lookup (``InSet``), so the cost per token does not grow with the list.
    """
    words = list(words)
    if not words:
        return arr
    return F.filter(arr, lambda x: ~x.isin(*words))


def apply_lemmas(arr: Column, lemmas: dict | None) -> Column:
    """Optional token -> lemma lookup (a literal map; unknown tokens stay)."""
    if not lemmas:
        return arr
    m = F.create_map(*[x for k, v in lemmas.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(arr, lambda x: F.coalesce(F.try_element_at(m, x), x))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda binding via a
    one-element array), instead of repeating the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounded_join(arr: Column, lo: int, hi: int, drop=()) -> Column:
    """Join words with spaces when lo <= count <= hi, else null; ``drop``
    words are removed after the count (as article removal follows cleaning)."""
    drop = list(drop)

    def body(a):
        kept = F.filter(a, lambda x: ~x.isin(*drop)) if drop else a
        return F.when(F.size(a).between(lo, hi), F.array_join(kept, " "))
    return let(arr, body)


def post_words(c: ColumnOrName, stop=None) -> Column:
    """X6 up to the lemmas: lower, drop URLs, mentions and non-word characters (``#`` goes, the
    hashtag word stays), words without stop words."""
    stop = post_stopwords() if stop is None else stop
    t = F.lower(_c(c))
    t = F.regexp_replace(t, URL, "")
    t = F.regexp_replace(t, MENTION, "")
    t = F.regexp_replace(t, f"[^{WORD}{SPACE}áéíóúñü]", "")
    return drop_words(split_clean(t), stop)


def clean_post_text(c: ColumnOrName, stop=None, lemmas: dict | None = None,
                    lo: int = 3, hi: int = 50) -> Column:
    """``post_words``, optional lemmas, keep 3..50 words (inclusive) else null.
    Null in -> null out (X18)."""
    return bounded_join(apply_lemmas(post_words(c, stop), lemmas), lo, hi)


def topic_words(c: ColumnOrName) -> Column:
    """X7 up to the lemmas: as X6 but whole hashtags go and no stop word does."""
    t = F.lower(_c(c))
    t = F.regexp_replace(t, URL, "")
    t = F.regexp_replace(t, MENTION, "")
    t = F.regexp_replace(t, HASHTAG, "")
    t = F.regexp_replace(t, f"[^{WORD}{SPACE}áéíóúñü]", "")
    return split_clean(t)


DIGITS = r"^\p{Nd}+$"


def topic_dropped(word: Column, stop=None) -> Column:
    """Whether X7 drops a word after the lemmas: stop words and all-digit tokens."""
    stop = topic_stopwords() if stop is None else stop
    digits = word.rlike(DIGITS)
    return word.isin(*stop) | digits if stop else digits


def topic_kept(words: Column, stop=None) -> Column:
    """The words of an array that X7 keeps after the lemmas."""
    stop = topic_stopwords() if stop is None else stop
    return F.filter(drop_words(words, stop), lambda x: ~x.rlike(DIGITS))


def topic_text_of(words: Column, stop=None, lo: int = 3, hi: int = 50, articles=()) -> Column:
    """X7 from the lemmas on: stop words and all-digit tokens go, then the bounds."""
    return bounded_join(topic_kept(words, stop), lo, hi, drop=articles)


def clean_topic_text(c: ColumnOrName, stop=None, lemmas: dict | None = None,
                     lo: int = 3, hi: int = 50, articles=()) -> Column:
    """As X6 but whole hashtags go, the topic stop list (with verbs)
    applies after lemmas, and all-digit tokens are dropped. Emoji, variation
    selectors and joiners are not word characters, so the non-word pass
    removes them. ``articles`` are then removed as whole lower-case words
    after the bounds (X8 on cleaned text, see ``strip_articles``)."""
    return topic_text_of(apply_lemmas(topic_words(c), lemmas), stop, lo, hi, articles)


# The articles removed before topic modelling.
ARTICLES = ("él", "el")


def strip_articles(c: ColumnOrName, articles=ARTICLES) -> Column:
    """Remove the whole words él / el in any case, collapse spaces, trim."""
    alt = "|".join(articles)
    pat = f"(?iu)(?<![{WORD}])({alt})(?![{WORD}])"
    return normalise_space(F.regexp_replace(_c(c), pat, ""))


def tokens(c: ColumnOrName, min_len: int = 1) -> Column:
    """Maximal runs of word characters (``[\\p{L}\\p{N}_]+``), in order."""
    arr = F.regexp_extract_all(_c(c), F.lit(TOKEN), 0)
    if min_len > 1:
        arr = F.filter(arr, lambda x: F.char_length(x) >= min_len)
    return arr


def ngrams(arr: ColumnOrName, n: int) -> Column:
    """Space-joined n-grams of a token array ([] when shorter than n)."""
    if n == 1:
        return _c(arr)

    def body(a):
        return F.when(F.size(a) >= n, F.transform(
            F.sequence(F.lit(1), F.size(a) - n + 1),
            lambda i: F.array_join(F.slice(a, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return let(_c(arr), body)


def ngrams_upto(arr: ColumnOrName, n: int) -> Column:
    """All 1..n-grams of a token array (the array is evaluated once)."""
    return let(_c(arr), lambda a: F.flatten(F.array(*[ngrams(a, k) for k in range(1, n + 1)])))

