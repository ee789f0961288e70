"""DuckDB expressions equal to the Spark text functions, for the oracles.

RE2 (DuckDB) has no look-around; where Spark uses it the oracle uses an
equivalent without it (token filters, or a replace repeated to a fixpoint).
"""

from __future__ import annotations

from ..functions import text as T
from ..sources.stopwords import post_stopwords, topic_stopwords


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def rx(expr: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({expr}, {q(pat)}, {q(rep)}, 'g')"


def normalise_space(expr: str) -> str:
    return f"trim({rx(expr, f'[{T.SPACE}]+', ' ')})"


def words_of(expr: str) -> str:
    return f"(CASE WHEN {expr} = '' THEN []::VARCHAR[] ELSE string_split({expr}, ' ') END)"


def drop_words(arr: str, words) -> str:
    return f"list_filter({arr}, lambda x: NOT list_contains({str_list(words)}, x))"


def bounded_join(arr: str, lo: int, hi: int) -> str:
    return f"(CASE WHEN len({arr}) BETWEEN {lo} AND {hi} THEN array_to_string({arr}, ' ') END)"


def post_words(expr: str, stop=None) -> str:
    """The words of ``clean_post_text`` before the lemmas."""
    stop = post_stopwords() if stop is None else stop
    t = rx(rx(f"lower({expr})", T.URL), T.MENTION)
    t = rx(t, f"[^{T.WORD}{T.SPACE}áéíóúñü]")
    return drop_words(words_of(normalise_space(t)), stop)


def topic_words(expr: str) -> str:
    """The words of ``clean_topic_text`` before the lemmas."""
    t = f"lower({expr})"
    for pat in (T.URL, T.MENTION, T.HASHTAG, f"[^{T.WORD}{T.SPACE}áéíóúñü]"):
        t = rx(t, pat)
    return words_of(normalise_space(t))


def lemmatised(words: str, src: str, keep: str = "true", lo: int = 3, hi: int = 50) -> str:
    """(id, text): the words of ``src`` with the lemmas of the CTE ``lemmas``, those that
    ``keep`` (over ``w``) holds for, joined again in order."""
    return (f"SELECT id, array_to_string(list(w ORDER BY pos), ' ') AS text FROM ("
            f"SELECT o.id, o.pos, coalesce(l.lemma, o.token) AS w FROM ("
            f"SELECT id, unnest(ws) AS token, unnest(range(0, len(ws))) AS pos FROM ("
            f"SELECT id, {words} AS ws FROM {src}) a) o LEFT JOIN lemmas l USING (token)) b "
            f"WHERE {keep} GROUP BY id HAVING count(*) BETWEEN {lo} AND {hi}")


def clean_post_text(expr: str, stop=None, lo: int = 3, hi: int = 50) -> str:
    stop = post_stopwords() if stop is None else stop
    t = f"lower({expr})"
    t = rx(t, T.URL)
    t = rx(t, T.MENTION)
    t = rx(t, f"[^{T.WORD}{T.SPACE}áéíóúñü]")
    arr = words_of(normalise_space(t))
    if stop:
        arr = drop_words(arr, stop)
    return bounded_join(arr, lo, hi)


def clean_topic_text(expr: str, stop=None, lo: int = 3, hi: int = 50) -> str:
    stop = topic_stopwords() if stop is None else stop
    t = f"lower({expr})"
    for pat in (T.URL, T.MENTION, T.HASHTAG, f"[^{T.WORD}{T.SPACE}áéíóúñü]"):
        t = rx(t, pat)
    arr = words_of(normalise_space(t))
    if stop:
        arr = drop_words(arr, stop)
    arr = f"list_filter({arr}, lambda x: NOT regexp_full_match(x, '\\p{{Nd}}+'))"
    return bounded_join(arr, lo, hi)


def strip_articles(expr: str, articles=("él", "el"), passes: int = 3) -> str:
    alt = "|".join(articles)
    pat = f"(^|[^{T.WORD}])({alt})([^{T.WORD}]|$)"
    t = expr
    for _ in range(passes):
        t = f"regexp_replace({t}, {q(pat)}, '\\1\\3', 'gi')"
    return normalise_space(t)


def term_tokens(expr: str, phrases, words, stop=(), min_len: int = 2) -> str:
    t = expr
    for p in phrases:
        t = f"replace({t}, {q(p)}, '')"
    arr = f"regexp_extract_all({t}, {q(T.TOKEN)})"
    arr = f"list_filter({arr}, lambda x: length(x) >= {min_len})"
    drop = tuple(words) + tuple(stop)
    return drop_words(arr, drop) if drop else arr
