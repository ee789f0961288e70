"""Catalogue: text cleaning (X6-X8) and daily term counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import terms as TM
from ..sources import fixtures as fx
from ..sources.stopwords import topic_stopwords
from . import sql_text as S
from .registry import r, r_col, register, with_ctes


@register("clean_posts", lambda: with_ctes(
    "SELECT id, clean AS text FROM (SELECT id, " + S.clean_post_text("text")
    + " AS clean FROM tp) x WHERE clean IS NOT NULL", tp=fx.SQL_TEXT_POSTS), headline=True)
def q_clean_posts(spark, d):
    return TM.clean_posts(fx.text_posts(spark, d)).select("id", "text")


@register("clean_topic_text", lambda: with_ctes(
    "SELECT id, clean AS clean_text FROM (SELECT id, " + S.clean_topic_text("text")
    + " AS clean FROM tp) x WHERE clean IS NOT NULL", tp=fx.SQL_TEXT_POSTS))
def q_clean_topic_text(spark, d):
    out = TM.clean_topic_posts(fx.text_posts(spark, d), strip=False)
    return out.select("id", "clean_text")


@register("clean_posts_lemmas", lambda: with_ctes(
    S.lemmatised(S.post_words("text"), "tp"), tp=fx.SQL_TEXT_POSTS, lemmas=fx.SQL_LEMMAS))
def q_clean_posts_lemmas(spark, d):
    posts = fx.text_posts(spark, d).select("id", "text")       # what the query asks for is all that is written
    return TM.clean_posts(posts, lemmas=fx.lemmas(spark, d)).select("id", "text")


@register("clean_topic_lemmas", lambda: with_ctes(
    S.lemmatised(S.topic_words("text"), "tp",
                 f"NOT list_contains({S.str_list(topic_stopwords())}, w) AND NOT regexp_full_match(w, '\\p{{Nd}}+')"
                 ).replace("AS text", "AS clean_text"), tp=fx.SQL_TEXT_POSTS, lemmas=fx.SQL_LEMMAS))
def q_clean_topic_lemmas(spark, d):
    posts = fx.text_posts(spark, d).select("id", F.col("text").alias("clean_text"))
    out = TM.clean_topic_posts(posts, col="clean_text", lemmas=fx.lemmas(spark, d), strip=False)
    return out.select("id", "clean_text")


@register("strip_articles", lambda: with_ctes(
    "SELECT id, " + S.strip_articles("text") + " AS text FROM tp",
    tp=fx.SQL_TEXT_POSTS))
def q_strip_articles(spark, d):
    tp = fx.text_posts(spark, d)
    return tp.select("id", T.strip_articles("text").alias("text"))


# Exclusions for the test tables (words frequent in their text).
FIXTURE_PHRASES = ("of the", "in the")
FIXTURE_WORDS = ("the", "der", "die")


def _sql_terms(kind: str, pending: bool = False) -> str:
    toks = S.term_tokens("text", FIXTURE_PHRASES, FIXTURE_WORDS)
    if kind == "term":
        unit = f"unnest({toks}) AS term"
        having = ""
    else:
        unit = (f"unnest(list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])) "
                f"AS bigram")
        having = " HAVING count(*) >= 2"
    src = (f"SELECT CAST(createdAt AS DATE) AS date, {unit} FROM cp"
           if kind == "term" else
           f"SELECT date, {unit} FROM (SELECT CAST(createdAt AS DATE) AS date, {toks} AS tk FROM cp) y")
    return with_ctes(
        f"SELECT date, {kind}, count, {r('CAST(count AS DOUBLE) / max(count) OVER (PARTITION BY date)')}"
        f" AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY count DESC, {kind})"
        f" AS rn FROM c) z WHERE rn <= 200",
        tp=fx.SQL_TEXT_POSTS,
        **({"done": SQL_DONE_DAYS} if pending else {}),
        cp="SELECT createdAt, clean AS text FROM (SELECT createdAt, " + S.clean_post_text("text")
           + " AS clean FROM tp) x WHERE clean IS NOT NULL"
           + (" AND CAST(createdAt AS DATE) NOT IN (SELECT date FROM done)" if pending else ""),
        t=src,
        c=f"SELECT date, {kind}, count(*) AS count FROM t GROUP BY date, {kind}{having}")


@register("daily_top_terms", lambda: _sql_terms("term"), headline=True)
def q_daily_top_terms(spark, d):
    cp = TM.clean_posts(fx.text_posts(spark, d))
    out = TM.daily_top_terms(cp, phrases=FIXTURE_PHRASES, words=FIXTURE_WORDS)
    return out.withColumn("weight", r_col(F.col("weight"), 6))


@register("daily_top_bigrams", lambda: _sql_terms("bigram"))
def q_daily_top_bigrams(spark, d):
    cp = TM.clean_posts(fx.text_posts(spark, d))
    out = TM.daily_top_bigrams(cp, phrases=FIXTURE_PHRASES, words=FIXTURE_WORDS, min_count=2)
    return out.withColumn("weight", r_col(F.col("weight"), 6))


def _sql_term_cloud() -> str:
    def fold(src, word, same):
        on = " AND ".join(f"b.{c} = a.{c}" for c in same)
        short = (f"CASE WHEN {word} LIKE '%s' AND {word} NOT LIKE '%ss' "
                 f"THEN left({word}, length({word}) - 1) END")
        return (f"SELECT a.* EXCLUDE (short), coalesce(b.{word}, a.{word}) AS std FROM "
                f"(SELECT *, {short} AS short FROM {src}) a LEFT JOIN {src} b ON {on} AND b.{word} = a.short")

    def log_of(k, m, rate):
        return f"(ln(greatest({rate}, 1e-10)) * ({k}) + ln(greatest(1 - {rate}, 1e-10)) * (({m}) - ({k})))"

    one, after, other = "(c2 / n)", "(c12 / c1)", "((c2 - c12) / (n - c1))"
    ratio = (f"CASE WHEN n <= c1 OR n <= c2 THEN 0 ELSE -2 * ({log_of('c12', 'c1', one)} + "
             f"{log_of('c2 - c12', 'n - c1', one)} - {log_of('c12', 'c1', after)} - "
             f"{log_of('c2 - c12', 'n - c1', other)}) END")
    return with_ctes(
        f"SELECT date, term, count, {r('CAST(count AS DOUBLE) / max(count) OVER (PARTITION BY date)')} AS weight "
        "FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY count DESC, term) AS rn FROM cloud) z "
        "WHERE rn <= 200",
        tp=fx.SQL_TEXT_POSTS,
        cp="SELECT createdAt, clean AS text FROM (SELECT createdAt, " + S.clean_post_text("text")
           + " AS clean FROM tp) x WHERE clean IS NOT NULL",
        tk="SELECT CAST(createdAt AS DATE) AS date, " + S.term_tokens("text", FIXTURE_PHRASES, FIXTURE_WORDS)
           + " AS tk FROM cp",
        c="SELECT date, word, count(*) AS count FROM (SELECT date, unnest(tk) AS word FROM tk) q GROUP BY ALL",
        folded=fold("c", "word", ["date"]),
        # joins on one key of day and word: on the day alone they would be cross joins
        wk="SELECT date || '|' || word AS k, std, "
           "sum(count) OVER (PARTITION BY date, std) AS c, sum(count) OVER (PARTITION BY date) AS n FROM folded",
        singles="SELECT date, std AS term, sum(count)::BIGINT AS count FROM folded GROUP BY date, std",
        pr="SELECT date, tk[i] AS w1, tk[i + 1] AS w2, count(*) AS count FROM (SELECT date, tk, "
           "unnest(range(1, len(tk))) AS i FROM tk) q GROUP BY ALL",
        pf=fold("pr", "w2", ["date", "w1"]),
        ps="SELECT date, w1, std AS w2, sum(count)::BIGINT AS count FROM pf GROUP BY date, w1, std",
        sc="SELECT ps.date, ps.w1 || ' ' || ps.w2 AS term, ps.count, a.std AS s1, b.std AS s2, "
           "CAST(ps.count AS DOUBLE) AS c12, CAST(a.c AS DOUBLE) AS c1, CAST(b.c AS DOUBLE) AS c2, "
           "CAST(a.n AS DOUBLE) AS n FROM ps JOIN wk a ON a.k = ps.date || '|' || ps.w1 "
           "JOIN wk b ON b.k = ps.date || '|' || ps.w2",
        found=f"SELECT * FROM sc WHERE {ratio} > {TM.COLLOCATION}",
        taken="SELECT date, term, sum(count) AS n FROM (SELECT date, s1 AS term, count FROM found UNION ALL "
              "SELECT date, s2, count FROM found) q GROUP BY date, term",
        cloud="SELECT s.date, s.term, CAST(s.count - coalesce(t.n, 0) AS BIGINT) AS count FROM singles s "
              "LEFT JOIN taken t ON t.date = s.date AND t.term = s.term WHERE s.count - coalesce(t.n, 0) > 0 "
              "UNION ALL SELECT date, term, count FROM found")


@register("daily_term_cloud", _sql_term_cloud)
def q_daily_term_cloud(spark, d):
    cp = TM.clean_posts(fx.text_posts(spark, d))
    out = TM.daily_term_cloud(cp, phrases=FIXTURE_PHRASES, words=FIXTURE_WORDS)
    return out.withColumn("weight", r_col(F.col("weight"), 6))


SQL_DONE_DAYS = ("SELECT DISTINCT CAST(createdAt AS DATE) AS date FROM tp "
                 "WHERE day(CAST(createdAt AS DATE)) % 3 = 0")


def _sql_pending_terms() -> str:
    return _sql_terms("term", pending=True)


@register("pending_top_terms", _sql_pending_terms)
def q_pending_top_terms(spark, d):
    tp = fx.text_posts(spark, d)
    done = (tp.select(F.to_date("createdAt").alias("date")).distinct()
            .where(F.dayofmonth("date") % 3 == 0))
    cp = TM.clean_posts(tp)
    out = TM.pending_top_terms(cp, done, phrases=FIXTURE_PHRASES, words=FIXTURE_WORDS)
    return out.withColumn("weight", r_col(F.col("weight"), 6))
