"""Harvests over a posts table and reply enrichment (S9, S10, W8, J8; P8).

The reference calls a search service per day, per author-month and per post;
here the same selections run over a stored posts table. Each cap is the
feature itself (newest N per author-month, top k per day, newest 5 replies
per post) and is a ``row_number() <= n`` per group, which Spark plans with a
partial ``WindowGroupLimit`` before the shuffle: a hot group is cut to n
rows inside every map task, so it never arrives whole in one task.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD


def _date(d):
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def top_per_group(df: DataFrame, keys, order: list[Column], n: int) -> DataFrame:
    """Rows ranked 1..n per group by ``order`` (ties broken by the caller)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def month_window_of(day: Column, start) -> Column:
    """Start of the one-month window (stepped from ``start``) holding ``day``.

    ``i = floor(months_between(day, start))`` and a one-step correction at
    month ends; windows are ``[add_months(start, i), add_months(start, i+1))``
    as produced by ``month_windows``. Pure arithmetic, so bucketing posts
    needs no range join.
    """
    s = F.lit(_date(start))
    i = F.floor(F.months_between(day, s)).cast("int")
    i = F.when(F.add_months(s, i + 1) <= day, i + 1).otherwise(i)
    i = F.when(F.add_months(s, i) > day, i - 1).otherwise(i)
    return F.add_months(s, i)


def harvest_author_windows(posts: DataFrame, start, end, n: int = 500,
                           author: str = "author", ts: str = "createdAt",
                           key: str = "id") -> DataFrame:
    """Newest ``n`` posts of each author in each one-month window of
    ``[start, end)`` (windows stepped from ``start``, the last one clamped);
    ``start >= end`` is an error. Adds ``window_start`` / ``window_end``."""
    s, e = _date(start), _date(end)
    if s >= e:
        raise ValueError("harvest windows: start must be before end")
    day = F.to_date(F.col(ts))
    inside = posts.where((day >= F.lit(s)) & (day < F.lit(e)))
    ws = month_window_of(day, s)
    bucketed = inside.withColumns({
        "window_start": ws,
        "window_end": F.least(F.add_months(ws, 1), F.lit(e)),
    })
    return top_per_group(bucketed, [author, "window_start"],
                         [F.col(ts).desc(), F.col(key).desc()], n)


def mention_pattern(terms) -> str:
    """Case-insensitive whole-phrase match of any term (no look-around, so
    the same pattern runs on RE2)."""
    alt = "|".join(re.escape(t.lower()) for t in terms)
    return f"(?i)(^|[^{WORD}])({alt})([^{WORD}]|$)"


def harvest_mentions(posts: DataFrame, terms, lang: str | None = "es", k: int = 30,
                     engagement=("likeCount",), text: str = "text",
                     ts: str = "createdAt", key: str = "id") -> DataFrame:
    """Per day, the top ``k`` posts mentioning any of ``terms`` in
    language ``lang``, ranked by engagement (ties: newest, then id), one row
    per id (the first by rank)."""
    cond = F.col(text).rlike(mention_pattern(terms))
    if lang is not None:
        cond = cond & (F.col("lang") == lang)
    base = posts.where(cond).withColumn("date", F.to_date(F.col(ts)))
    eng = sum((F.coalesce(F.col(c), F.lit(0)) for c in engagement), F.lit(0))
    base = base.withColumn("_eng", eng)
    order = [F.col("_eng").desc(), F.col(ts).desc(), F.col(key)]
    first = top_per_group(base, [key], order, 1)
    return top_per_group(first, ["date"], order, k).drop("_eng")


def latest_replies(replies: DataFrame, n: int = 5, conv: str = "conv_id",
                   ts: str = "createdAt", key: str = "id") -> DataFrame:
    """The newest ``n`` replies of each conversation."""
    return top_per_group(replies, [conv], [F.col(ts).desc(), F.col(key).desc()], n)


def reply_enrichment(replies: DataFrame, parents: DataFrame, conv: str = "conv_id",
                     ts: str = "createdAt", key: str = "id", text: str = "text") -> DataFrame:
    """Attach ``parent_tweet_id``, ``parent_text`` and ``parent_createdAt``
    of the first parent row per conversation (a reply whose parent is not
    present is kept, with nulls: the harvest still returned it).

    Parents are deduplicated by an aggregate (``min_by``), which combines map
    side, then joined on the conversation key; AQE picks broadcast or
    sort-merge from the measured size.
    """
    first = parents.groupBy(F.col(conv).alias("_conv")).agg(
        F.min_by(F.struct(F.col(key).alias("parent_tweet_id"),
                          F.col(text).alias("parent_text"),
                          F.col(ts).alias("parent_createdAt")),
                 F.struct(F.col(ts), F.col(key))).alias("_p"))
    j = replies.join(first, replies[conv] == first["_conv"], "left")
    return j.select(*[replies[c] for c in replies.columns],
                    F.col("_p.parent_tweet_id"), F.col("_p.parent_text"),
                    F.col("_p.parent_createdAt"))


def harvest_with_replies(posts: DataFrame, replies: DataFrame, start, end, n: int = 500,
                         n_replies: int = 5, author: str = "author", conv: str = "conv_id",
                         ts: str = "createdAt", key: str = "id", text: str = "text") -> DataFrame:
    """Author-month windows (S8) -> newest ``n`` posts of each (S9) -> newest
    ``n_replies`` replies of each harvested conversation (W8) -> parent columns (J8).
    The harvest is narrow before it meets the replies: ids, key and text only."""
    parents = harvest_author_windows(posts, start, end, n, author=author, ts=ts, key=key)
    parents = parents.select(conv, key, text, ts)
    wanted = replies.join(parents.select(conv).distinct(), conv, "left_semi")
    newest = latest_replies(wanted, n_replies, conv=conv, ts=ts, key=key)
    return reply_enrichment(newest, parents, conv=conv, ts=ts, key=key, text=text)
