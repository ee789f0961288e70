"""Sentiment column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("Negative", "Neutral", "Positive")


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def classify_sentiment(pos="score_positive", neg="score_negative", neu="score_neutral",
                       ties: str = "neutral") -> Column:
    """Class of the largest score: ``positive`` / ``negative`` / ``neutral``.

    A shared maximum is a tie: ``ties="neutral"`` labels it ``neutral`` (the
    tested function), ``ties="drop"`` labels it ``tie`` so that the daily
    counts leave it out (the metrics job). Null scores give null.
    """
    p, n, u = _c(pos), _c(neg), _c(neu)
    m = F.greatest(p, n, u)
    hits = (p == m).cast("int") + (n == m).cast("int") + (u == m).cast("int")
    tie = F.lit("neutral" if ties == "neutral" else "tie")
    return (F.when(p.isNull() | n.isNull() | u.isNull(), F.lit(None).cast("string"))
            .when(hits > 1, tie)
            .when(p == m, "positive").when(n == m, "negative").otherwise("neutral"))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (see ``text.let``)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(logits: Column) -> Column:
    """Numerically stable softmax of an array column (input evaluated once)."""
    def body(x):
        mx = F.array_max(x)
        return _let(F.transform(x, lambda v: F.exp(v - mx)),
                    lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0),
                                                                       lambda a, y: a + y)))
    return _let(logits, body)


def softmax_label(logits: Column, text: Column | None = None, labels=LABELS) -> Column:
    """X10 + X11: struct(sentiment_label, score_label, score_negative,
    score_neutral, score_positive) from three logits; the first maximum wins.
    Blank or null text (or null logits) gives ("Neutral", 0, 0, 0, 0).
    The logits and probabilities are each evaluated once."""
    names = F.array(*[F.lit(x) for x in labels])

    def scored(p):
        top = F.array_max(p)
        return F.struct(F.element_at(names, F.array_position(p, top).cast("int"))
                        .alias("sentiment_label"), top.alias("score_label"),
                        p[0].alias("score_negative"), p[1].alias("score_neutral"),
                        p[2].alias("score_positive"))

    empty = F.struct(F.lit("Neutral").alias("sentiment_label"), F.lit(0.0).alias("score_label"),
                     F.lit(0.0).alias("score_negative"), F.lit(0.0).alias("score_neutral"),
                     F.lit(0.0).alias("score_positive"))
    out = _let(logits.cast("array<double>"),
               lambda lg: F.when(lg.isNull(), empty).otherwise(_let(softmax(lg), scored)))
    if text is not None:
        out = F.when(text.isNull() | (F.trim(text) == ""), empty).otherwise(out)
    return out


def lexicon_sentiment(df, lexicon, text: str = "text"):
    """M1 (lexicon scorer): sum the (negative, neutral, positive) logits of
    the lower-cased tokens of ``text`` found in ``lexicon`` (word, neg, neu,
    pos), then X10/X11. Unknown words add 0; a word listed twice counts for each
    of its rows; blank text is Neutral with zero scores. Returns ``df`` with the
    five sentiment columns added, row for row (ids may repeat).

    One plan for lexicons of every size: the tokens of each text join the
    lexicon (broadcast if AQE finds it small), and the summed logits are joined back.
    """
    from ..operators.per_text import TEXT_KEY, score_texts
    from .text import tokens

    def score(words):
        known = lexicon.groupBy("word").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in ("neg", "neu", "pos")])
        # equal texts have equal words at equal places: each place counts once
        hits = (words.join(known, "word").groupBy(TEXT_KEY, "_pos")
                .agg(*[F.first(c).alias(c) for c in ("neg", "neu", "pos")]))
        logits = F.array(*[F.round(F.sum(c), 9) for c in ("neg", "neu", "pos")])
        return hits.groupBy(TEXT_KEY).agg(logits.alias("_logits"))

    j = score_texts(df, text, tokens(F.lower(F.col(text))), "word", score)
    zero = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    scored = j.withColumn("_s", softmax_label(F.coalesce("_logits", zero), F.col(text)))
    return scored.drop("_logits").select("*", "_s.*").drop("_s")
