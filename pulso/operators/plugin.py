"""Plug-in point for external per-post models (M1, M2 with a pretrained model).

The reference calls a pretrained classifier post by post. Here an external
model runs inside ``mapInArrow``: ``make_model`` is called once per task
(load weights there, e.g. an ONNX session), and the returned function scores
an Arrow batch of texts at a time. Spark partitions and shuffles the work;
the label and probabilities are then computed natively from the returned
logits (``softmax_label``), so the Python side only produces numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sentiment import softmax_label

# make_model() -> score(texts: pandas.Series) -> array of shape (n, 3) (neg, neu, pos logits)
ModelFactory = Callable[[], Callable]


def external_logits(df: DataFrame, make_model: ModelFactory, text: str = "text",
                    out: str = "logits") -> DataFrame:
    """``df`` with ``out``: the model's three logits per post, computed batch by
    batch in Python workers (Arrow transfer, model loaded once per task). Null
    text gets null logits. All columns stay as they are."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    place = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        score = make_model()
        for batch in batches:
            texts = batch.column(place)
            if batch.num_rows:
                logits = np.asarray(score(texts.fill_null("").to_pandas()), dtype="float64").reshape(-1, 3)
            values = [None if t is None else row.tolist() for t, row in zip(texts.to_pylist(), logits)] \
                if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, out])
    return df.mapInArrow(run, schema)


def external_sentiment(df: DataFrame, make_model: ModelFactory, text: str = "text") -> DataFrame:
    """``df`` with the five sentiment columns from an external model's logits; the
    Python stage only adds the logits, the label is native."""
    scored = external_logits(df, make_model, text=text, out="_logits")
    return (scored.withColumn("_s", softmax_label(F.col("_logits"), F.col(text)))
            .drop("_logits").select("*", "_s.*").drop("_s"))


def lexicon_model(rows) -> ModelFactory:
    """A small example model for the plug-in: summed word logits of a
    lexicon given as ``(word, neg, neu, pos)`` rows (rounded to 9 decimals as
    the native scorer does)."""
    table = {w: (float(a), float(b), float(c)) for w, a, b, c in rows}

    def make():
        import re

        word = re.compile(r"\w+")

        def score(texts):
            out = np.zeros((len(texts), 3))
            for i, t in enumerate(texts):
                acc = [0.0, 0.0, 0.0]
                for tok in word.findall(t.lower()):
                    v = table.get(tok)
                    if v is not None:
                        acc = [acc[0] + v[0], acc[1] + v[1], acc[2] + v[2]]
                out[i] = [round(x, 9) for x in acc]
            return out
        return score
    return make
