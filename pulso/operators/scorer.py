"""Trainable text scorer (M1, ML form): hashed term counts -> logistic
regression, trained and applied as Spark ML stages.

Stands in for the reference's pretrained per-post classifier.
``score_text`` gives the class and its probabilities for any classes;
``ml_sentiment`` applies a three-class model (0 negative, 1 neutral, 2 positive)
and gives the same five columns as the other scorers, so that it can take their
place in the preprocessing pipeline. The hashing trick keeps the model size fixed however large
the vocabulary grows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sentiment import LABELS
from ..functions.text import TOKEN
from ..session import scratch_path
from ..sources.tables import write_table


def fit_text_classifier(df: DataFrame, text: str = "text", label: str = "label",
                        num_features: int = 1 << 18, reg: float = 0.01,
                        max_iter: int = 50) -> PipelineModel:
    """Fit tokens -> hashed counts -> IDF -> logistic regression."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=TOKEN, gaps=False, toLowercase=True)
    counts = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    # the texts are read and counted once, both fits read the counts
    rows = counts.transform(tokens.transform(df.where(F.col(text).isNotNull()))).select(F.col(label), "_tf")
    spark = df.sparkSession
    rows = spark.read.schema(rows.schema).parquet(write_table(rows, scratch_path(spark, "text-counts")))
    idf = IDF(inputCol="_tf", outputCol="_features").fit(rows)
    fitted = LogisticRegression(featuresCol="_features", labelCol=label, regParam=reg,
                                maxIter=max_iter, probabilityCol="_prob", predictionCol="_pred",
                                rawPredictionCol="_raw").fit(idf.transform(rows))
    model = PipelineModel([tokens, counts, idf, fitted])
    # a freshly fitted logistic model holds its training summary, and with it the session, which
    # cannot be sent to tasks once the session has observed metrics; a stored model holds neither
    path = scratch_path(df.sparkSession, "text-classifier")
    model.write().save(path)
    return PipelineModel.load(path)


def score_text(df: DataFrame, model: PipelineModel, classes=None, text: str = "text") -> DataFrame:
    """Apply a fitted scorer: ``predicted`` (class name or index),
    ``score_label`` (its probability) and ``probabilities`` (array)."""
    base = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    out = model.transform(base)
    probs = vector_to_array("_prob")
    idx = F.col("_pred").cast("int")
    named = (F.element_at(F.array(*[F.lit(c) for c in classes]), idx + 1)
             if classes else idx.cast("string"))
    return (out.withColumn("probabilities", probs)
            .withColumn("score_label", F.array_max("probabilities"))
            .withColumn("predicted", named)
            .drop("_tok", "_tf", "_features", "_raw", "_prob", "_pred"))


def ml_sentiment(df: DataFrame, model: PipelineModel, text: str = "text") -> DataFrame:
    """M1: the five sentiment columns from a model fitted on labels 0, 1, 2 (negative,
    neutral, positive). Blank or null text is Neutral with zero scores; a class that
    the training rows lack has probability 0."""
    out = score_text(df, model, text=text)
    p = [F.coalesce(F.get("probabilities", F.lit(i)), F.lit(0.0)) for i in range(3)]
    blank = F.trim(F.coalesce(F.col(text), F.lit(""))) == ""
    names = F.array(*[F.lit(x) for x in LABELS])
    label = F.when(blank, F.lit("Neutral")).otherwise(
        F.element_at(names, F.array_position(F.array(*p), F.array_max(F.array(*p))).cast("int")))
    value = lambda x: F.when(blank, F.lit(0.0)).otherwise(x)
    scored = out.withColumns({
        "sentiment_label": label, "score_label": value(F.array_max(F.array(*p))),
        "score_negative": value(p[0]), "score_neutral": value(p[1]), "score_positive": value(p[2])})
    return scored.drop("probabilities", "predicted")
