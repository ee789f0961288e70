"""Forecast of approval / disapproval: split, scaling, boosted trees,
scoring, metrics (W9, X14, A15, M3-M6, J7; pipeline P4).

Training data is one row per day (per key), so it is small next to the
posts; the model is Spark ML's ``GBTRegressor`` with the reference's
settings, and early stopping on a validation part carved from the training
rows (the reference stops on its test part and then reports on it).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..sources.tables import complete_rows, require_columns
from .scaling import MinMaxStats, fit_minmax, fit_robust, minmax_inverse, minmax_scale

# The reference's selected predictors and model settings.
TOP_FEATURES = (
    "approval_rolling_7d", "approval_lag_7d", "sentiment_net_rolling7",
    "score_negative_rolling7", "score_negative_rolling3", "weighted_negative_quoteCount",
    "score_negative_lag_4",
)
GBT_SETTINGS = dict(max_iter=1000, step_size=0.05, max_depth=6, subsample=0.8,
                    col_sample=0.8, seed=42, patience=20)


def temporal_split(df: DataFrame, frac: float = 0.8, keys=(), order: str = "date",
                   out: str = "in_sample") -> DataFrame:
    """The first ``floor(frac * n)`` rows by ``order`` (per key) are
    in-sample; ``order`` should be unique per key (one row per day)."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (df.withColumn("_rn", F.row_number().over(w))
            .withColumn(out, F.col("_rn") <= F.floor(n * F.lit(frac)))
            .drop("_rn"))


def regression_metrics(df: DataFrame, y: str, p: str, keys=()) -> DataFrame:
    """MAE and R^2 over rows where both are present (R^2 null when the
    target is constant)."""
    base = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    err = F.col(y) - F.col(p)
    agg = base.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), F.sum(err * err).alias("_sse"),
        F.var_pop(F.col(y)).alias("_var"), F.count(F.lit(1)).alias("n"))
    return agg.select(*keys, "mae",
                      (F.lit(1.0) - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n")))
                      .alias("r2"), "n")


@dataclass
class Bundle:
    """A fitted model with its predictor names and min-max statistics."""
    model: PipelineModel
    features: tuple
    target: str
    scale_x: MinMaxStats
    scale_y: MinMaxStats

    def save(self, path: str) -> None:
        """M5: the pipeline model plus a JSON side file of names and scalers."""
        self.model.write().overwrite().save(f"{path}/model")
        meta = dict(features=list(self.features), target=self.target,
                    x_lo=self.scale_x.lo, x_hi=self.scale_x.hi,
                    y_lo=self.scale_y.lo, y_hi=self.scale_y.hi)
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string") \
             .coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(path: str) -> "Bundle":
        spark = SparkSession.getActiveSession()
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return Bundle(PipelineModel.load(f"{path}/model"), tuple(meta["features"]),
                      meta["target"], MinMaxStats(meta["x_lo"], meta["x_hi"]),
                      MinMaxStats(meta["y_lo"], meta["y_hi"]))


def _robust_as_minmax(df: DataFrame, cols) -> MinMaxStats:
    """Robust statistics in min-max form: median to 0, median + IQR to 1."""
    st = fit_robust(df, cols)
    return MinMaxStats(st.median, {c: st.median[c] + st.iqr[c] for c in st.median})


SCALERS = {"minmax": fit_minmax, "robust": _robust_as_minmax}


def patient_round(errors, patience: int) -> tuple[int, bool]:
    """The best round (from 1) that a fit with ``patience`` ends on, and whether it ends: it
    goes on until ``patience`` rounds in a row have not been better than the best before."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        if i - best >= patience:
            return best + 1, True
    return best + 1, False


def fit_patiently(make, fit_rows: DataFrame, valid_rows: DataFrame, max_iter: int, patience: int):
    """Boosted trees up to the best round on ``valid_rows``, stopping ``patience`` rounds after
    it: ``(model, best round, error of each round tried)``. ``make(rounds)`` is the estimator.

    The trees of a longer fit begin with those of a shorter one (same seed), so rounds are
    tried in doubling lengths until the stop lies inside, and the model is the fit of the best
    length: at most about four times the trees of one straight run. Without validation rows
    all ``max_iter`` rounds are used.
    """
    if valid_rows.isEmpty():
        return make(max_iter).fit(fit_rows), max_iter, []
    rounds = min(max_iter, 2 * patience)
    while True:
        model = make(rounds).fit(fit_rows)
        errors = model.evaluateEachIteration(valid_rows, "squared")
        best, ended = patient_round(errors, patience)
        if ended or rounds >= max_iter:
            return (model if best == rounds else make(best).fit(fit_rows)), best, errors
        rounds = min(max_iter, 2 * rounds)


def train(df: DataFrame, features=TOP_FEATURES, target: str = "aprobacion", frac: float = 0.8,
          validation_frac: float = 0.8, keys=(), scaler: str = "minmax",
          **settings) -> tuple[Bundle, DataFrame]:
    """M3 + M4: complete rows -> temporal split -> scaling fitted on the training
    rows (``scaler``: ``minmax`` or ``robust``) -> boosted trees (stopped ``patience`` rounds after
    the best one on the last part of the training rows, and cut there) -> MAE / R^2 of the
    inverse-scaled test predictions. Columns are drawn anew at each node of a tree.

    Returns the bundle and a one-row metrics table (mae, r2, n, n_train, best_round).
    """
    features = tuple(features)
    require_columns(df, [*features, target, "date"])
    s = {**GBT_SETTINGS, **settings}
    data = temporal_split(complete_rows(df, [*features, target]), frac, keys)
    tr = data.where(F.col("in_sample"))
    fit = SCALERS[scaler]
    sx, sy = fit(tr, features), fit(tr, [target])
    scaled = minmax_scale(minmax_scale(data, sx), sy, [target])
    # validation = the last (1 - validation_frac) of the training rows; a row per day, read
    # by every round: written once
    tr_s = temporal_split(scaled.where(F.col("in_sample")), validation_frac, keys, out="_fit")
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    rows = reliable_checkpoint(assembler.transform(tr_s).select("_features", target, "_fit"))

    def make(rounds):
        return GBTRegressor(
            featuresCol="_features", labelCol=target, predictionCol="_pred", maxIter=rounds,
            stepSize=s["step_size"], maxDepth=s["max_depth"], subsamplingRate=s["subsample"],
            featureSubsetStrategy=str(s["col_sample"]), seed=s["seed"])

    model, best, _ = fit_patiently(make, rows.where("_fit"), rows.where("NOT _fit"),
                                   s["max_iter"], s["patience"])
    bundle = Bundle(PipelineModel([assembler, model]), features, target, sx, sy)
    test = data.where(~F.col("in_sample"))
    pred = predict_target(test, bundle, "_p", keep=(target,))
    m = regression_metrics(pred, target, "_p").withColumns(
        {"n_train": F.lit(tr.count()), "best_round": F.lit(best)})
    return bundle, m


def predict_target(df: DataFrame, bundle: Bundle, out: str, keep=()) -> DataFrame:
    """M6 for one target: rows with every predictor present -> scale ->
    predict -> inverse scale; returns ``(date, *keep, out)``. Nothing to
    predict gives an empty frame with the same columns."""
    require_columns(df, [*bundle.features, "date"])
    rows = complete_rows(df, bundle.features)
    scaled = minmax_scale(rows, bundle.scale_x, bundle.features)
    pred = bundle.model.transform(scaled)
    pred = minmax_inverse(pred, bundle.scale_y, bundle.target, out=out, source="_pred")
    return pred.select("date", *keep, out)


def merge_predictions(a: DataFrame, b: DataFrame, on: str = "date") -> DataFrame:
    """Full outer join of two prediction tables by day."""
    return a.join(b, on, "full")

