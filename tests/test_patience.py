"""Early stopping with patience (M3)."""

import datetime as dt
import random

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor

from pulso.operators import forecast as FC


def test_patient_round():
    assert FC.patient_round([5, 4, 3, 3, 3, 3], 3) == (3, True)
    assert FC.patient_round([5, 4, 3, 4, 2, 4, 4, 4], 3) == (5, True)
    assert FC.patient_round([5, 4, 3, 4, 4, 4, 1], 3) == (3, True)       # better, but after the stop
    assert FC.patient_round([3, 2, 1], 3) == (3, False)
    assert FC.patient_round([1], 1) == (1, False)


def series(spark, n=120, seed=1):
    rnd = random.Random(seed)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=k), float(k % 7), rnd.gauss(0, 1),
             (k % 7) / 7 + rnd.gauss(0, 0.25)) for k in range(n)]
    return spark.createDataFrame(rows, "date date, a double, b double, y double")


def test_the_fit_is_cut_at_the_best_round(spark):
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(series(spark))
    fit, valid = df.where("date < '2024-03-15'"), df.where("date >= '2024-03-15'")

    def make(rounds):
        return GBTRegressor(featuresCol="f", labelCol="y", maxIter=rounds, stepSize=0.3, maxDepth=3,
                            subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=7)

    straight = make(24).fit(fit).evaluateEachIteration(valid, "squared")
    want, ended = FC.patient_round(straight, 4)
    assert ended and want < 20
    tried = []
    model, best, errors = FC.fit_patiently(lambda r: (tried.append(r), make(r))[1], fit, valid, 24, 4)
    assert best == want == model.getNumTrees
    assert errors == straight[:len(errors)]             # a longer fit begins with a shorter one
    assert tried[0] == 8 and max(tried) <= 24
    assert FC.fit_patiently(make, fit, valid.where("false"), 3, 4)[1] == 3


def test_train_reports_the_best_round(spark):
    bundle, m = FC.train(series(spark), ["a", "b"], "y", max_iter=12, patience=3, step_size=0.3, max_depth=3)
    r = m.first()
    assert 1 <= r.best_round <= 12 and r.n_train == 96 and r.n == 24
    assert bundle.model.stages[-1].getNumTrees == r.best_round
