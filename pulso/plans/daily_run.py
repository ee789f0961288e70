"""The daily jobs as library functions (P4, P6, P7; P8 is ``replies.harvest_with_replies``).

Each takes frames and returns frames; reading and writing the stored tables is the
caller's (``read_table`` / ``write_table``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import daily as D
from ..operators import forecast as FC
from ..operators import kpi as K
from ..operators import metrics as M
from ..operators import topics as TP
from ..session import reliable_checkpoint
from .features import daily_features

TARGETS = {"aprobacion": "prediccion_aprobacion", "desaprobacion": "prediccion_desaprobacion"}


def forecast_targets(posts: DataFrame, polls: DataFrame, features=FC.TOP_FEATURES,
                     targets: dict = TARGETS, **settings) -> tuple[DataFrame, dict]:
    """Feature table -> one model per target -> predictions merged by day, and the
    fitted bundles. The feature table (a row per day) is read by all fits: written once."""
    table = reliable_checkpoint(daily_features(posts, polls))
    merged, bundles = None, {}
    for target, out in targets.items():
        bundles[target], _ = FC.train(table, features, target, **settings)
        one = FC.predict_target(table, bundles[target], out)
        merged = one if merged is None else FC.merge_predictions(merged, one)
    return merged, bundles


def indicator_table(posts: DataFrame, predictions: DataFrame) -> DataFrame:
    """P6, input: predictions with the day's metrics."""
    daily = D.daily_means(posts, counts=())
    return M.predictions_with_metrics(predictions, M.daily_metrics(daily, posts))


def kpi_report(posts: DataFrame, predictions: DataFrame, cols) -> DataFrame:
    """The newest indicators against the day before."""
    return K.kpi_latest(indicator_table(posts, predictions), cols)


def topics_by_candidate(docs: DataFrame, seeds: DataFrame, labels: DataFrame,
                        candidate: str = "candidate", min_size: int = 10) -> DataFrame:
    """Cleaned posts -> seeded topic -> label -> share per candidate."""
    assigned = TP.seed_topics(docs, TP.clean_seeds(seeds), min_size=min_size, keep=(candidate,))
    return TP.topic_share(TP.label_topics(assigned, labels), candidate)
