"""Cross-validated anomaly scores over the driver's events, and how well each model ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import models as m
from ..session import materialize
from .queries import E_SQL, f1, folded1, held, hits1, p1, register


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded1(spark, sf_dir).where("transaction_id IS NOT NULL AND fold IS NOT NULL")


def scores(model: str):
    return lambda s, d: m.cross_validated(inputs(s, d), model)


def ranking(model: str):
    def query(s, d):
        return ev.ranking_metrics(m.cross_validated(inputs(s, d), model, keep=["is_suspicious"]), "score")

    return query


def model_scored(s, d):
    """Payments scored with the isolation forest's own scores, where the other queries keep a stand-in that SQL can follow."""


    def make():
        # The forests are grown, and every row is put through them, once: percentiles read the scores again.
        forest = materialize(m.cross_validated(inputs(s, d), "isolation_forest"), "forest-scores")
        shares = ev.percentile_against_train(forest, "score").select("transaction_id", "fold", F.col("score").alias("anomaly"), "model_component")
        return p1(s, d).hint("merge").join(ev.risk_scores(hits1(s, d), shares), "transaction_id")

    return held(s, d, "scored-by-model", make)


for name in ("isolation_forest", "lof", "mahalanobis", "logistic"):
    register(f"model_{name}", scores(name))
register("model_gbt_ranking", ranking("gbt"))
register("scored_by_model", model_scored)
register("cheapest_threshold_by_model", lambda s, d: ev.cheapest(ev.sweep(model_scored(s, d))))
register("ranking_by_model", lambda s, d: ev.ranking_metrics(model_scored(s, d)))
register(
    "folds",
    lambda s, d: ev.folds(p1(s, d)).groupBy("fold").agg(F.count(F.lit(1)).alias("entities")),
    f"{E_SQL}, {ev.FOLDS_SQL} SELECT fold, COUNT(*) AS entities FROM folds GROUP BY 1",
)
register(
    "fold_classes",
    lambda s, d: ev.folds(p1(s, d)).join(p1(s, d).groupBy("entity_id").agg(F.max("is_suspicious").alias("class")), "entity_id").groupBy("class", "fold").agg(F.count(F.lit(1)).alias("entities")),
    f"{E_SQL}, {ev.FOLDS_SQL} SELECT class, fold, COUNT(*) AS entities FROM folds JOIN (SELECT entity_id, MAX(is_suspicious) AS class FROM transactions GROUP BY 1) USING (entity_id) GROUP BY 1, 2",
)
register(
    "scaling",
    lambda s, d: f1(s, d).agg(F.round(F.avg("txn_count_7d"), 9).alias("mean"), F.round(F.stddev_pop("txn_count_7d"), 9).alias("sigma")),
    f"{E_SQL} SELECT round(AVG(txn_count_7d), 9) AS mean, round(stddev_pop(txn_count_7d), 9) AS sigma FROM features",
)
