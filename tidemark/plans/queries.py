"""The registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..config import RuleConfig
from ..operators import rules
from ..operators.evaluation import folds
from ..operators.features import FEATURES_SQL, features
from ..session import materialize
from ..sources.payments import EVENTS_SQL, LINEITEM_SQL, payments_from_events, payments_from_lineitem

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}
#: Rules that fire on the driver's tables: fewer senders than by default.
LOOSE = replace(RuleConfig(), r3_senders=3)
E_SQL, L_SQL = f"WITH {EVENTS_SQL}, {FEATURES_SQL}", f"WITH {LINEITEM_SQL}, {FEATURES_SQL}"
E_RULES = f"{E_SQL}, {rules.rules_sql(3)}"
_HELD: dict[tuple[str, str, str, int], DataFrame] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    REGISTRY[name] = (query, sql)


def folder_state(spark: SparkSession, sf_dir: str) -> int:
    """A hash of the names, sizes and times of the files in a folder and the folders in it, so that rewritten data are read anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    seen = [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for top in files.listStatus(path) for f in (files.listStatus(top.getPath()) if top.isDirectory() else [top])]
    return hash(tuple(sorted(seen)))


def held(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries start from, written once per session and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name, folder_state(spark, sf_dir))
    if key not in _HELD:
        _HELD[key] = materialize(make(), name)
    return _HELD[key]


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_from_events(spark, sf_dir)


def folded1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, is_suspicious and the entity's fold, null without an entity. Labels go along from the payments, and folds are
    joined while the rows are still dealt by entity, so the rows are not shuffled for either."""

    def make():
        rows = features(p1(spark, sf_dir), keep=["is_suspicious"])
        return rows.hint("merge").join(folds(p1(spark, sf_dir)), "entity_id", "left").select(*rows.columns, "fold")

    return held(spark, sf_dir, "features", make)


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded1(spark, sf_dir).drop("is_suspicious", "fold")


def hits1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "rule-hits", lambda: rules.apply_rules(p1(spark, sf_dir), f1(spark, sf_dir), LOOSE))


register("features_events", lambda s, d: features(p1(s, d)), f"{E_SQL} SELECT * FROM features")
register("features_lineitem", lambda s, d: features(payments_from_lineitem(s, d)), f"{L_SQL} SELECT * FROM features")
register("rule_structuring", lambda s, d: rules.structuring(p1(s, d)), f"{E_RULES} SELECT * FROM r1")
register("rule_layering", lambda s, d: rules.layering(p1(s, d)), f"{E_RULES} SELECT * FROM r2")
register("rule_smurfing", lambda s, d: rules.smurfing(p1(s, d), LOOSE), f"{E_RULES} SELECT * FROM r3")
register("rule_round_dollar", lambda s, d: rules.round_dollar(f1(s, d)), f"{E_RULES} SELECT * FROM r4")
register("rule_dormant_lineitem", lambda s, d: rules.dormant(features(payments_from_lineitem(s, d))), f"{L_SQL}, {rules.rules_sql()} SELECT * FROM r5")
register("rule_large_cash_24h", lambda s, d: rules.large_cash(p1(s, d)), f"{E_RULES} SELECT * FROM r7")
register("rule_layering_lineitem", lambda s, d: rules.layering(payments_from_lineitem(s, d)), f"{L_SQL}, {rules.rules_sql()} SELECT * FROM r2")
register("rules_applied", lambda s, d: hits1(s, d), f"{E_RULES} SELECT * FROM rule_hits")


def queries() -> dict[str, Query]:
    from . import console, customers, evaluation, generated, models, relational, reviews, screening, streams, tables  # noqa: F401  each registers its own


    return {k: q for k, (q, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in REGISTRY.items() if s}
