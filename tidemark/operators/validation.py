"""Checks that fail a run: keys, references, values, columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violations(payments: DataFrame, entities: DataFrame) -> DataFrame:
    """(check_name, violations): duplicate ids, unknown entities, and values outside their domain."""
    repeated = payments.groupBy("transaction_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit("transaction_id_unique"))
    orphans = payments.join(entities.select("entity_id").distinct(), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("violations")).withColumn("check_name", F.lit("entity_known"))
    bad = {
        "amount_positive": ~(F.col("amount_cents") > 0), "direction_known": ~F.col("direction").isin("inbound", "outbound"), "is_cash_flag": ~F.col("is_cash").isin(0, 1), "label_flag": ~F.col("is_suspicious").isin(0, 1),
        "counterparty_not_null": F.col("counterparty_id").isNull(), "cash_has_no_counterparty": (F.col("is_cash") == 1) & (F.col("counterparty_id") != ""),
    }
    counted = payments.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in bad.items()])
    values = counted.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in bad]), F.array(*bad))).alias("check_name", "violations"))
    return repeated.unionByName(orphans).unionByName(values)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def require_same_rows(left: DataFrame, right: DataFrame, key: str) -> None:
    """Raises unless each key of left is exactly once in right and the other way round."""
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(key).agg(F.count(F.lit(1)).alias("r")), key, "full")
    bad = counts.where("coalesce(l, 0) != 1 OR coalesce(r, 0) != 1").limit(1).collect()
    if bad:
        raise ValueError(f"not one to one on {key}: {bad[0]}")


def require_finite(df: DataFrame, names: list[str]) -> None:
    bad = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(c) for c in names]).first().asDict()
    if any(bad.values()):
        raise ValueError(f"not finite: { {k: v for k, v in bad.items() if v} }")


def inventory_gaps(df: DataFrame, inventory: DataFrame) -> DataFrame:
    """(column_name, problem): columns without a class in the inventory (column_name, privacy_class), and entries without a column."""
    have = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    open_ = have.join(inventory.where("privacy_class IS NOT NULL"), "column_name", "left_anti").withColumn("problem", F.lit("not classified"))
    return open_.unionByName(inventory.select("column_name").join(have, "column_name", "left_anti").withColumn("problem", F.lit("no such column")))
