"""Payments in a bucketed table of batches: loads that are tried again or corrected, and reads without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DAY
from ..session import scratch
from ..sources import tables
from .queries import E_SQL, folder_state, p1, register

WEEK = 7 * DAY
BATCHES = 3
BY = ["entity_id", "week"]
_LOADED: dict[tuple[str, str, int], str] = {}


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments of all batches, a batch being every third day. The second is loaded twice; of the third first a part."""
    key = (spark.sparkContext.applicationId, sf_dir, folder_state(spark, sf_dir))
    if key not in _LOADED:
        rows = p1(spark, sf_dir).withColumn("week", F.floor(F.col("txn_epoch") / WEEK))
        name = f"payments_{uuid.uuid4().hex}"
        tables.open_table(spark, name, f"{scratch(spark)}/{name}", rows.schema, BY, int(spark.conf.get("spark.sql.shuffle.partitions")))
        part = lambda k: rows.where(F.pmod(F.floor(F.col("txn_epoch") / DAY), F.lit(BATCHES)) == k)
        for batch, df in ((2, part(2).where("is_cash = 1")), (0, part(0)), (1, part(1)), (1, part(1)), (2, part(2))):
            tables.load(df, name, batch)
        _LOADED[key] = name
    return spark.table(_LOADED[key])


def weeks(payments: DataFrame) -> DataFrame:
    return payments.groupBy(*BY).agg(F.count(F.lit(1)).alias("payments"), F.sum("amount_cents").alias("week_cents"), F.max("amount_cents").alias("largest_cents"))


def shares(payments: DataFrame) -> DataFrame:
    """Each payment beside what its entity moved that week."""
    return payments.select("transaction_id", *BY, "amount_cents").join(weeks(payments).drop("largest_cents"), BY)


WEEKS = f"""{E_SQL}, paid AS (SELECT *, CAST(floor(txn_epoch / {WEEK}) AS BIGINT) AS week FROM transactions), weeks AS (
  SELECT entity_id, week, COUNT(*) AS payments, CAST(SUM(amount_cents) AS BIGINT) AS week_cents, MAX(amount_cents) AS largest_cents FROM paid GROUP BY 1, 2)"""
register("table_weeks", lambda s, d: weeks(loaded(s, d)), f"{WEEKS} SELECT * FROM weeks")
register("table_shares", lambda s, d: shares(loaded(s, d)), f"{WEEKS} SELECT transaction_id, entity_id, week, amount_cents, payments, week_cents FROM paid JOIN weeks USING (entity_id, week)")
register("table_batches", lambda s, d: loaded(s, d).groupBy("batch").agg(F.count(F.lit(1)).alias("payments"), F.countDistinct("transaction_id").alias("ids")), f"{E_SQL} SELECT CAST(floor(txn_epoch / {DAY}) AS BIGINT) % {BATCHES} AS batch, COUNT(*) AS payments, COUNT(DISTINCT transaction_id) AS ids FROM transactions GROUP BY 1")
