"""The streaming rules over the driver's events, against their batch definitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from ..session import prepare, scratch
from ..streaming import cash_windows as cw
from .queries import E_RULES, p1, register


#: Micro-batches of the replay.
BATCHES = 4


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of a stream over the replayed payments, late and repeated ones included, in several micro-batches."""
    where = f"{scratch(prepare(spark))}/stream-{uuid.uuid4().hex}"
    events = cw.replay(p1(spark, sf_dir))
    low, high = events.agg(F.min("arrival"), F.max("arrival")).first()
    width = ((high or 0) - (low or 0)) // BATCHES + 1
    # Each span of arrival is written by as many tasks as read it, and is then a micro-batch: the stream takes all files that
    # are there and ends; started again from its checkpoint, it goes on with the next span's.
    for k in range(BATCHES):
        events.where(F.floor((F.col("arrival") - (low or 0)) / width) == k).write.mode("append").parquet(f"{where}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{where}/in").drop("arrival")
        cw.start(cw.alerts(source), f"{where}/out", f"{where}/checkpoint").awaitTermination()
    return cw.latest_alerts(spark, f"{where}/out")


def batch_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments = p1(spark, sf_dir)
    one = rules.structuring(payments).select(F.lit("R1_STRUCTURING").alias("rule"), "transaction_id")
    return one.unionByName(rules.large_cash(payments).select(F.lit("LCTR_24H").alias("rule"), "transaction_id"))


register("stream_members", lambda s, d: cw.flagged_members(streamed(s, d)), f"{E_RULES} SELECT 'R1_STRUCTURING' AS rule, transaction_id FROM r1 UNION ALL SELECT 'LCTR_24H', transaction_id FROM r7")
register("stream_equals_batch", lambda s, d: cw.difference(cw.flagged_members(streamed(s, d)), batch_members(s, d)), "SELECT '' AS side, '' AS rule, '' AS transaction_id WHERE FALSE")
