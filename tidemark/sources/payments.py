"""Payments from the driver's tables: one row per payment from the monitored entity's side.

P1 takes `events` as payments to the second; P2 takes `lineitem` with `orders` as payments to the day, with many ties.
Each has its SQL for the oracle. Labels stand in for ground truth and are functions of the keys alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

COLUMNS = (
    "transaction_id", "entity_id", "counterparty_id", "txn_datetime", "txn_epoch", "amount_cents", "amount_cad", "direction", "channel", "is_cash", "is_suspicious", "typology", "typology_variant", "case_id",
)
TYPOLOGIES = ("structuring", "layering", "smurfing", "round_dollar", "dormant_reactivation")


def with_labels(df: DataFrame, suspicious, entity_no) -> DataFrame:
    names = F.array(*[F.lit(t) for t in TYPOLOGIES])
    typology = F.element_at(names, (entity_no % 5 + 1).cast("int"))
    variant = F.when(entity_no % 5 != 0, "standard").when(entity_no % 2 == 0, "fast").otherwise("slow")
    keep = lambda c: F.when(suspicious, c).otherwise("")
    return df.withColumns(
        {"is_suspicious": suspicious.cast("int"), "typology": keep(typology), "typology_variant": keep(variant), "case_id": keep(F.concat(F.lit("CASE-"), F.lpad(entity_no.cast("string"), 6, "0")))}
    ).select(*COLUMNS)


def payments_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    epoch = F.unix_timestamp("ts")
    cents = F.greatest(F.lit(1).cast("long"), F.round(F.col("value") * 20000).cast("long"))
    df = e.select(
        F.concat(F.lit("TXN-"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("transaction_id"),
        F.concat(F.lit("ENT-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("entity_id"),
        F.when(kind == "signup", "").otherwise(F.concat(F.lit("CPT-"), F.regexp_extract("props", r'"k": *(\d+)', 1))).alias("counterparty_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("txn_datetime"),
        epoch.alias("txn_epoch"),
        cents.alias("amount_cents"),
        (cents / 100).alias("amount_cad"),
        F.when(kind.isin("signup", "purchase", "view"), "inbound").otherwise("outbound").alias("direction"),
        F.when(kind == "signup", "cash").when(kind == "purchase", "eft").when(kind == "view", "card").when(kind == "click", "wire").otherwise("etransfer").alias("channel"),
        (kind == "signup").cast("int").alias("is_cash"),
        "event_id",
        "user_id",
    )
    return with_labels(df, F.col("event_id") % 61 == 0, F.col("user_id"))


def payments_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id is made of what tells lineitem's rows apart, so no global numbering is needed."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    cents = F.greatest(F.lit(1).cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    epoch = F.unix_timestamp("l_shipdate")
    text = lambda c, n: F.lpad(c.cast("string"), n, "0")
    ident = F.concat_ws("-", F.lit("TXN"), text(F.col("l_orderkey"), 9), F.col("l_linenumber").cast("string"), text(F.col("l_partkey"), 7), text(F.col("l_suppkey"), 6), text(cents, 9), text(epoch, 10))
    df = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        ident.alias("transaction_id"),
        F.concat(F.lit("ENT-"), text(F.col("o_custkey"), 6)).alias("entity_id"),
        F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit("CPT-"), F.col("l_suppkey").cast("string"))).alias("counterparty_id"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("txn_datetime"),
        epoch.alias("txn_epoch"),
        cents.alias("amount_cents"),
        (cents / 100).alias("amount_cad"),
        F.when(F.col("l_linestatus") == "O", "inbound").otherwise("outbound").alias("direction"),
        F.when(F.col("l_returnflag") == "R", "cash").otherwise("wire").alias("channel"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_cash"),
        "l_orderkey",
        "o_custkey",
    )
    return with_labels(df, F.col("l_orderkey") % 83 == 0, F.col("o_custkey"))


_LABELS_SQL = """
  CAST(s AS INTEGER) AS is_suspicious,
  CASE WHEN s THEN CASE k % 5 WHEN 0 THEN 'structuring' WHEN 1 THEN 'layering' WHEN 2 THEN 'smurfing' WHEN 3 THEN 'round_dollar' ELSE 'dormant_reactivation' END ELSE '' END AS typology,
  CASE WHEN s THEN CASE WHEN k % 5 <> 0 THEN 'standard' WHEN k % 2 = 0 THEN 'fast' ELSE 'slow' END ELSE '' END AS typology_variant,
  CASE WHEN s THEN 'CASE-' || lpad(CAST(k AS VARCHAR), 6, '0') ELSE '' END AS case_id
"""

EVENTS_SQL = f"""
p1 AS (
  SELECT 'TXN-' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS transaction_id, 'ENT-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS entity_id,
    CASE WHEN event_type = 'signup' THEN '' ELSE 'CPT-' || regexp_extract(props, '"k": *([0-9]+)', 1) END AS counterparty_id,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS txn_datetime, CAST(floor(epoch(ts)) AS BIGINT) AS txn_epoch,
    greatest(1, CAST(round(value * 20000) AS BIGINT)) AS amount_cents,
    CASE WHEN event_type IN ('signup', 'purchase', 'view') THEN 'inbound' ELSE 'outbound' END AS direction,
    CASE event_type WHEN 'signup' THEN 'cash' WHEN 'purchase' THEN 'eft' WHEN 'view' THEN 'card' WHEN 'click' THEN 'wire' ELSE 'etransfer' END AS channel,
    CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS is_cash, event_id % 61 = 0 AS s, user_id AS k
  FROM events
), transactions AS (
  SELECT transaction_id, entity_id, counterparty_id, txn_datetime, txn_epoch, amount_cents, CAST(amount_cents AS DOUBLE) / 100 AS amount_cad, direction, channel, is_cash, {_LABELS_SQL}
  FROM p1
)"""

LINEITEM_SQL = f"""
p2 AS (
  SELECT 'TXN-' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || CAST(l_linenumber AS VARCHAR) || '-' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') || '-' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0')
      || '-' || lpad(CAST(greatest(1, CAST(round(l_extendedprice * 100) AS BIGINT)) AS VARCHAR), 9, '0') || '-' || lpad(CAST(CAST(floor(epoch(l_shipdate)) AS BIGINT) AS VARCHAR), 10, '0') AS transaction_id,
    'ENT-' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') AS entity_id,
    CASE WHEN l_returnflag = 'R' THEN '' ELSE 'CPT-' || CAST(l_suppkey AS VARCHAR) END AS counterparty_id,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS txn_datetime, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS txn_epoch,
    greatest(1, CAST(round(l_extendedprice * 100) AS BIGINT)) AS amount_cents,
    CASE WHEN l_linestatus = 'O' THEN 'inbound' ELSE 'outbound' END AS direction,
    CASE WHEN l_returnflag = 'R' THEN 'cash' ELSE 'wire' END AS channel, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_cash, l_orderkey % 83 = 0 AS s, o_custkey AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), transactions AS (
  SELECT transaction_id, entity_id, counterparty_id, txn_datetime, txn_epoch, amount_cents, CAST(amount_cents AS DOUBLE) / 100 AS amount_cad, direction, channel, is_cash, {_LABELS_SQL}
  FROM p2
)"""
