"""Deterministic pattern rules with reasons: structuring, layering, smurfing, round amounts, dormant reactivation, and the
24-hour cash total. Each rule returns one row per payment that fires, with the figures its reason is made of."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULES, FeatureConfig, RuleConfig
from ..session import materialize
from . import running
from .frames import last_within, with_frame, with_last, with_swept
from .running import apart, hot_keys

#: Seconds of the spans by which a hot entity's payments are dealt to tasks; results don't depend on it.
SPAN = FeatureConfig().chunk


def money(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(cents / 100, 2))


def percent(share: Column) -> Column:
    return F.concat(F.format_number(share * 100, 0), F.lit("%"))


def structuring(payments: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, deposits, total_cents, span_seconds, reason): cash deposits in the band that belong to any window,
    anchored at a deposit, of enough of them; the largest such window describes them, the earliest of equals."""
    cfg = cfg or RuleConfig()
    in_band = (F.col("is_cash") == 1) & (F.col("direction") == "inbound") & F.col("amount_cents").between(cfg.r1_floor, cfg.r1_ceiling)
    deposits = payments.where(in_band).select("transaction_id", "entity_id", "txn_epoch", "amount_cents")
    anchored = with_frame(deposits, ["entity_id"], "txn_epoch", cfg.r1_window, {"n": F.count(F.lit(1)), "total": F.sum("amount_cents"), "last": F.max("txn_epoch")}, forward=True)
    window = F.when(F.col("n") >= cfg.r1_deposits, F.struct("n", (-F.col("txn_epoch")).alias("start"), "total", (F.col("last") - F.col("txn_epoch")).alias("span")))
    best = with_frame(anchored.withColumn("w", window), ["entity_id"], "txn_epoch", cfg.r1_window, {"best": F.max("w")}).where("best IS NOT NULL")
    reason = F.concat(
        F.lit("R1_STRUCTURING: "), F.col("best.n").cast("string"), F.lit(" cash deposits totalling "), money(F.col("best.total")), F.lit(" in "), F.format_number(F.col("best.span") / 86400.0, 1),
        F.lit(f" days, each between ${cfg.r1_floor // 100:,} and ${(cfg.r1_ceiling + 1) // 100:,}"),
    )
    return best.select("transaction_id", F.col("best.n").alias("deposits"), F.col("best.total").alias("total_cents"), F.col("best.span").alias("span_seconds"), reason.alias("reason"))


#: Of a payment, what the windows of layering and smurfing are made of.
SWEPT = ("entity_id", "transaction_id", "counterparty_id", "txn_epoch", "amount_cents")
KEYS = ("entity_id", "txn_epoch", "transaction_id")


def near_anchors(rows: DataFrame, width: int) -> DataFrame:
    """Anchors, and the members whose span of time or the one before it has an anchor of their entity: others are in no window."""
    span = F.floor(F.col("txn_epoch") / (width + 1))
    spans = rows.where("is_anchor").select("entity_id", F.explode(F.array(span, span + 1)).alias("_span")).distinct()
    return rows.withColumn("_span", span).join(spans, ["entity_id", "_span"], "left_semi").drop("_span")


def told(rows: DataFrame, hits: DataFrame, figures: Mapping[str, str], reason: Column, width: int, hot: DataFrame | bool) -> tuple[DataFrame, DataFrame]:
    """(transaction_id, anchor_id, the figures, last_seconds, reason) of the rows in windows of hits, of which the last
    tells, and the hits as (entity_id, txn_epoch, transaction_id, mark)."""
    hits = last_within(materialize(hits, "rule-hits"), rows, "entity_id", "txn_epoch", width, SPAN, hot).withColumn("last_seconds", F.expr("last_time - txn_epoch"))
    mark = F.struct("txn_epoch", "transaction_id", *[F.expr(sql).alias(name) for name, sql in figures.items()], "last_seconds", reason.alias("reason"))
    marks = materialize(hits.select(*KEYS, mark.alias("mark")), "rule-marks")
    last = with_last(rows.select(*KEYS), marks, *KEYS, width, SPAN, hot)
    return last.select("transaction_id", F.col("last.transaction_id").alias("anchor_id"), *[f"last.{name}" for name in figures], "last.last_seconds", "last.reason"), marks


def layering(payments: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, anchor_id, legs, counterparties, out_cents, in_cents, last_seconds, reason): a large credit and the
    debits after it, in the order of (time, id), that carry most of it to several counterparties. The last anchor tells."""
    cfg = cfg or RuleConfig()
    debit = F.col("direction") == "outbound"
    rows = payments.withColumns({"counterparty_id": F.coalesce("counterparty_id", F.lit("")), "is_member": debit, "is_anchor": ~debit & (F.col("amount_cents") >= cfg.r2_inbound)})
    rows = rows.where("is_member OR is_anchor").select(*SWEPT, "is_member", "is_anchor")
    hot = hot_keys(rows, ["entity_id"], running.WIDE)
    cold, dense = apart(rows, ["entity_id"], hot)
    rows = cold if dense is None else cold.unionByName(near_anchors(dense, cfg.r2_window))
    swept = with_swept(rows, "entity_id", "txn_epoch", "transaction_id", "counterparty_id", cfg.r2_window, SPAN, {"legs": "1L", "out_cents": "amount_cents"}, hot)
    through = F.col("out_cents") / F.col("amount_cents")
    hits = swept.where((F.col("legs") >= cfg.r2_legs) & (F.col("n_distinct") >= cfg.r2_counterparties) & (through >= cfg.r2_passthrough))
    reason = F.concat(
        F.lit("R2_LAYERING: "), money(F.col("amount_cents")), F.lit(" inbound dispersed to "), F.col("n_distinct").cast("string"), F.lit(" counterparties in "), F.col("legs").cast("string"),
        F.lit(" transfers within "), F.format_number(F.col("last_seconds") / 3600.0, 0), F.lit("h, "), percent(through), F.lit(" passed through"),
    )
    figures = {"legs": "legs", "counterparties": "CAST(n_distinct AS INT)", "out_cents": "out_cents", "in_cents": "amount_cents"}
    members, marks = told(rows.where("is_member"), hits, figures, reason, cfg.r2_window, hot)
    own = marks.select("transaction_id", F.col("transaction_id").alias("anchor_id"), *[f"mark.{name}" for name in figures], "mark.last_seconds", "mark.reason")
    return members.unionByName(own)


def smurfing(payments: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, anchor_id, senders, payments, total_cents, cv, last_seconds, reason): similar modest credits of many
    senders from an anchor on, in the order of (time, id). The last anchor tells."""
    cfg = cfg or RuleConfig()
    credits = payments.where((F.col("direction") == "inbound") & (F.coalesce("counterparty_id", F.lit("")) != ""))
    rows = credits.select(*SWEPT, F.lit(True).alias("is_member"), F.lit(True).alias("is_anchor"))
    hot = hot_keys(rows, ["entity_id"], running.WIDE)
    wide = "CAST(amount_cents AS DECIMAL(18,0))"
    swept = with_swept(rows, "entity_id", "txn_epoch", "transaction_id", "counterparty_id", cfg.r3_window, SPAN, {"payments": "1L", "total_cents": "amount_cents", "squares": f"{wide} * {wide}"}, hot)
    n, total = F.col("payments").cast("double"), F.col("total_cents").cast("double")
    # sqrt(n * sum of squares - square of sum) / sum, exact until the root.
    spread = F.col("payments").cast("decimal(10,0)") * F.col("squares").cast("decimal(27,0)") - F.col("total_cents").cast("decimal(18,0)") * F.col("total_cents").cast("decimal(18,0)")
    hits = swept.where(F.col("n_distinct") >= cfg.r3_senders).withColumn("cv", F.sqrt(spread.cast("double")) / total).where((total / n <= cfg.r3_mean) & (F.col("cv") < cfg.r3_cv))
    reason = F.concat(
        F.lit("R3_SMURFING: "), F.col("n_distinct").cast("string"), F.lit(" distinct senders paid in "), money(F.col("total_cents")), F.lit(" over "), F.format_number(F.col("last_seconds") / 3600.0, 0),
        F.lit("h, amounts within "), percent(F.col("cv")), F.lit(" of each other (avg "), money(total / n), F.lit(")"),
    )
    figures = {"senders": "CAST(n_distinct AS INT)", "payments": "payments", "total_cents": "total_cents", "cv": "cv"}
    return told(rows, hits.drop("squares"), figures, reason, cfg.r3_window, hot)[0]


def round_dollar(features: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, reason): an exact multiple that is an outlier against the entity's own history."""
    cfg = cfg or RuleConfig()
    hit = features.where((F.col("is_round_amount") == 1) & (F.col("amount_zscore_entity") >= cfg.r4_zscore) & (F.col("prior_txn_count") >= cfg.r4_prior))
    reason = F.concat(F.lit("R4_ROUND_DOLLAR: "), money(F.col("amount_cents")), F.lit(" is an exact $1,000 multiple and "), F.format_number("amount_zscore_entity", 1), F.lit(" standard deviations above this entity's own historical average"))
    return hit.select("transaction_id", reason.alias("reason"))


def dormant(features: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, multiple, reason): a payment far above the entity's mean after a long silence."""
    cfg = cfg or RuleConfig()
    multiple = F.try_divide(F.col("amount_cents").cast("double"), F.when(F.col("prior_mean_cents") > 0, F.col("prior_mean_cents")))
    hit = features.withColumn("multiple", multiple).where((F.col("days_since_prev_txn") >= cfg.r5_days) & (F.col("multiple") >= cfg.r5_multiple))
    reason = F.concat(F.lit("R5_DORMANT: "), money(F.col("amount_cents")), F.lit(" after "), F.format_number("days_since_prev_txn", 0), F.lit(" days of no activity, "), F.format_number("multiple", 1), F.lit("x the entity's historical average of "), money(F.col("prior_mean_cents")))
    return hit.select("transaction_id", "multiple", reason.alias("reason"))


def large_cash(payments: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, entity_id): inbound cash that belongs to any window ending at a deposit whose total is reportable."""
    cfg = cfg or RuleConfig()
    cash = payments.where("is_cash = 1 AND direction = 'inbound'").select("transaction_id", "entity_id", "txn_epoch", "amount_cents")
    ends = with_frame(cash, ["entity_id"], "txn_epoch", cfg.cash_window, {"total": F.sum("amount_cents")})
    hit = with_frame(ends, ["entity_id"], "txn_epoch", cfg.cash_window, {"hit": F.max(F.col("total") >= cfg.cash_total)}, forward=True)
    return hit.where("hit").select("transaction_id", "entity_id")


#: Rule code -> (payments, features, config) -> rows with transaction_id and reason.
REGISTRY: dict[str, Callable[[DataFrame, DataFrame, RuleConfig], DataFrame]] = {
    "R1_STRUCTURING": lambda p, f, c: structuring(p, c),
    "R2_LAYERING": lambda p, f, c: layering(p, c),
    "R3_SMURFING": lambda p, f, c: smurfing(p, c),
    "R4_ROUND_DOLLAR": lambda p, f, c: round_dollar(f, c),
    "R5_DORMANT": lambda p, f, c: dormant(f, c),
}


def rule_hits(payments: DataFrame, features: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """(transaction_id, rule, reason) for every rule that fires."""
    cfg = cfg or RuleConfig()
    out = None
    for code, rule in REGISTRY.items():
        hit = rule(payments, features, cfg).select("transaction_id", F.lit(code).alias("rule"), "reason")
        out = hit if out is None else out.unionByName(hit)
    return out


def apply_rules(payments: DataFrame, features: DataFrame, cfg: RuleConfig | None = None) -> DataFrame:
    """One row per payment: a flag per rule, n_rules_fired, reason_codes joined in the order of the rules."""
    hits = rule_hits(payments, features, cfg)
    flags = [F.coalesce(F.bool_or(F.col("rule") == code), F.lit(False)).alias(code) for code in RULES]
    reasons = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule", "reason"))), lambda x: x["reason"]), " | ")
    by_payment = hits.groupBy("transaction_id").agg(*flags, F.count(F.lit(1)).cast("int").alias("n_rules_fired"), reasons.alias("reason_codes"))
    joined = payments.select("transaction_id").join(by_payment, "transaction_id", "left")
    return joined.na.fill(False, list(RULES)).na.fill({"n_rules_fired": 0, "reason_codes": ""})


def rules_sql(senders: int = 8) -> str:
    """The rules' rows as SQL, after transactions and features."""
    money = lambda cents: f"'$' || format('{{:,.2f}}', CAST({cents} AS DOUBLE) / 100)"
    number = lambda x, digits: f"format('{{:,.{digits}f}}', {x})"
    share = lambda x: f"{number(f'({x}) * 100', 0)} || '%'"
    through, mean = "CAST(out_cents AS DOUBLE) / in_cents", "CAST(total_cents AS DOUBLE) / payments"
    return f"""
cash1 AS (
  SELECT transaction_id, entity_id, txn_epoch, amount_cents FROM transactions WHERE is_cash = 1 AND direction = 'inbound' AND amount_cents BETWEEN 750000 AND 999999
), w1 AS (
  SELECT a.transaction_id AS anchor, a.entity_id, a.txn_epoch, COUNT(*) AS n, CAST(SUM(b.amount_cents) AS BIGINT) AS total, MAX(b.txn_epoch) - a.txn_epoch AS span
  FROM cash1 a JOIN cash1 b ON a.entity_id = b.entity_id AND b.txn_epoch BETWEEN a.txn_epoch AND a.txn_epoch + 604800 GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3
), r1 AS (
  SELECT transaction_id, n AS deposits, total AS total_cents, span AS span_seconds,
    'R1_STRUCTURING: ' || n || ' cash deposits totalling ' || {money("total")} || ' in ' || {number("span / 86400.0::DOUBLE", 1)} || ' days, each between $7,500 and $10,000' AS reason FROM (
    SELECT c.transaction_id, w.n, w.total, w.span, row_number() OVER (PARTITION BY c.transaction_id ORDER BY w.n DESC, w.txn_epoch ASC, w.total DESC) AS k
    FROM cash1 c JOIN w1 w ON c.entity_id = w.entity_id AND c.txn_epoch BETWEEN w.txn_epoch AND w.txn_epoch + 604800) WHERE k = 1
), p2a AS (
  SELECT a.transaction_id AS anchor, a.txn_epoch AS aepoch, a.amount_cents AS in_cents, b.transaction_id AS leg, b.txn_epoch AS lepoch, b.amount_cents AS lcents, b.counterparty_id AS lcp
  FROM transactions a JOIN transactions b ON a.entity_id = b.entity_id AND a.direction <> 'outbound' AND a.amount_cents >= 1500000 AND b.direction = 'outbound'
   AND (b.txn_epoch > a.txn_epoch OR (b.txn_epoch = a.txn_epoch AND b.transaction_id > a.transaction_id)) AND b.txn_epoch <= a.txn_epoch + 172800
), w2 AS (
  SELECT anchor, aepoch, in_cents, COUNT(*) AS legs, COUNT(DISTINCT CASE WHEN lcp <> '' THEN lcp END) AS counterparties, CAST(SUM(lcents) AS BIGINT) AS out_cents, MAX(lepoch) - aepoch AS last_seconds
  FROM p2a GROUP BY 1, 2, 3 HAVING COUNT(*) >= 3 AND COUNT(DISTINCT CASE WHEN lcp <> '' THEN lcp END) >= 3 AND CAST(SUM(lcents) AS DOUBLE) / in_cents >= 0.7
), m2 AS (
  SELECT anchor AS transaction_id, w2.* FROM w2 UNION ALL SELECT p.leg AS transaction_id, w2.* FROM w2 JOIN p2a p ON p.anchor = w2.anchor
), r2 AS (
  SELECT transaction_id, anchor AS anchor_id, legs, CAST(counterparties AS INTEGER) AS counterparties, out_cents, in_cents, last_seconds,
    'R2_LAYERING: ' || {money("in_cents")} || ' inbound dispersed to ' || counterparties || ' counterparties in ' || legs || ' transfers within ' || {number("last_seconds / 3600.0::DOUBLE", 0)} || 'h, ' || {share(through)} || ' passed through' AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY aepoch DESC, anchor DESC) AS k FROM m2) WHERE k = 1
), p3 AS (
  SELECT a.transaction_id AS anchor, a.txn_epoch AS aepoch, b.transaction_id AS member, b.txn_epoch AS mepoch, b.amount_cents AS mcents, b.counterparty_id AS mcp
  FROM transactions a JOIN transactions b ON a.entity_id = b.entity_id AND a.direction = 'inbound' AND a.counterparty_id <> '' AND b.direction = 'inbound' AND b.counterparty_id <> ''
   AND (b.txn_epoch > a.txn_epoch OR (b.txn_epoch = a.txn_epoch AND b.transaction_id >= a.transaction_id)) AND b.txn_epoch <= a.txn_epoch + 259200
), w3 AS (
  SELECT *, sqrt(CAST(payments * squares - CAST(total_cents AS HUGEINT) * total_cents AS DOUBLE)) / CAST(total_cents AS DOUBLE) AS cv FROM (
    SELECT anchor, aepoch, COUNT(*) AS payments, COUNT(DISTINCT mcp) AS senders, CAST(SUM(mcents) AS BIGINT) AS total_cents, SUM(CAST(mcents AS HUGEINT) * mcents) AS squares, MAX(mepoch) - aepoch AS last_seconds
    FROM p3 GROUP BY 1, 2)
), r3 AS (
  SELECT transaction_id, anchor AS anchor_id, CAST(senders AS INTEGER) AS senders, payments, total_cents, cv, last_seconds,
    'R3_SMURFING: ' || senders || ' distinct senders paid in ' || {money("total_cents")} || ' over ' || {number("last_seconds / 3600.0::DOUBLE", 0)} || 'h, amounts within ' || {share("cv")} || ' of each other (avg ' || {money(mean)} || ')' AS reason FROM (
    SELECT p.member AS transaction_id, w.*, row_number() OVER (PARTITION BY p.member ORDER BY w.aepoch DESC, w.anchor DESC) AS k
    FROM w3 w JOIN p3 p ON p.anchor = w.anchor WHERE w.senders >= {senders} AND CAST(w.total_cents AS DOUBLE) / w.payments <= 500000 AND w.cv < 0.35) WHERE k = 1
), r4 AS (
  SELECT transaction_id, 'R4_ROUND_DOLLAR: ' || {money("amount_cents")} || ' is an exact $1,000 multiple and ' || {number("amount_zscore_entity", 1)} || ' standard deviations above this entity''s own historical average' AS reason FROM features WHERE is_round_amount = 1 AND amount_zscore_entity >= 2.0 AND prior_txn_count >= 10
), r5 AS (
  SELECT transaction_id, CAST(amount_cents AS DOUBLE) / prior_mean_cents AS multiple,
    'R5_DORMANT: ' || {money("amount_cents")} || ' after ' || {number("days_since_prev_txn", 0)} || ' days of no activity, ' || {number("CAST(amount_cents AS DOUBLE) / prior_mean_cents", 1)} || 'x the entity''s historical average of ' || {money("prior_mean_cents")} AS reason
  FROM features WHERE prior_mean_cents > 0 AND days_since_prev_txn >= 90 AND CAST(amount_cents AS DOUBLE) / prior_mean_cents >= 4.0
), cash7 AS (
  SELECT transaction_id, entity_id, txn_epoch, amount_cents FROM transactions WHERE is_cash = 1 AND direction = 'inbound'
), w7e AS (
  SELECT a.entity_id, a.txn_epoch FROM cash7 a JOIN cash7 b ON a.entity_id = b.entity_id AND b.txn_epoch BETWEEN a.txn_epoch - 86400 AND a.txn_epoch
  GROUP BY a.entity_id, a.txn_epoch, a.transaction_id HAVING SUM(b.amount_cents) >= 1000000
), r7 AS (
  SELECT DISTINCT c.transaction_id, c.entity_id FROM cash7 c JOIN w7e w ON c.entity_id = w.entity_id AND c.txn_epoch BETWEEN w.txn_epoch - 86400 AND w.txn_epoch
), hits AS (
  SELECT t.transaction_id, r1.transaction_id IS NOT NULL AS R1_STRUCTURING, r2.transaction_id IS NOT NULL AS R2_LAYERING, r3.transaction_id IS NOT NULL AS R3_SMURFING,
    r4.transaction_id IS NOT NULL AS R4_ROUND_DOLLAR, r5.transaction_id IS NOT NULL AS R5_DORMANT, concat_ws(' | ', r1.reason, r2.reason, r3.reason, r4.reason, r5.reason) AS reason_codes
  FROM transactions t LEFT JOIN r1 ON r1.transaction_id = t.transaction_id LEFT JOIN r2 ON r2.transaction_id = t.transaction_id LEFT JOIN r3 ON r3.transaction_id = t.transaction_id
    LEFT JOIN r4 ON r4.transaction_id = t.transaction_id LEFT JOIN r5 ON r5.transaction_id = t.transaction_id
), rule_hits AS (
  SELECT *, CAST(R1_STRUCTURING AS INTEGER) + CAST(R2_LAYERING AS INTEGER) + CAST(R3_SMURFING AS INTEGER) + CAST(R4_ROUND_DOLLAR AS INTEGER) + CAST(R5_DORMANT AS INTEGER) AS n_rules_fired FROM hits
)"""
