"""Fifteen behavioural features and two columns of rule support, one row per payment.

Sliding frames become prefixes: a payment adds to a running sum when it enters a frame and takes itself away when it
leaves, so sums over 48 hours, 7 and 30 days, distinct counterparties and new counterparties all come from one pass over
entries and exits in the order of time. See running.py for how hot entities and counterparties are spread. Entities of few
payments keep their frames: with these, no row has to be dealt more than once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..session import materialize
from . import running
from .running import apart, dealt, hot_keys, hot_keys_and_rows, with_moments, with_running

BASE = ("transaction_id", "entity_id", "counterparty_id", "txn_epoch", "amount_cents", "direction", "is_cash")


def counterparty_history(payments: DataFrame, cfg: FeatureConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Payments with pair_prev (the pair's previous payment), degree (entities that the counterparty has dealt with by
    then) and cp_first. Payments without a counterparty, such as cash, have none of them."""
    base = payments.selectExpr(*["coalesce(counterparty_id, '') AS counterparty_id" if c == "counterparty_id" else c for c in (*BASE, *keep)])
    named = base.where("counterparty_id != ''")
    first = {"degree": ("sum", "CAST(pair_prev IS NULL AS BIGINT)"), "cp_first": ("min", "CASE WHEN pair_prev IS NULL THEN txn_epoch END")}
    prev = {"pair_prev": ("max", "txn_epoch")}
    pair, one = ["counterparty_id", "entity_id"], ["counterparty_id"]
    hot, rows = hot_keys_and_rows(named, one, running.LONG)
    cold, dense = apart(named, one, hot)
    # Dealt by counterparty once, for its pairs too.
    paired = with_running(dealt(cold, "counterparty_id", rows), pair, "txn_epoch", cfg.chunk, before=prev, tie="transaction_id", hot=False)
    known = with_running(paired, one, "txn_epoch", cfg.chunk, at=first, hot=False)
    if dense is not None:
        # A pair's first payment adds to the counterparty's degree. Per span, first payments are counted from the pairs.
        firsts = dense.groupBy(*pair).agg(F.min("txn_epoch").alias("t"))
        totals = firsts.groupBy("counterparty_id", F.expr(f"floor(t / {cfg.chunk}) AS _span")).agg(F.count(F.lit(1)).alias("_t_degree"), F.min("t").alias("_t_cp_first"))
        spans = dense.selectExpr("counterparty_id", f"floor(txn_epoch / {cfg.chunk}) AS _span").distinct()
        totals = spans.join(totals, ["counterparty_id", "_span"], "left")
        paired = with_running(dense, pair, "txn_epoch", cfg.chunk, before=prev, tie="transaction_id", hot=hot_keys(dense, pair, running.LONG))
        known = known.unionByName(with_running(paired, one, "txn_epoch", cfg.chunk, at=first, totals=totals))
    cash = base.where("counterparty_id = ''").selectExpr("*", "CAST(NULL AS BIGINT) AS pair_prev", "CAST(0 AS BIGINT) AS degree", "CAST(NULL AS BIGINT) AS cp_first")
    return known.unionByName(cash)


#: Where the two halves of a square part.
HALF = 1 << 30
SUMS = ("cnt7", "sum7", "cash7", "cnt30", "sum30", "out48", "in48", "distinct7", "new7")


def entries_and_exits(history: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """One event per payment, and one for each time at which something of it leaves a frame.

    In a 7-day frame a counterparty counts by its first payment there: from the payment, or from when the pair's previous
    payment has left (seen_from), until the payment leaves. It is new while its first payment anywhere lies in the frame.
    """
    t, c = "txn_epoch", "amount_cents"
    cash, out, into = f"IF(is_cash = 1, {c}, 0)", f"IF(direction = 'outbound', {c}, 0)", f"IF(direction = 'inbound', {c}, 0)"
    named = "counterparty_id != ''"
    marked = history.selectExpr("*", f"greatest({t}, pair_prev + {cfg.week + 1}) AS seen_from").selectExpr(
        "*", f"{named} AND seen_from <= {t} + {cfg.week} AS counts", f"{named} AND (pair_prev IS NULL OR seen_from = {t}) AS now", f"{named} AND coalesce({t} <= cp_first + {cfg.week}, false) AS new"
    )
    # Kinds of events: 0 the payment itself; 1, 2, 3 it leaves 7 days, 30 days, 48 hours; 4 its counterparty counts by it from
    # now on; 5 its counterparty is no longer new.
    kinds = "filter(array(0, 1, 2, 3, IF(counts AND NOT now, 4, NULL), IF(new, 5, NULL)), k -> k IS NOT NULL)"
    events = marked.selectExpr("*", f"explode({kinds}) AS kind")
    times = [t, f"{t} + {cfg.week + 1}", f"{t} + {cfg.month + 1}", f"{t} + {cfg.two_days + 1}", "seen_from", f"cp_first + {cfg.week + 1}"]
    time = f"CASE kind {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(times))} END"
    entry = lambda value, left: f"CASE kind WHEN 0 THEN {value} WHEN {left} THEN -({value}) ELSE 0 END"
    sums = {"cnt7": entry("1", 1), "sum7": entry(c, 1), "cash7": entry(cash, 1), "cnt30": entry("1", 2), "sum30": entry(c, 2), "out48": entry(out, 3), "in48": entry(into, 3)}
    sums |= {"distinct7": "CASE kind WHEN 0 THEN IF(now, 1, 0) WHEN 1 THEN IF(counts, -1, 0) WHEN 4 THEN 1 ELSE 0 END", "new7": "CASE kind WHEN 0 THEN IF(new, 1, 0) WHEN 5 THEN -1 ELSE 0 END"}
    return events.selectExpr("entity_id", f"CAST({time} AS BIGINT) AS time", "kind = 0 AS is_row", *[f"IF(kind = 0, {x}, NULL) AS {x}" for x in history.columns if x != "entity_id"], *[f"CAST({sums[k]} AS BIGINT) AS d_{k}" for k in SUMS])


#: Sums of cents and of their squares, in two halves that each fit a long, are exact, and so is what the variance is made of.
SQUARE = "CAST({x} AS DECIMAL(18,0)) * CAST({x} AS DECIMAL(18,0))"


def before_sums(x: str, time: str) -> dict[str, tuple[str, str]]:
    """What stands before a payment, of cents and times that are null in other events."""
    square = SQUARE.format(x=x)
    halves = {"prior_high": ("sum", f"CAST({square} div {HALF} AS BIGINT)"), "prior_low": ("sum", f"CAST({square} % {HALF} AS BIGINT)")}
    return {"prior_n": ("sum", f"CAST({x} IS NOT NULL AS BIGINT)"), "prior_sum": ("sum", x), **halves, "prev_time": ("max", time)}


def swept_frames(history: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """history plus SUMS and what stands before each payment, as prefixes over entries and exits."""
    events = entries_and_exits(history, cfg)
    before = before_sums("IF(is_row, amount_cents, NULL)", "IF(is_row, time, NULL)")
    return with_running(events, ["entity_id"], "time", cfg.chunk, at={k: ("sum", f"d_{k}") for k in SUMS}, before=before, tie="transaction_id").where("is_row")


def plain_frames(history: DataFrame, cfg: FeatureConfig, rows: int) -> DataFrame:
    """The same by sliding frames, whose cost per payment grows with their length: for entities of few payments, of which all
    together have so many rows at most."""
    over = {k: f"OVER (PARTITION BY entity_id ORDER BY txn_epoch RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)" for k, w in (("7", cfg.week), ("30", cfg.month), ("48", cfg.two_days))}
    pick = lambda flag: f"IF({flag}, amount_cents, 0)"
    sums = {"cnt7": ("count(1)", "7"), "sum7": ("sum(amount_cents)", "7"), "cash7": (f"sum({pick('is_cash = 1')})", "7"), "cnt30": ("count(1)", "30"), "sum30": ("sum(amount_cents)", "30")}
    sums |= {"out48": (f"sum({pick("direction = 'outbound'")})", "48"), "in48": (f"sum({pick("direction = 'inbound'")})", "48")}
    # A counterparty counts by its first payment of the frame, whose previous one lies before it.
    seen = f"collect_list(IF(counterparty_id != '', named_struct('prev', pair_prev, 'first', cp_first), NULL)) {over['7']} AS seen"
    run = with_running(dealt(history, "entity_id", rows), ["entity_id"], "txn_epoch", cfg.chunk, before=before_sums("amount_cents", "txn_epoch"), tie="transaction_id", hot=False)
    run = run.selectExpr("*", *[f"{sql} {over[w]} AS {name}" for name, (sql, w) in sums.items()], seen)
    count = lambda test: f"CAST(size(filter(seen, x -> {test})) AS BIGINT)"
    return run.selectExpr("*", f"{count(f'x.prev IS NULL OR x.prev < txn_epoch - {cfg.week}')} AS distinct7", f"{count(f'x.first >= txn_epoch - {cfg.week}')} AS new7").drop("seen")


def features(payments: DataFrame, cfg: FeatureConfig | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """The seven base columns, fifteen features and two support columns per payment. Null counterparties count as ''. keep: columns
    of payments that go along, so that no join by transaction_id has to fetch them."""
    cfg = cfg or FeatureConfig()
    hot, rows = hot_keys_and_rows(payments, ["entity_id"], running.WIDE)
    history = counterparty_history(payments, cfg, keep)
    cold, dense = apart(history if hot is False else materialize(history, "feature-history"), ["entity_id"], hot)
    run = plain_frames(cold, cfg, rows)
    if dense is not None:
        run = run.unionByName(swept_frames(dense, cfg).select(*run.columns))
    wide = lambda c: f"CAST({c} AS DECIMAL(19,0))"
    squares = f"CAST({wide('prior_high')} * {HALF} + prior_low AS DECIMAL(27,0))"
    spread = f"CAST(CAST(prior_n AS DECIMAL(10,0)) * {squares} - {wide('prior_sum')} * {wide('prior_sum')} AS DOUBLE)"
    run = run.selectExpr("*", "CASE WHEN prior_n > 0 THEN CAST(prior_sum AS DOUBLE) / CAST(prior_n AS DOUBLE) END AS mean", f"CASE WHEN prior_n > 0 THEN sqrt({spread}) / CAST(prior_n AS DOUBLE) END AS sigma")
    return run.selectExpr(
        *BASE,
        "cnt7 AS txn_count_7d",
        "sum7 AS txn_sum_7d_cents",
        "cnt30 AS txn_count_30d",
        "sum30 AS txn_sum_30d_cents",
        f"CASE WHEN prior_n >= {cfg.min_history} AND sigma >= {cfg.min_sigma!r}D THEN (CAST(amount_cents AS DOUBLE) - mean) / sigma ELSE 0.0D END AS amount_zscore_entity",
        f"CAST(amount_cents % {cfg.round_cents} = 0 AS INT) AS is_round_amount",
        "coalesce((txn_epoch - prev_time) / 86400.0D, -1.0D) AS days_since_prev_txn",
        "distinct7 AS distinct_counterparties_7d",
        f"CASE WHEN in48 = 0 THEN 0.0D ELSE least(try_divide(CAST(out48 AS DOUBLE), CAST(in48 AS DOUBLE)), {cfg.ratio_cap!r}D) END AS outbound_to_inbound_ratio_48h",
        "try_divide(CAST(cash7 AS DOUBLE), CAST(sum7 AS DOUBLE)) AS cash_ratio_7d",
        "degree AS counterparty_entity_degree_asof",
        "CASE WHEN counterparty_id != '' THEN (txn_epoch - cp_first) / 86400.0D ELSE 0.0D END AS counterparty_age_days",
        "CAST(new7 AS DOUBLE) / CAST(cnt7 AS DOUBLE) AS new_counterparty_ratio_7d",
        "CAST(floor(pmod(txn_epoch, 86400) / 3600) AS INT) AS hour_of_day",
        "CAST(pmod(floor(txn_epoch / 86400) + 4, 7) IN (0, 6) AS INT) AS is_weekend",
        "prior_n AS prior_txn_count",
        "coalesce(mean, 0.0D) AS prior_mean_cents",
        *keep,
    )


def two_pass_zscore(payments: DataFrame, cfg: FeatureConfig | None = None) -> DataFrame:
    """(transaction_id, zscore) by merged moments over the same prior rows: a control for the column from exact sums."""
    cfg = cfg or FeatureConfig()
    x, sigma = F.col("amount_cents").cast("double"), F.sqrt(F.col("moments.m2") / F.greatest(F.col("moments.n"), F.lit(1)))
    run = with_moments(payments.select("transaction_id", "entity_id", "txn_epoch", "amount_cents"), ["entity_id"], "txn_epoch", cfg.chunk, "CAST(amount_cents AS DOUBLE)", tie="transaction_id")
    return run.select("transaction_id", F.when((F.col("moments.n") >= cfg.min_history) & (sigma >= cfg.min_sigma), (x - F.col("moments.mean")) / sigma).otherwise(0.0).alias("zscore"))


FEATURES_SQL = """
f0 AS (
  SELECT t.*,
    COUNT(*) OVER w7 AS txn_count_7d, CAST(SUM(amount_cents) OVER w7 AS BIGINT) AS txn_sum_7d_cents,
    COUNT(*) OVER w30 AS txn_count_30d, CAST(SUM(amount_cents) OVER w30 AS BIGINT) AS txn_sum_30d_cents,
    CAST(SUM(CASE WHEN is_cash = 1 THEN amount_cents ELSE 0 END) OVER w7 AS BIGINT) AS cash7,
    CAST(SUM(CASE WHEN direction = 'outbound' THEN amount_cents ELSE 0 END) OVER w48 AS BIGINT) AS out48,
    CAST(SUM(CASE WHEN direction = 'inbound' THEN amount_cents ELSE 0 END) OVER w48 AS BIGINT) AS in48,
    COUNT(*) OVER wp AS prior_n, SUM(CAST(amount_cents AS HUGEINT)) OVER wp AS psum, SUM(CAST(amount_cents AS HUGEINT) * amount_cents) OVER wp AS psq,
    lag(txn_epoch) OVER (PARTITION BY entity_id ORDER BY txn_epoch, transaction_id) AS prev_epoch,
    MIN(txn_epoch) OVER (PARTITION BY counterparty_id) AS cp_first
  FROM transactions t
  WINDOW w7 AS (PARTITION BY entity_id ORDER BY txn_epoch RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY entity_id ORDER BY txn_epoch RANGE BETWEEN 2592000 PRECEDING AND CURRENT ROW),
         w48 AS (PARTITION BY entity_id ORDER BY txn_epoch RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW),
         wp AS (PARTITION BY entity_id ORDER BY txn_epoch, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), pairs AS (
  SELECT counterparty_id AS pcp, entity_id AS pent, MIN(txn_epoch) AS pfirst FROM transactions WHERE counterparty_id <> '' GROUP BY 1, 2
), j AS (
  SELECT a.transaction_id AS jid, COUNT(DISTINCT b.counterparty_id) AS distinct_counterparties_7d, COUNT(CASE WHEN b.cp_first >= a.txn_epoch - 604800 THEN 1 END) AS new7
  FROM f0 a JOIN f0 b ON a.entity_id = b.entity_id AND b.txn_epoch BETWEEN a.txn_epoch - 604800 AND a.txn_epoch AND b.counterparty_id <> ''
  GROUP BY 1
), deg AS (
  SELECT transaction_id AS did, COUNT(*) AS degree FROM f0 JOIN pairs ON pcp = counterparty_id AND pfirst <= txn_epoch GROUP BY 1
), f1 AS (
  SELECT *, CASE WHEN prior_n > 0 THEN CAST(psum AS DOUBLE) / CAST(prior_n AS DOUBLE) END AS pmean, CASE WHEN prior_n > 0 THEN sqrt(CAST(prior_n * psq - psum * psum AS DOUBLE)) / CAST(prior_n AS DOUBLE) END AS psigma
  FROM f0 LEFT JOIN j ON jid = transaction_id LEFT JOIN deg ON did = transaction_id
), features AS (
  SELECT transaction_id, entity_id, counterparty_id, txn_epoch, amount_cents, direction, is_cash, txn_count_7d, txn_sum_7d_cents, txn_count_30d, txn_sum_30d_cents,
    CASE WHEN prior_n >= 5 AND psigma >= 0.000000001 THEN (CAST(amount_cents AS DOUBLE) - pmean) / psigma ELSE 0.0::DOUBLE END AS amount_zscore_entity,
    CAST(CASE WHEN amount_cents % 100000 = 0 THEN 1 ELSE 0 END AS INTEGER) AS is_round_amount,
    COALESCE((txn_epoch - prev_epoch) / 86400.0::DOUBLE, -1.0::DOUBLE) AS days_since_prev_txn,
    COALESCE(distinct_counterparties_7d, 0) AS distinct_counterparties_7d,
    CASE WHEN in48 = 0 THEN 0.0::DOUBLE ELSE least(CAST(out48 AS DOUBLE) / CAST(in48 AS DOUBLE), 10.0::DOUBLE) END AS outbound_to_inbound_ratio_48h,
    CAST(cash7 AS DOUBLE) / CAST(txn_sum_7d_cents AS DOUBLE) AS cash_ratio_7d,
    CASE WHEN counterparty_id = '' THEN 0 ELSE degree END AS counterparty_entity_degree_asof,
    CASE WHEN counterparty_id = '' THEN 0.0::DOUBLE ELSE (txn_epoch - cp_first) / 86400.0::DOUBLE END AS counterparty_age_days,
    CAST(COALESCE(new7, 0) AS DOUBLE) / CAST(txn_count_7d AS DOUBLE) AS new_counterparty_ratio_7d,
    CAST(substr(txn_datetime, 12, 2) AS INTEGER) AS hour_of_day,
    CAST(CASE WHEN CAST(floor(txn_epoch / 86400.0::DOUBLE) AS BIGINT) % 7 IN (2, 3) THEN 1 ELSE 0 END AS INTEGER) AS is_weekend,
    prior_n AS prior_txn_count, COALESCE(pmean, 0.0::DOUBLE) AS prior_mean_cents
  FROM f1
)"""
