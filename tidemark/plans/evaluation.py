"""Queries over scored payments: thresholds, costs, rankings, and what each rule and typology yields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from .queries import E_RULES, f1, held, hits1, p1, register

#: Where payments count as flagged in these queries.
AT = 40.0
SCORED = f"{E_RULES}, {ev.scored_sql()}"


def make_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    payments, features = p1(spark, sf_dir), f1(spark, sf_dir)
    anomaly = ev.simple_anomaly(features).hint("merge").join(ev.folds(payments), "entity_id")
    model = ev.percentile_against_train(anomaly, "anomaly").select("transaction_id", "fold", "anomaly", "model_component")
    return payments.hint("merge").join(ev.risk_scores(hits1(spark, sf_dir), model), "transaction_id")


def scored1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held(spark, sf_dir, "scored", lambda: make_scored(spark, sf_dir))


def sweep_sql(rows: str, score: str = "risk_score", by: str = "", miss: float = 25000.0, name: str = "sw") -> str:
    """CTEs ending in `name`: by, threshold and the columns of the sweep, by brute force over grid and rows."""
    g, gc = (f"{by}, ", f"AND a.{by} = g.{by}") if by else ("", "")
    groups = f"(SELECT DISTINCT {by} FROM {rows})" if by else "(SELECT 1 AS one)"
    block = lambda p, src: f"""
{name}_{p} AS (
  SELECT {g.replace(by, "g." + by) if by else ""}g.threshold, SUM(CASE WHEN a.s >= g.threshold AND a.y = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN a.s >= g.threshold AND a.y = 0 THEN 1 ELSE 0 END) AS fp,
    SUM(CASE WHEN a.s < g.threshold AND a.y = 1 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN a.s < g.threshold AND a.y = 0 THEN 1 ELSE 0 END) AS tn
  FROM (SELECT {g}r.i / 10.0::DOUBLE AS threshold FROM {groups}, (SELECT unnest(generate_series(0, 1000)) AS i) r) g JOIN {src} a ON TRUE {gc} GROUP BY ALL
), {name}_{p}2 AS (
  SELECT {g}threshold, CAST(tp AS BIGINT) AS {p}_true_positives, CAST(fp AS BIGINT) AS {p}_false_positives, CAST(fn AS BIGINT) AS {p}_false_negatives, CAST(tn AS BIGINT) AS {p}_true_negatives, CAST(tp + fp AS BIGINT) AS {p}_alerts,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0::DOUBLE END AS {p}_precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0::DOUBLE END AS {p}_recall,
    fp * 212.5::DOUBLE + fn * {miss}::DOUBLE AS {p}_expected_cost_cad
  FROM {name}_{p}
), {name}_{p}3 AS (
  SELECT *, CASE WHEN {p}_precision + {p}_recall > 0 THEN 2 * {p}_precision * {p}_recall / ({p}_precision + {p}_recall) ELSE 0.0::DOUBLE END AS {p}_f1 FROM {name}_{p}2
)"""  # noqa: E731
    return f"""{name}_rows AS (SELECT {g}entity_id, {score} AS s, is_suspicious AS y FROM {rows}
), {name}_ent AS (SELECT {g}entity_id, MAX(s) AS s, MAX(y) AS y FROM {name}_rows GROUP BY ALL
), {block("txn", name + "_rows")}, {block("entity", name + "_ent")}, {name} AS (
  SELECT *, entity_alerts / 52.0::DOUBLE AS entity_alerts_per_week, entity_alerts / 52.0::DOUBLE <= 48.0::DOUBLE AS entity_within_capacity
  FROM {name}_txn3 JOIN {name}_entity3 USING ({g}threshold)
)"""


SWEEP = f"{SCORED}, {sweep_sql('scored')}"
CHEAPEST = "ORDER BY entity_expected_cost_cad, threshold DESC LIMIT 1"
CONFUSION = """CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives, CAST(tn AS BIGINT) AS true_negatives, CAST(tp + fp AS BIGINT) AS alerts, p AS precision, r AS recall,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1, fp * 212.5::DOUBLE + fn * 25000.0::DOUBLE AS expected_cost_cad"""


def flags_sql(system: str, flag: str) -> str:
    rows = f"SELECT entity_id, is_suspicious = 1 AS y, {flag} AS f FROM scored"
    part = lambda level, src: f"""
SELECT '{level}' AS level, '{system}' AS system, {CONFUSION} FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM (
    SELECT SUM(CASE WHEN f AND y THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN f AND NOT y THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN NOT f AND y THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN NOT f AND NOT y THEN 1 ELSE 0 END) AS tn FROM ({src})))"""  # noqa: E731
    return f"{part('transaction', rows)} UNION ALL {part('entity', f'SELECT entity_id, bool_or(y) AS y, bool_or(f) AS f FROM ({rows}) GROUP BY 1')}"


RANKING = """
  SELECT {g} SUM(CASE WHEN p > 0 THEN CAST(pos * tp AS DOUBLE) / (p * flagged) ELSE 0 END) AS pr_auc, CASE WHEN MAX(p) * (MAX(alln) - MAX(p)) > 0 THEN CAST(SUM((n - pos) * (2 * (tp - pos) + pos)) AS DOUBLE) / (2 * MAX(p) * (MAX(alln) - MAX(p))) ELSE 0.0::DOUBLE END AS roc_auc,
    CAST(MAX(p) AS DOUBLE) / MAX(alln) AS prevalence
  FROM (SELECT *, SUM(pos) OVER (PARTITION BY {k} ORDER BY s DESC) AS tp, SUM(n) OVER (PARTITION BY {k} ORDER BY s DESC) AS flagged, SUM(pos) OVER (PARTITION BY {k}) AS p, SUM(n) OVER (PARTITION BY {k}) AS alln
        FROM (SELECT {g} {score} AS s, CAST(SUM(is_suspicious) AS BIGINT) AS pos, COUNT(*) AS n FROM {rows} GROUP BY ALL)) GROUP BY ALL"""

VARIANTS = """variants AS (
  SELECT 'rules' AS variant, entity_id, is_suspicious, 100.0::DOUBLE * rule_component AS score FROM scored UNION ALL SELECT 'model', entity_id, is_suspicious, 100.0::DOUBLE * model_component FROM scored
  UNION ALL SELECT 'blend', entity_id, is_suspicious, risk_score FROM scored)"""


def typology_sql(by: str, where: str, r1: bool) -> str:
    extra = (", CAST(SUM(CASE WHEN r1 THEN 1 ELSE 0 END) AS BIGINT) AS r1_cases_caught, CAST(SUM(CASE WHEN r1 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS r1_case_recall") if r1 else ""
    return f"""{SCORED} SELECT {by}, CAST(SUM(n) AS BIGINT) AS transactions, CAST(SUM(fl) AS BIGINT) AS transactions_flagged, COUNT(*) AS cases, CAST(SUM(CASE WHEN caught THEN 1 ELSE 0 END) AS BIGINT) AS cases_caught,
      CAST(SUM(fl) AS DOUBLE) / SUM(n) AS transaction_recall, CAST(SUM(CASE WHEN caught THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS case_recall {extra}
    FROM (SELECT {by}, case_id, COUNT(*) AS n, SUM(CASE WHEN risk_score >= {AT} THEN 1 ELSE 0 END) AS fl, bool_or(risk_score >= {AT}) AS caught, bool_or(R1_STRUCTURING) AS r1 FROM scored WHERE {where} GROUP BY 1, 2) GROUP BY 1"""


register("scored", lambda s, d: scored1(s, d), f"{SCORED} SELECT * FROM scored")
register("threshold_sweep", lambda s, d: ev.sweep(scored1(s, d)), f"{SWEEP} SELECT * FROM sw")
register("cheapest_threshold", lambda s, d: ev.cheapest(ev.sweep(scored1(s, d))), f"{SWEEP} SELECT * FROM sw {CHEAPEST}")
register("evaluate_flags", lambda s, d: ev.baseline_comparison(scored1(s, d), AT), f"{SCORED} {flags_sql('layered', f'risk_score >= {AT}')} UNION ALL {flags_sql('naive', 'amount_cents > 1000000')}")
register(
    "nested_thresholds",
    lambda s, d: ev.nested_thresholds(scored1(s, d)),
    f"""{SCORED}, held AS (SELECT h.held_out, s.* FROM scored s JOIN (SELECT unnest(generate_series(0, 4)) AS held_out) h ON h.held_out <> s.fold), {sweep_sql('held', by='held_out', name='tr')}, {sweep_sql('scored', by='fold', name='te')},
    pick AS (SELECT held_out, threshold AS chosen FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY entity_expected_cost_cad, threshold DESC) AS k FROM tr) WHERE k = 1)
    SELECT fold, threshold AS threshold_chosen_on_train, entity_precision AS precision, entity_recall AS recall, entity_expected_cost_cad AS expected_cost_cad FROM te JOIN pick ON fold = held_out AND threshold = chosen""",
)
register(
    "cost_sensitivity",
    lambda s, d: ev.cost_sensitivity(scored1(s, d)),
    f"{SCORED}, " + ", ".join(sweep_sql("scored", miss=m, name=f"s{k}") for k, m in enumerate((5000.0, 25000.0, 100000.0)))
    + " " + " UNION ALL ".join(f"(SELECT {m}::DOUBLE AS cost_per_missed_case_cad, threshold AS optimal_threshold, entity_precision AS precision, entity_recall AS recall, entity_expected_cost_cad AS expected_cost_cad, entity_alerts AS alerts FROM s{k} {CHEAPEST})" for k, m in enumerate((5000.0, 25000.0, 100000.0))),
)
register(
    "ablation",
    lambda s, d: ev.ablation(scored1(s, d)).withColumn("pr_auc", F.round("pr_auc", 9)),
    f"""{SCORED}, {VARIANTS}, {sweep_sql('variants', 'score', 'variant', name='va')}, rk AS ({RANKING.format(g='variant,', k='variant', score='score', rows='variants')}), best AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY entity_expected_cost_cad, threshold DESC) AS k FROM va) WHERE k = 1)
    SELECT best.variant, threshold, entity_precision, entity_recall, entity_alerts, entity_expected_cost_cad, round(pr_auc, 9) AS pr_auc FROM best JOIN rk ON rk.variant = best.variant""",
)
register("ranking_metrics", lambda s, d: ev.ranking_metrics(scored1(s, d)).withColumn("pr_auc", F.round("pr_auc", 9)), f"{SCORED} SELECT round(pr_auc, 9) AS pr_auc, roc_auc, prevalence FROM ({RANKING.format(g='', k='1', score='risk_score', rows='scored')})")
register(
    "rule_summary",
    lambda s, d: ev.rule_summary(scored1(s, d)),
    f"{SCORED}, long AS (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, {r} AS f, is_suspicious = 1 AS y FROM scored" for r in ev.RULES)
    + """) SELECT rule, fired, tp AS true_positives, fired - tp AS false_positives, CASE WHEN fired > 0 THEN CAST(tp AS DOUBLE) / fired ELSE 0.0::DOUBLE END AS precision, CAST(tp AS DOUBLE) / p AS recall FROM (
      SELECT rule, CAST(SUM(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS fired, CAST(SUM(CASE WHEN f AND y THEN 1 ELSE 0 END) AS BIGINT) AS tp, SUM(CASE WHEN y THEN 1 ELSE 0 END) AS p FROM long GROUP BY 1)""",
)
register("typology_recall", lambda s, d: ev.typology_recall(scored1(s, d), AT), typology_sql("typology", "is_suspicious = 1", False))
register("variant_recall", lambda s, d: ev.typology_recall(scored1(s, d), AT, "typology_variant", "structuring"), typology_sql("typology_variant", "typology = 'structuring'", True))
register("missed_cases", lambda s, d: ev.missed_cases(scored1(s, d), AT), f"{SCORED} SELECT case_id, typology, typology_variant FROM scored WHERE is_suspicious = 1 GROUP BY ALL HAVING NOT bool_or(risk_score >= {AT})")
register(
    "densest_windows",
    lambda s, d: ev.densest_windows(scored1(s, d)),
    f"""{SCORED}, rk AS (SELECT v, (upto - n + (n + 1) / 2.0::DOUBLE) / total AS average_rank FROM (SELECT v, n, SUM(n) OVER (ORDER BY v) AS upto, SUM(n) OVER () AS total FROM (SELECT model_component AS v, COUNT(*) AS n FROM scored GROUP BY 1))),
    st AS (SELECT * FROM scored JOIN rk ON v = model_component WHERE typology = 'structuring'), ah AS (SELECT a.transaction_id AS aid, COUNT(*) AS ahead FROM st a JOIN st b ON a.case_id = b.case_id AND b.txn_epoch BETWEEN a.txn_epoch AND a.txn_epoch + 604800 GROUP BY 1)
    SELECT case_id, MIN(typology_variant) AS variant, COUNT(*) AS deposits, MAX(txn_epoch) - MIN(txn_epoch) AS span_seconds, MAX(ahead) AS densest_window, MAX(ahead) >= 3 AS r1_can_fire, bool_or(R1_STRUCTURING) AS r1_did_fire,
      MAX(average_rank) AS best_model_percentile, MAX(risk_score) AS max_risk_score, bool_or(amount_cents > 1000000) AS any_over_naive FROM st JOIN ah ON aid = transaction_id GROUP BY 1""",
)
register(
    "dataset_summary",
    lambda s, d: ev.dataset_summary(p1(s, d)),
    f"""{E_RULES} SELECT COUNT(*) AS transactions, COUNT(DISTINCT entity_id) AS entities, COUNT(DISTINCT CASE WHEN counterparty_id <> '' THEN counterparty_id END) AS counterparties, CAST(SUM(is_suspicious) AS BIGINT) AS suspicious,
      CAST(SUM(is_suspicious) AS DOUBLE) / COUNT(*) AS prevalence, MIN(txn_datetime) AS first_txn, MAX(txn_datetime) AS last_txn, CAST(SUM(amount_cents) AS BIGINT) AS total_cents FROM transactions""",
)
register("headline_at_threshold", lambda s, d: ev.sweep(scored1(s, d)).withColumn("gap", F.abs(F.col("threshold") - 39.62)).orderBy("gap", "threshold").limit(1).drop("gap"), f"{SWEEP} SELECT * FROM sw ORDER BY abs(threshold - 39.62), threshold LIMIT 1")
register(
    "bootstrap_intervals",
    lambda s, d: ev.bootstrap(scored1(s, d), AT).select("metric", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")], "draws"),
    f"""{SCORED}, be AS (SELECT entity_id, COUNT(*) FILTER (WHERE f AND y) AS tp, COUNT(*) FILTER (WHERE f AND NOT y) AS fp, COUNT(*) FILTER (WHERE NOT f AND y) AS fn, bool_or(y) AS c, bool_or(f) AS a
      FROM (SELECT entity_id, is_suspicious = 1 AS y, risk_score >= {AT} AS f FROM scored) GROUP BY 1),
    bu AS (SELECT be.*, draw, CAST('0x' || substr(md5('draw7|' || entity_id || '|' || draw), 1, 15) AS BIGINT) % 1073741824 AS u FROM be, (SELECT unnest(generate_series(1, 2000)) AS draw)),
    bw AS (SELECT *, {" + ".join(f"CAST(u >= {x} AS INTEGER)" for x in ev.POISSON)} AS w FROM bu),
    bs AS (SELECT draw, SUM(w * tp) AS tp, SUM(w * fp) AS fp, SUM(w * fn) AS fn, SUM(CASE WHEN c AND a THEN w ELSE 0 END) AS etp, SUM(CASE WHEN a AND NOT c THEN w ELSE 0 END) AS efp, SUM(CASE WHEN c AND NOT a THEN w ELSE 0 END) AS efn FROM bw GROUP BY 1),
    bm AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, CASE WHEN {p} + {q} > 0 THEN CAST({p} AS DOUBLE) / ({p} + {q}) ELSE 0.0::DOUBLE END AS v FROM bs" for m, p, q in (("txn_precision", "tp", "fp"), ("txn_recall", "tp", "fn"), ("entity_precision", "etp", "efp"), ("entity_recall", "etp", "efn")))})
    SELECT metric, round(AVG(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, COUNT(*) AS draws FROM bm GROUP BY 1""",
)
