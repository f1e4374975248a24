"""Risk scores, thresholds and their evaluation.

Everything that sweeps thresholds or ranks scores first counts rows per score, so what is ordered globally is one row per
grid step or distinct score, not per payment.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES, PolicyConfig, ScoreConfig
from ..session import materialize
from .frames import with_frame
from .running import with_ranked


def safe(n: Column, d: Column) -> Column:
    """n / d in doubles, 0 where d is 0."""
    return F.when(d != 0, n.cast("double") / F.when(d != 0, d)).otherwise(F.lit(0.0))


def hash15(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def folds(payments: DataFrame, n: int = 5, seed: str = "folds", label: str = "is_suspicious", bits: int = 16) -> DataFrame:
    """entity_id, fold: entities of each class, those with a suspicious payment and those without, dealt in turn in the order of
    a seeded hash, so that fold sizes differ by one per class at most.

    Ranks are exact without a global order: entities are counted by class and leading bits of the hash, what stands before
    comes from that table of at most 2^bits rows a class, and only within a bucket are entities ordered.
    """
    mark = F.coalesce(F.max(F.col(label).cast("int")), F.lit(0)) if label in payments.columns else F.max(F.lit(0))
    each = payments.groupBy("entity_id").agg(mark.alias("class")).withColumn("h", hash15(F.lit(seed), F.col("entity_id")))
    each = each.withColumn("bucket", F.shiftright("h", 60 - bits))
    counts = each.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("bucket")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("class", "bucket").orderBy("h", "entity_id"))
    ranked = each.withColumn("inside", inside).join(counts.select("class", "bucket", before.alias("before")), ["class", "bucket"])
    return ranked.select("entity_id", ((F.col("before") + F.col("inside") - 1) % n).cast("int").alias("fold"))


#: The same in SQL, after transactions.
FOLDS_SQL = """folds AS (
  SELECT entity_id, CAST((row_number() OVER (PARTITION BY class ORDER BY CAST('0x' || substr(md5('folds|' || entity_id), 1, 15) AS BIGINT), entity_id) - 1) % 5 AS INTEGER) AS fold
  FROM (SELECT entity_id, COALESCE(MAX(is_suspicious), 0) AS class FROM transactions GROUP BY 1)
)"""


#: Distinct values of which a table is broadcast at most.
FEW = 100_000


def looked_up(rows: DataFrame, value: str, counts: DataFrame, lookup: DataFrame) -> DataFrame:
    """rows with what lookup holds for their value (_v); counts is a written table with a row per value. Where values are few, the
    rows stay where they are; else both sides are dealt by value. The rows are never broadcast, however small as a file."""
    on = F.col(value) == F.col("_v")
    return (rows.join(F.broadcast(lookup), on) if counts.count() <= FEW else rows.hint("merge").join(lookup, on)).drop("_v")


def percentile_against_train(scores: DataFrame, value: str, n_folds: int = 5) -> DataFrame:
    """scores plus model_component: the share of the rows of the other folds whose value is at most the row's."""
    names = [f"_n{k}" for k in range(n_folds)]
    counts = scores.groupBy(F.col(value).alias("_v")).agg(*[F.count_if(F.col("fold") == k).alias(names[k]) for k in range(n_folds)])
    counts = materialize(counts, "value-counts")
    ranked = with_ranked(counts, "_v", names, held=True)
    rest = lambda prefix, k: sum((F.col(f"{prefix}_{n}") for j, n in enumerate(names) if j != k), F.lit(0))
    lookup = ranked.select("_v", F.array(*[safe(rest("upto", k), rest("all", k)) for k in range(n_folds)]).alias("_shares"))
    return looked_up(scores, value, counts, lookup).withColumn("model_component", F.element_at("_shares", F.col("fold") + 1)).drop("_shares")


def simple_anomaly(features: DataFrame) -> DataFrame:
    """transaction_id, entity_id, anomaly: a transparent stand-in for a model, on a grid of 0.01."""
    raw = F.floor(F.least(F.abs("amount_zscore_entity"), F.lit(10.0)) * 100) + F.floor(F.col("new_counterparty_ratio_7d") * 100) + F.floor(F.col("outbound_to_inbound_ratio_48h") * 10)
    return features.select("transaction_id", "entity_id", (raw.cast("double") / 100).alias("anomaly"))


def risk_scores(hits: DataFrame, model: DataFrame, cfg: ScoreConfig | None = None) -> DataFrame:
    """hits (n_rules_fired) with model (transaction_id, model_component): rule_component and risk_score from 0 to 100."""
    cfg = cfg or ScoreConfig()
    rule = F.least(F.col("n_rules_fired") / cfg.saturation, F.lit(1.0))
    # A row a payment on both sides: as a file such a table may look small enough to be broadcast, which it never is in memory.
    joined = hits.hint("merge").join(model, "transaction_id").withColumn("rule_component", rule)
    return joined.withColumn("risk_score", 100.0 * (cfg.rule_weight * F.col("rule_component") + cfg.model_weight * F.col("model_component")))


def entity_rollup(scored: DataFrame, score: str = "risk_score", by: Sequence[str] = ()) -> DataFrame:
    """Per entity: its peak score, and whether any of its payments is suspicious."""
    return scored.groupBy(*by, "entity_id").agg(F.max(score).alias(score), F.max("is_suspicious").alias("is_suspicious"))


def confusion(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = safe(tp, tp + fp), safe(tp, tp + fn)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return {"true_positives": tp, "false_positives": fp, "false_negatives": fn, "true_negatives": tn, "alerts": tp + fp, "precision": precision, "recall": recall, "f1": f1}


def bucket(score: Column, cfg: ScoreConfig) -> Column:
    """The largest grid index i with i / 10.0 <= score, correct on the grid points themselves; -1 below the grid."""
    i = F.floor(score * 10)
    i = F.when(i / 10.0 > score, i - 1).when((i + 1) / 10.0 <= score, i + 1).otherwise(i)
    return F.greatest(F.least(i, F.lit(cfg.steps)), F.lit(-1)).cast("int")


def curve(rows: DataFrame, score: str, by: Sequence[str], prefix: str, cfg: ScoreConfig, miss: Column) -> DataFrame:
    """Per group and grid step: confusion counts, rates and cost of flagging scores from that step on."""
    counts = rows.groupBy(*by, bucket(F.col(score), cfg).alias("step")).agg(F.sum("is_suspicious").alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = counts.select(*by).distinct() if by else counts.sparkSession.range(1).select()
    spine = grid.withColumn("step", F.explode(F.sequence(F.lit(-1), F.lit(cfg.steps))))
    full = spine.join(counts, [*by, "step"], "left").na.fill(0, ["pos", "n"])
    from_here = Window.partitionBy(*by).orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    tp, flagged = F.sum("pos").over(from_here), F.sum("n").over(from_here)
    pos, n = F.sum("pos").over(whole), F.sum("n").over(whole)
    out = full.select(*by, "step", tp.alias("tp"), flagged.alias("flagged"), pos.alias("p"), n.alias("all")).where("step >= 0")
    parts = confusion(F.col("tp"), F.col("flagged") - F.col("tp"), F.col("p") - F.col("tp"), F.col("all") - F.col("flagged") - (F.col("p") - F.col("tp")))
    cost = (F.col("flagged") - F.col("tp")) * F.lit(cfg.investigation_cost) + (F.col("p") - F.col("tp")) * miss
    return out.select(*by, "step", *[c.alias(f"{prefix}_{k}") for k, c in parts.items()], cost.alias(f"{prefix}_expected_cost_cad"))


def sweep(scored: DataFrame, score: str = "risk_score", by: Sequence[str] = (), cfg: ScoreConfig | None = None, miss: float | None = None) -> DataFrame:
    """One row per group and threshold 0.0 to 100.0: confusion, rates and cost of payments and of entities, and capacity."""
    cfg = cfg or ScoreConfig()
    cost = F.lit(cfg.miss_cost if miss is None else miss)
    txn = curve(scored, score, by, "txn", cfg, cost)
    ent = curve(entity_rollup(scored, score, by), score, by, "entity", cfg, cost)
    weekly = F.col("entity_alerts") / cfg.weeks
    return txn.join(ent, [*by, "step"]).select(*by, (F.col("step") / 10.0).alias("threshold"), *[c for c in txn.columns if c.startswith("txn_")], *[c for c in ent.columns if c.startswith("entity_")], weekly.alias("entity_alerts_per_week"), (weekly <= cfg.weekly_capacity).alias("entity_within_capacity"))


def cheapest(swept: DataFrame, by: Sequence[str] = (), level: str = "entity") -> DataFrame:
    """Per group the row of least cost; of equals the highest threshold."""
    best = F.min_by(F.struct(*[c for c in swept.columns if c not in by]), F.struct(f"{level}_expected_cost_cad", -F.col("threshold")))
    return swept.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def evaluate_flags(scored: DataFrame, flag: Column, cfg: ScoreConfig | None = None) -> DataFrame:
    """Two rows, transaction and entity level: the confusion matrix, rates and cost of a flag."""
    cfg = cfg or ScoreConfig()
    rows = scored.select("entity_id", (F.col("is_suspicious") == 1).alias("y"), flag.alias("f"))
    entities = rows.groupBy("entity_id").agg(F.bool_or("y").alias("y"), F.bool_or("f").alias("f"))
    out = None
    for level, df in (("transaction", rows), ("entity", entities)):
        y, f = F.col("y"), F.col("f")
        counts = df.agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"))
        parts = confusion(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
        row = counts.select(F.lit(level).alias("level"), *[c.alias(k) for k, c in parts.items()], (F.col("fp") * F.lit(cfg.investigation_cost) + F.col("fn") * F.lit(cfg.miss_cost)).alias("expected_cost_cad"))
        out = row if out is None else out.unionByName(row)
    return out


def baseline_comparison(scored: DataFrame, threshold: float, cfg: ScoreConfig | None = None) -> DataFrame:
    """evaluate_flags of the scores and of the naive amount rule, by system."""
    cfg = cfg or ScoreConfig()
    layered = evaluate_flags(scored, F.col("risk_score") >= threshold, cfg).withColumn("system", F.lit("layered"))
    return layered.unionByName(evaluate_flags(scored, F.col("amount_cents") > cfg.naive_cents, cfg).withColumn("system", F.lit("naive")))


def nested_thresholds(scored: DataFrame, cfg: ScoreConfig | None = None, n_folds: int = 5) -> DataFrame:
    """Per fold: the cheapest threshold on the other folds, and what it does on this one, at entity level."""
    cfg = cfg or ScoreConfig()
    held = F.explode(F.filter(F.array(*[F.lit(k) for k in range(n_folds)]), lambda k: k != F.col("fold"))).alias("held_out")
    chosen = cheapest(sweep(scored.select("*", held), by=["held_out"], cfg=cfg), ["held_out"]).select("held_out", F.col("threshold").alias("chosen"))
    own = sweep(scored, by=["fold"], cfg=cfg).join(chosen, (F.col("fold") == F.col("held_out")) & (F.col("threshold") == F.col("chosen")))
    return own.select("fold", F.col("threshold").alias("threshold_chosen_on_train"), F.col("entity_precision").alias("precision"), F.col("entity_recall").alias("recall"), F.col("entity_expected_cost_cad").alias("expected_cost_cad"))


def cost_sensitivity(scored: DataFrame, cfg: ScoreConfig | None = None) -> DataFrame:
    """The cheapest threshold for each assumed cost of a missed case."""
    cfg = cfg or ScoreConfig()
    out = None
    for miss in cfg.miss_costs:
        row = cheapest(sweep(scored, cfg=cfg, miss=miss)).select(F.lit(miss).alias("cost_per_missed_case_cad"), F.col("threshold").alias("optimal_threshold"), F.col("entity_precision").alias("precision"), F.col("entity_recall").alias("recall"), F.col("entity_expected_cost_cad").alias("expected_cost_cad"), F.col("entity_alerts").alias("alerts"))
        out = row if out is None else out.unionByName(row)
    return out


def ablation(scored: DataFrame, cfg: ScoreConfig | None = None) -> DataFrame:
    """Rules alone, model alone and the blend: each at its cheapest threshold, with average precision."""
    cfg = cfg or ScoreConfig()
    variants = scored.select("transaction_id", "entity_id", "is_suspicious", F.explode(F.map_from_arrays(F.array(F.lit("rules"), F.lit("model"), F.lit("blend")), F.array(100.0 * F.col("rule_component"), 100.0 * F.col("model_component"), F.col("risk_score")))).alias("variant", "score"))
    best = cheapest(sweep(variants, "score", ["variant"], cfg), ["variant"])
    return best.join(ranking_metrics(variants, "score", ["variant"]), "variant").select("variant", "threshold", "entity_precision", "entity_recall", "entity_alerts", "entity_expected_cost_cad", "pr_auc")


def ranking_metrics(scored: DataFrame, score: str = "risk_score", by: Sequence[str] = ()) -> DataFrame:
    """Average precision as a step sum over distinct scores, tie-aware ROC AUC, and prevalence."""
    counts = scored.groupBy(*by, F.col(score).alias("s")).agg(F.sum("is_suspicious").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = with_ranked(counts, "s", ["pos", "n"], by, down=True)
    steps = ranked.select(*by, "pos", "n", F.col("upto_pos").alias("tp"), F.col("upto_n").alias("flagged"), F.col("all_pos").alias("p"), F.col("all_n").alias("all"))
    neg = F.col("n") - F.col("pos")
    above = F.col("tp") - F.col("pos")
    return steps.groupBy(*by).agg(
        F.sum(safe(F.col("pos") * F.col("tp").cast("double"), F.col("p") * F.col("flagged"))).alias("pr_auc"),
        safe(F.sum(neg * (2 * above + F.col("pos"))), 2 * F.first("p") * (F.first("all") - F.first("p"))).alias("roc_auc"),
        safe(F.first("p"), F.first("all")).alias("prevalence"),
    )


def rule_summary(scored: DataFrame) -> DataFrame:
    """Per rule: payments that fired, how many are suspicious, precision, and recall of all that are."""
    long = scored.select("is_suspicious", F.explode(F.map_from_arrays(F.array(*[F.lit(r) for r in RULES]), F.array(*RULES))).alias("rule", "fired"))
    y = F.col("is_suspicious") == 1
    counts = long.groupBy("rule").agg(F.count_if("fired").alias("fired"), F.count_if(F.col("fired") & y).alias("true_positives"), F.count_if(y).alias("p"))
    return counts.select("rule", "fired", "true_positives", (F.col("fired") - F.col("true_positives")).alias("false_positives"), safe(F.col("true_positives"), F.col("fired")).alias("precision"), safe(F.col("true_positives"), F.col("p")).alias("recall"))


def typology_recall(scored: DataFrame, threshold: float, by: str = "typology", only: str | None = None) -> DataFrame:
    """Per typology or variant: recall of payments and of cases; for variants also the cases that R1 alone catches."""
    rows = scored.where("is_suspicious = 1") if only is None else scored.where(F.col("typology") == only)
    rows = rows.withColumn("flagged", F.col("risk_score") >= threshold)
    cases = rows.groupBy(by, "case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"), F.bool_or("flagged").alias("caught"), F.bool_or("R1_STRUCTURING").alias("r1"))
    total = cases.groupBy(by).agg(F.sum("n").alias("transactions"), F.sum("flagged").alias("transactions_flagged"), F.count(F.lit(1)).alias("cases"), F.count_if("caught").alias("cases_caught"), F.count_if("r1").alias("r1_cases_caught"))
    rates = total.select("*", safe(F.col("transactions_flagged"), F.col("transactions")).alias("transaction_recall"), safe(F.col("cases_caught"), F.col("cases")).alias("case_recall"))
    return rates.drop("r1_cases_caught") if only is None else rates.withColumn("r1_case_recall", safe(F.col("r1_cases_caught"), F.col("cases")))


def missed_cases(scored: DataFrame, threshold: float) -> DataFrame:
    """Cases of which no payment reaches the threshold."""
    cases = scored.where("is_suspicious = 1").groupBy("case_id", "typology", "typology_variant").agg(F.bool_or(F.col("risk_score") >= threshold).alias("caught"))
    return cases.where("NOT caught").drop("caught")


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """df plus average_rank: the mean rank of a row's ties as a share of all rows; one row per distinct value is ordered."""
    counts = materialize(df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")), "value-counts")
    ranks = with_ranked(counts, "_v", ["_n"], held=True).select("_v", ((F.col("upto__n") - F.col("_n") + (F.col("_n") + 1) / 2.0) / F.col("all__n")).alias("average_rank"))
    return looked_up(df, value, counts, ranks)


def best_amount_f1(payments: DataFrame) -> DataFrame:
    """The best F1 that a threshold on the amount alone reaches, and that threshold; of equals the higher one."""
    counts = payments.groupBy("amount_cents").agg(F.sum("is_suspicious").alias("pos"), F.count(F.lit(1)).alias("n"))
    ranked = with_ranked(counts, "amount_cents", ["pos", "n"], down=True)
    steps = ranked.select("amount_cents", F.col("upto_pos").alias("tp"), F.col("upto_n").alias("flagged"), F.col("all_pos").alias("p"))
    f1 = safe(2 * F.col("tp"), F.col("flagged") + F.col("p"))
    best = F.max(F.struct(f1.alias("f1"), "amount_cents"))
    return steps.agg(best.alias("b")).select(F.col("b.f1").alias("best_f1"), F.col("b.amount_cents").alias("threshold_cents"))


def densest_windows(scored: DataFrame, cfg: ScoreConfig | None = None, width: int = 604_800, least: int = 3) -> DataFrame:
    """Per structuring case: its size and span, the most deposits in any window, and what rule and model made of it."""
    cfg = cfg or ScoreConfig()
    ranked = average_rank(scored, "model_component").where("typology = 'structuring'")
    counted = with_frame(ranked, ["case_id"], "txn_epoch", width, {"ahead": F.count(F.lit(1))}, forward=True)
    return counted.groupBy("case_id").agg(
        F.min("typology_variant").alias("variant"),
        F.count(F.lit(1)).alias("deposits"),
        (F.max("txn_epoch") - F.min("txn_epoch")).alias("span_seconds"),
        F.max("ahead").alias("densest_window"),
        (F.max("ahead") >= least).alias("r1_can_fire"),
        F.bool_or("R1_STRUCTURING").alias("r1_did_fire"),
        F.max("average_rank").alias("best_model_percentile"),
        F.max("risk_score").alias("max_risk_score"),
        F.bool_or(F.col("amount_cents") > cfg.naive_cents).alias("any_over_naive"),
    )


def dataset_summary(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count(F.lit(1)).alias("transactions"), F.countDistinct("entity_id").alias("entities"), F.countDistinct(F.when(F.col("counterparty_id") != "", F.col("counterparty_id"))).alias("counterparties"),
        F.sum("is_suspicious").alias("suspicious"), safe(F.sum("is_suspicious"), F.count(F.lit(1))).alias("prevalence"), F.min("txn_datetime").alias("first_txn"), F.max("txn_datetime").alias("last_txn"), F.sum("amount_cents").alias("total_cents"),
    )


def priority(score: Column, policy: PolicyConfig) -> tuple[Column, Column]:
    """(band, hours due): the highest floor at or below the score; null where there is none."""
    name = hours = F.lit(None)
    for band, floor, due in sorted(policy.bands, key=lambda b: b[1]):
        name, hours = F.when(score >= floor, F.lit(band)).otherwise(name), F.when(score >= floor, F.lit(due)).otherwise(hours)
    return name.cast("string"), hours.cast("int")


#: A hash below 2^30 counts as often as it reaches these: Poisson(1).
POISSON = [round(2**30 * x) for x in np.cumsum([np.exp(-1.0) / factorial(k) for k in range(8)])]


def bootstrap(scored: DataFrame, threshold: float, draws: int = 2000, seed: int = 7) -> DataFrame:
    """metric, mean, low, high: 95 % intervals from entities drawn with replacement.

    Each entity's weight in a draw is Poisson(1) by a hash of entity and draw, so draws need no global order and are summed
    on the executors: an entity is one row of counts, exploded by draw and partially aggregated.
    """
    y, f = F.col("is_suspicious") == 1, F.col("risk_score") >= threshold
    ent = scored.groupBy("entity_id").agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.bool_or(y).alias("case"), F.bool_or(f).alias("alert"))
    # Entities are dealt to all tasks: a table of them is small, and joining its partitions by size would leave all draws to one.
    ent = ent.repartition(int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = ent.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = hash15(F.lit(f"draw{seed}"), F.col("entity_id"), F.col("draw").cast("string")) % (1 << 30)
    w = sum(((u >= F.lit(step)).cast("int") for step in POISSON), F.lit(0))
    c, a = F.col("case"), F.col("alert")
    sums = drawn.withColumn("w", w).groupBy("draw").agg(*[F.sum(F.col("w") * x.cast("int")).alias(n) for n, x in {"tp": F.col("tp"), "fp": F.col("fp"), "fn": F.col("fn"), "etp": c & a, "efp": ~c & a, "efn": c & ~a}.items()])
    metrics = F.map_from_arrays(F.array(*[F.lit(m) for m in ("txn_precision", "txn_recall", "entity_precision", "entity_recall")]), F.array(safe(F.col("tp"), F.col("tp") + F.col("fp")), safe(F.col("tp"), F.col("tp") + F.col("fn")), safe(F.col("etp"), F.col("etp") + F.col("efp")), safe(F.col("etp"), F.col("etp") + F.col("efn"))))
    long = sums.select(F.explode(metrics).alias("metric", "value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"), F.count(F.lit(1)).alias("draws"))


def scored_sql() -> str:
    """Folds, percentiles and scores as SQL, after transactions, features and rule_hits."""
    return FOLDS_SQL + """, folded AS (
  SELECT f.transaction_id, f.entity_id, folds.fold,
    CAST(CAST(floor(least(abs(amount_zscore_entity), 10.0::DOUBLE) * 100) AS BIGINT) + CAST(floor(new_counterparty_ratio_7d * 100) AS BIGINT) + CAST(floor(outbound_to_inbound_ratio_48h * 10) AS BIGINT) AS DOUBLE) / 100 AS anomaly
  FROM features f JOIN folds ON folds.entity_id = f.entity_id
), cnt AS (
  SELECT anomaly AS v, fold AS k, COUNT(*) AS n FROM folded GROUP BY 1, 2
), tot AS (
  SELECT k AS tk, SUM(n) AS tn FROM cnt GROUP BY 1
), cumul AS (
  SELECT x.v, x.k, CAST(SUM(c.n) AS DOUBLE) / (SELECT SUM(tn) FROM tot WHERE tk <> x.k) AS share
  FROM (SELECT DISTINCT anomaly AS v, fold AS k FROM folded) x JOIN cnt c ON c.v <= x.v AND c.k <> x.k GROUP BY x.v, x.k
), scored AS (
  SELECT t.*, h.R1_STRUCTURING, h.R2_LAYERING, h.R3_SMURFING, h.R4_ROUND_DOLLAR, h.R5_DORMANT, h.n_rules_fired, h.reason_codes, d.fold, d.anomaly, COALESCE(c.share, 0) AS model_component,
    least(CAST(h.n_rules_fired AS DOUBLE) / 2, 1.0::DOUBLE) AS rule_component,
    100.0::DOUBLE * (0.6::DOUBLE * least(CAST(h.n_rules_fired AS DOUBLE) / 2, 1.0::DOUBLE) + 0.4::DOUBLE * COALESCE(c.share, 0)) AS risk_score
  FROM transactions t JOIN rule_hits h ON h.transaction_id = t.transaction_id JOIN folded d ON d.transaction_id = t.transaction_id LEFT JOIN cumul c ON c.v = d.anomaly AND c.k = d.fold
)"""
