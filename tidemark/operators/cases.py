"""Case queue, case register, relationship graph, release gates, and the drill-downs on one entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FEATURES, RULES, TRUTH, PolicyConfig, ScoreConfig
from ..functions.text import mask_name
from .evaluation import priority


def typology_guess(policy: PolicyConfig, label: int, fallback: str, sep: str = " + ") -> Column:
    """The fired rules' names joined, in the order of the rules."""
    names = F.array(*[F.when(F.col(t[0]), F.lit(t[label])) for t in policy.typologies])
    joined = F.array_join(F.filter(names, lambda x: x.isNotNull()), sep)
    return F.when(joined == "", F.lit(fallback)).otherwise(joined)


def flagged_entities(scored: DataFrame, threshold: float) -> DataFrame:
    """Per alerted entity: peak score, fired rules, how many payments and cents, and the distinct reasons, sorted.

    Reasons are collected distinct; an entity has few, as they name figures of windows that many payments share.
    """
    return scored.where(F.col("risk_score") >= threshold).groupBy("entity_id").agg(
        F.max("risk_score").alias("peak"),
        *[F.bool_or(r).alias(r) for r in RULES],
        F.count(F.lit(1)).alias("n"),
        F.sum("amount_cents").alias("cents"),
        F.array_sort(F.collect_set(F.when(F.col("reason_codes") != "", F.col("reason_codes")))).alias("reasons"),
    )


def case_queue(scored: DataFrame, entities: DataFrame, threshold: float, policy: PolicyConfig | None = None) -> DataFrame:
    """One row per alerted entity, for the console. Reasons in sorted order, cut to 400 characters."""
    policy = policy or PolicyConfig()
    found = flagged_entities(scored, threshold)
    rows = found.select(
        "entity_id", F.bround("peak", 1).alias("risk_score"), typology_guess(policy, 2, "Unclassified (model only)").alias("typology_guess"),
        sum((F.col(r).cast("int") for r in RULES), F.lit(0)).alias("rules_fired"), F.col("n").alias("transactions_flagged"), (F.col("cents") / 100).alias("amount_involved_cad"),
        F.substring(F.array_join("reasons", " | "), 1, 400).alias("reason_codes"),
    )
    return rows.join(entities.select("entity_id", "display_name", "entity_type", "segment"), "entity_id", "left")


def filter_queue(queue: DataFrame, entity_types: list[str] | None = None, typologies: list[str] | None = None, min_amount: float = 0.0) -> DataFrame:
    """Empty lists filter nothing; a typology matches anywhere in the guess."""
    out = queue.where(F.col("amount_involved_cad") >= min_amount)
    if entity_types:
        out = out.where(F.col("entity_type").isin(entity_types))
    if typologies:
        match = F.lit(False)
        for t in typologies:
            match = match | F.col("typology_guess").contains(t)
        out = out.where(match)
    return out


def case_register(scored: DataFrame, entities: DataFrame, threshold: float, policy: PolicyConfig | None = None) -> DataFrame:
    """The governed register: a band and clock by peak score, a state, and masked names; no label column is read."""
    policy = policy or PolicyConfig()
    found = flagged_entities(scored.drop(*TRUTH), threshold)
    band, due = priority(F.col("peak"), policy)
    codes = F.array_join(F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull()), ";")
    state = F.when(F.col("priority") == "P0", "SECOND-LEVEL REVIEW").when(F.col("rules_fired") != "NONE", "EVIDENCE REQUESTED").otherwise("OPEN TRIAGE")
    step = F.when(F.col("priority") == "P0", "Confirm source of funds and purpose with the counterparty inside the review clock.").when(F.col("rules_fired") != "NONE", "Gather the minimum evidence listed for the typology first.").otherwise("State an explainable hypothesis before going further.")
    reasons = F.substring(F.array_join("reasons", " | "), 1, 800)
    rows = found.select(
        F.concat(F.lit("INV-"), F.col("entity_id")).alias("investigation_id"), "entity_id", band.alias("priority"), due.alias("due_hours"), F.bround("peak", 1).alias("max_risk_score"),
        F.when(codes == "", "NONE").otherwise(codes).alias("rules_fired"), typology_guess(policy, 1, "UNCLASSIFIED-MODEL-ONLY").alias("typology_hypothesis"), F.col("n").alias("flagged_transactions"),
        (F.col("cents") / 100).alias("amount_involved_cad"), F.when(F.size("reasons") == 0, "Model only: no rule gives a reason.").otherwise(reasons).alias("evidence_references"),
    )
    rows = rows.withColumns({"case_state": state, "recommended_next_step": step, "decision_status": F.lit("HUMAN DECISION REQUIRED"), "filing_status": F.lit("NOT ASSESSED OR FILED")})
    return rows.join(entities.select("entity_id", mask_name(F.col("display_name")).alias("display_name"), "entity_type", "segment"), "entity_id", "left")


def sorted_register(register: DataFrame) -> DataFrame:
    return register.orderBy("priority", F.desc("max_risk_score"), "investigation_id")


def entity_edges(scored: DataFrame, register: DataFrame) -> DataFrame:
    """Edges between registered entities and counterparties."""
    rows = scored.where("counterparty_id != ''").join(register.select("entity_id"), "entity_id", "left_semi")
    return rows.groupBy("entity_id", "counterparty_id").agg(
        F.countDistinct("transaction_id").alias("transactions"), (F.sum("amount_cents") / 100).alias("amount_cad"), F.min("txn_datetime").alias("first_seen"), F.max("txn_datetime").alias("last_seen"),
        F.bround(F.max("risk_score"), 1).alias("max_risk_score"), F.array_join(F.array_sort(F.collect_set("direction")), ";").alias("directions"),
    )


def entity_graph(scored: DataFrame, register: DataFrame) -> DataFrame:
    """entity_edges, and each counterparty's degree among registered entities."""
    edges = entity_edges(scored, register)
    degree = edges.groupBy("counterparty_id").agg(F.count(F.lit(1)).cast("int").alias("shared_entity_degree"))
    return edges.join(degree, "counterparty_id")


def release_gates(register: DataFrame, graph: DataFrame, scored: DataFrame, threshold: float, policy: PolicyConfig | None = None, cfg: ScoreConfig | None = None) -> DataFrame:
    """(gate_id, status, observed): eight gates, each from one aggregate."""
    policy, cfg = policy or PolicyConfig(), cfg or ScoreConfig()
    spark = register.sparkSession
    expected = scored.where(F.col("risk_score") >= threshold).select("entity_id").distinct()
    sides = expected.withColumn("e", F.lit(1)).join(register.select("entity_id").distinct().withColumn("r", F.lit(1)), "entity_id", "full")
    queue = sides.agg(F.count("e").alias("e"), F.count("r").alias("r"), F.count_if(F.col("e").isNull() | F.col("r").isNull()).alias("bad"))
    status = lambda ok, no="BLOCK": F.when(ok, "PASS").otherwise(no)
    gates = [queue.select(F.lit("QUEUE-01").alias("gate_id"), status(F.col("bad") == 0).alias("status"), F.concat("r", F.lit(" registered / "), "e", F.lit(" expected")).alias("observed"))]
    leaked = sorted(set(register.columns) & set(TRUTH))
    gates.append(spark.range(1).select(F.lit("LABEL-01").alias("gate_id"), F.lit("BLOCK" if leaked else "PASS").alias("status"), F.lit(f"{len(leaked)} label columns in the register").alias("observed")))
    loose = graph.join(register.select("entity_id"), "entity_id", "left_anti").agg(F.count(F.lit(1)).alias("bad"))
    gates.append(loose.crossJoin(graph.agg(F.count(F.lit(1)).alias("n"))).select(F.lit("GRAPH-01").alias("gate_id"), status(F.col("bad") == 0).alias("status"), F.concat("n", F.lit(" edges")).alias("observed")))
    alone = F.col("rules_fired") == "NONE"
    reason = register.agg(F.count_if(alone).alias("n"), F.count_if(alone & (F.col("typology_hypothesis") != "UNCLASSIFIED-MODEL-ONLY")).alias("bad"))
    gates.append(reason.select(F.lit("REASON-01").alias("gate_id"), status(F.col("bad") == 0).alias("status"), F.concat("n", F.lit(" model-only cases")).alias("observed")))
    hours = F.lit(None).cast("int")
    for band, _, due in policy.bands:
        hours = F.when(F.col("priority") == band, F.lit(due)).otherwise(hours)
    gates.append(register.agg(F.count_if(F.coalesce(F.col("due_hours") != hours, F.lit(True))).alias("bad")).select(F.lit("SLA-01").alias("gate_id"), status(F.col("bad") == 0).alias("status"), F.concat("bad", F.lit(" wrong clocks")).alias("observed")))
    weekly = F.col("e") / cfg.weeks
    gates.append(queue.select(F.lit("CAP-01").alias("gate_id"), status(weekly <= cfg.weekly_capacity, "REVIEW").alias("status"), F.concat("e", F.lit(" alerts a year")).alias("observed")))
    for gate in ("HUMAN-01", "FILING-01"):
        gates.append(spark.range(1).select(F.lit(gate).alias("gate_id"), F.lit("REVIEW").alias("status"), F.lit("no human decision is recorded").alias("observed")))
    out = gates[0]
    for g in gates[1:]:
        out = out.unionByName(g)
    return out


def release_decision(gates: DataFrame) -> DataFrame:
    """decision and counts by status: any BLOCK blocks, else any REVIEW asks for review."""
    n = {s: F.count_if(F.col("status") == s) for s in ("PASS", "REVIEW", "BLOCK")}
    decision = F.when(n["BLOCK"] > 0, "BLOCKED").when(n["REVIEW"] > 0, "REVIEW REQUIRED").otherwise("READY")
    return gates.agg(decision.alias("decision"), *[c.alias(f"gates_{s.lower()}") for s, c in n.items()])


def entity_timeline(scored: DataFrame, entity_id: str) -> DataFrame:
    rows = scored.where(F.col("entity_id") == entity_id).orderBy("txn_epoch", "transaction_id")
    return rows.select("txn_datetime", "counterparty_id", "direction", "channel", "amount_cad", "risk_score", "n_rules_fired", "reason_codes")


def deviations(scored: DataFrame, entity_id: str, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """(feature, this_transaction, population_mean, deviation_sigma): the entity's peak payment against all payments."""
    stats = scored.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    peak = scored.where(F.col("entity_id") == entity_id).orderBy(F.desc("risk_score"), "txn_epoch", "transaction_id").limit(1)
    row = peak.crossJoin(stats)  # one row with one row
    parts = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("this_transaction"), F.round(f"m_{c}", 3).alias("population_mean"), F.when(F.col(f"s_{c}") > 0, F.round((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")), 2)).otherwise(0.0).alias("deviation_sigma")) for c in names]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def top_deviations(scored: DataFrame, entity_id: str, n: int = 8, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """The n features that deviate most, either way; of equals by name."""
    return deviations(scored, entity_id, names).orderBy(F.desc(F.abs("deviation_sigma")), "feature").limit(n)


def ego_network(scored: DataFrame, entity_id: str, max_nodes: int = 45) -> DataFrame:
    """(entity_id, counterparty_id): the entity's counterparties that connect 2 to 12 entities, else all; a third of
    max_nodes of them by id, and peers by counterparty and id while there is room."""
    links = scored.where("counterparty_id != ''").select("entity_id", "counterparty_id").distinct()
    own = links.where(F.col("entity_id") == entity_id).select("counterparty_id")
    near = links.join(own, "counterparty_id", "left_semi")
    degree = near.groupBy("counterparty_id").agg(F.count(F.lit(1)).alias("d")).withColumn("good", F.col("d").between(2, 12))
    rank = degree.orderBy(F.desc("good"), "counterparty_id").limit(max_nodes // 3)
    keep = rank.withColumn("any", F.max("good").over(Window.partitionBy(F.lit(1)))).where("good OR NOT any").select("counterparty_id")
    around = near.join(F.broadcast(keep), "counterparty_id")  # at most max_nodes / 3 rows
    firsts = around.where(F.col("entity_id") != entity_id).groupBy("entity_id").agg(F.min("counterparty_id").alias("via")).orderBy("via", "entity_id").limit(max_nodes - 1 - max_nodes // 3)
    allowed = firsts.select("entity_id").unionByName(keep.limit(1).select(F.lit(entity_id).alias("entity_id")))
    return around.join(F.broadcast(allowed), "entity_id", "left_semi")  # at most max_nodes rows


def register_fingerprint(register: DataFrame) -> DataFrame:
    """SHA-256 over the digests of the rows' hashes: rows meet by the first three digits of their hash and the 4,096 digests
    of these in the last step, so no task holds more than a share of the rows. Doubles count to six digits."""
    shown = lambda f: F.col(f.name).cast("decimal(38,6)").cast("string") if f.dataType.typeName() == "double" else F.col(f.name).cast("string")
    cols = [F.coalesce(shown(f), F.lit("")) for f in sorted(register.schema.fields, key=lambda f: f.name)]
    rows = register.select(F.sha2(F.concat_ws("\x1f", *cols), 256).alias("h"))
    digest = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    parts = rows.groupBy(F.substring("h", 1, 3).alias("p")).agg(digest("h").alias("d"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))
