"""Customer risk: effective ownership through chains of holdings, activity against declared income, additive rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KycConfig
from ..session import materialize


def ownership_chains(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chains, seen). chains: entity_id, person_id, share, depth, chain (array) for each chain that ends in a person. seen:
    entity_id, circular, opaque per step taken or refused.

    All businesses climb together, one join per layer; an owner already on the chain closes a loop and is not followed, so
    the climb ends. Layers are written, as lineage would grow with depth.
    """
    front = entities.where("entity_type = 'business'").select("entity_id", F.col("entity_id").alias("node"), F.lit(1.0).alias("product"), F.array("entity_id").alias("chain"))
    chains = seen = None
    while True:
        step = front.join(edges, F.col("node") == F.col("owned")).select(
            "entity_id", "owner", "owner_type", (F.col("product") * F.col("share")).alias("product"), F.array_contains("chain", F.col("owner")).alias("loop"), F.coalesce("owner_opaque_jurisdiction", F.lit(False)).alias("opaque"), "chain"
        )
        step = materialize(step, "ownership-layer")
        marks = step.select("entity_id", F.col("loop").alias("circular"), (F.col("opaque") & ~F.col("loop")).alias("opaque"))
        on = step.where("NOT loop")
        ends = on.where("owner_type = 'person'").select("entity_id", F.col("owner").alias("person_id"), F.col("product").alias("share"), F.size("chain").alias("depth"), F.concat("chain", F.array("owner")).alias("chain"))
        chains, seen = (ends, marks) if chains is None else (chains.unionByName(ends), seen.unionByName(marks))
        front = on.where("owner_type != 'person'").select("entity_id", F.col("owner").alias("node"), "product", F.concat("chain", F.array("owner")).alias("chain"))
        if front.isEmpty():
            return chains, seen


def beneficial_owners(entities: DataFrame, edges: DataFrame, cfg: KycConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(owners, flags): per business and person the share summed over chains; per business its layers and flags.

    The example chain is the smallest as text. Shares that meet the ownership line within 1e-12 count.
    """
    cfg = cfg or KycConfig()
    chains, seen = ownership_chains(entities, edges)
    per = chains.groupBy("entity_id", "person_id").agg(F.sum("share").alias("share"), F.count(F.lit(1)).alias("chains"), F.min(F.array_join("chain", " <- ")).alias("example_chain"), F.max("depth").alias("depth"))
    per = per.withColumn("is_beneficial_owner", F.col("share") >= cfg.owner_line - 1e-12)
    owners = per.select("entity_id", "person_id", F.bround("share", 6).alias("effective_share"), "is_beneficial_owner", "chains", "example_chain")
    held = per.groupBy("entity_id").agg(F.count_if("is_beneficial_owner").alias("n"), F.max("depth").alias("layers"), F.sum("share").alias("accounted"))
    marks = seen.groupBy("entity_id").agg(F.bool_or("circular").alias("circular"), F.bool_or("opaque").alias("opaque"))
    flags = entities.where("entity_type = 'business'").select("entity_id").join(held, "entity_id", "left").join(marks, "entity_id", "left")
    n, layers = F.coalesce("n", F.lit(0)), F.coalesce("layers", F.lit(0))
    return owners, flags.select(
        "entity_id", n.alias("beneficial_owners"), layers.alias("layers"), (layers >= 2).alias("layered_ownership"), F.coalesce("opaque", F.lit(False)).alias("opaque_jurisdiction"),
        F.coalesce("circular", F.lit(False)).alias("circular_ownership"), (n == 0).alias("no_25pct_owner"), F.bround(F.coalesce("accounted", F.lit(0.0)), 6).alias("accounted_share"),
    )


def activity(payments: DataFrame) -> DataFrame:
    """Per entity: monthly inflow over the months that all payments span, and the shares of cash and of wires. Entities
    without inflow or outflow have 0 there."""
    span = payments.agg(F.greatest(F.lit(1.0), (F.max("txn_epoch") - F.min("txn_epoch")) / (86400 * 30.4375)).alias("months"))
    cents, inbound = F.col("amount_cents"), F.col("direction") == "inbound"
    sums = payments.groupBy("entity_id").agg(
        F.sum(F.when(inbound, cents)).alias("inflow"), F.sum(F.when(inbound & (F.col("is_cash") == 1), cents)).alias("cash"), F.sum(F.when(~inbound, cents)).alias("outflow"), F.sum(F.when(~inbound & (F.col("channel") == "wire"), cents)).alias("wires")
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(span)).select("entity_id", (F.coalesce("inflow", F.lit(0)) / 100 / F.col("months")).alias("actual_monthly_inflow_cad"), share("cash", "inflow").alias("cash_share_of_inflows"), share("wires", "outflow").alias("wire_share_of_outflows"))  # one row is broadcast


def band(points: Column, foreign_pep: Column, cfg: KycConfig) -> Column:
    return F.when(foreign_pep | (points >= cfg.high), "High").when(points >= cfg.medium, "Medium").otherwise("Low")


def rate(entities: DataFrame, profiles: DataFrame, flags: DataFrame, active: DataFrame, alerted: DataFrame, cfg: KycConfig | None = None) -> DataFrame:
    """One row per customer with a profile: points and rating at onboarding and at refresh, the factors behind them, due
    diligence and the next review. alerted: entity_id. Customers without activity count as inactive."""
    cfg = cfg or KycConfig()
    p = cfg.points
    df = entities.select("entity_id", "entity_type", "segment").join(profiles, "entity_id").join(flags, "entity_id", "left").join(active, "entity_id", "left")
    df = df.join(alerted.select("entity_id").distinct().withColumn("_alert", F.lit(True)), "entity_id", "left").na.fill(0.0, ["actual_monthly_inflow_cad", "cash_share_of_inflows", "wire_share_of_outflows"])
    business = F.col("entity_type") == "business"
    segment = F.create_map(*[F.lit(x) for kv in cfg.segment_points.items() for x in kv])[F.col("segment")]
    factor = lambda cond, name, pts: F.when(cond, F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), (pts if isinstance(pts, Column) else F.lit(pts)).cast("int").alias("points")))
    first = [
        factor(business, "business", p["business"]), factor(segment > 0, F.concat(F.lit("segment:"), F.col("segment")), segment), factor(F.col("pep_status") == "domestic_pep_or_hio", "domestic_pep_or_hio", p["domestic_pep_or_hio"]),
        factor(F.col("onboarding_channel") == "non_face_to_face", "non_face_to_face", p["non_face_to_face"]), factor(F.col("adverse_media"), "adverse_media", p["adverse_media"]),
        *[factor(business & F.col(f), f, p[f]) for f in ("layered_ownership", "opaque_jurisdiction", "no_25pct_owner")],
    ]
    ratio = F.try_divide(F.col("actual_monthly_inflow_cad"), F.col("declared_monthly_inflow_cad"))
    later = [
        factor(ratio > 3, "activity_over_3x_declared", p["activity_over_3x_declared"]), factor((ratio > 1.5) & (ratio <= 3), "activity_over_1_5x_declared", p["activity_over_1_5x_declared"]),
        factor(F.col("cash_share_of_inflows") > 0.5, "cash_over_half_of_inflows", p["cash_over_half_of_inflows"]), factor(F.col("wire_share_of_outflows") > 0.2, "wires_over_fifth_of_outflows", p["wires_over_fifth_of_outflows"]),
        factor(F.col("_alert"), "monitoring_alert", p["monitoring_alert"]),
    ]
    real = lambda fs: F.filter(F.array(*fs), lambda x: x.isNotNull())
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x["points"])
    df = df.withColumns({"_on": real(first), "_re": real(first + later)})
    foreign = F.col("pep_status") == "foreign_pep"
    df = df.withColumns({"onboarding_points": total(F.col("_on")), "refresh_points": total(F.col("_re"))})
    df = df.withColumns({"onboarding_rating": band(F.col("onboarding_points"), foreign, cfg), "refresh_rating": band(F.col("refresh_points"), foreign, cfg)})
    reasons = [
        F.when(foreign, "foreign PEP: source of funds, senior approval, enhanced monitoring"), F.when(F.col("refresh_rating") == "High", "high risk: enhanced measures and monitoring"),
        F.when(business & F.col("no_25pct_owner"), "no owner at the line: verify the most senior managing officer"), F.when(business & F.col("circular_ownership"), "circular ownership: obtain the structure chart"),
    ]
    edd = F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), " | ")
    months = F.create_map(*[F.lit(x) for kv in cfg.review_months.items() for x in kv])[F.col("refresh_rating")]
    return df.select(
        "entity_id", "entity_type", "segment", "pep_status", "onboarding_points", "onboarding_rating", "refresh_points", "refresh_rating", "declared_monthly_inflow_cad", "actual_monthly_inflow_cad",
        F.array_join(F.transform("_re", lambda x: F.concat(x["name"], F.lit(" +"), x["points"].cast("string"))), "; ").alias("factors"), (edd != "").alias("edd_required"), edd.alias("edd_reasons"),
        F.date_format(F.add_months(F.lit(cfg.as_of).cast("date"), months), "yyyy-MM-dd").alias("next_review"),
    )


RATINGS = ("Low", "Medium", "High")


def migration(risk: DataFrame) -> DataFrame:
    """onboarding_rating by refresh rating, a row for each rating, zeros filled."""
    spine = risk.sparkSession.createDataFrame([(r,) for r in RATINGS], "onboarding_rating string")
    counts = risk.groupBy("onboarding_rating").pivot("refresh_rating", list(RATINGS)).count()
    return spine.join(counts, "onboarding_rating", "left").na.fill(0)


def rating_counts(risk: DataFrame, column: str) -> DataFrame:
    spine = risk.sparkSession.createDataFrame([(r,) for r in RATINGS], "rating string")
    return spine.join(risk.groupBy(F.col(column).alias("rating")).agg(F.count(F.lit(1)).alias("customers")), "rating", "left").na.fill(0)


def edd_histogram(risk: DataFrame) -> DataFrame:
    """Due-diligence reasons by what stands before their colon."""
    each = risk.where("edd_required").select(F.explode(F.split("edd_reasons", r" \| ")).alias("r"))
    return each.groupBy(F.substring_index("r", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("customers"))


def summary(risk: DataFrame, flags: DataFrame, owners: DataFrame) -> DataFrame:
    """One row of totals."""
    multi = owners.where("is_beneficial_owner").groupBy("person_id").agg(F.countDistinct("entity_id").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("persons_owning_two_or_more"))
    a = risk.agg(F.count(F.lit(1)).alias("customers"), F.count_if("edd_required").alias("edd_required"), F.count_if(F.col("pep_status") != "none").alias("peps"))
    b = flags.agg(F.count(F.lit(1)).alias("businesses"), F.count_if("layered_ownership").alias("layered"), F.count_if("opaque_jurisdiction").alias("opaque"), F.count_if("no_25pct_owner").alias("without_owner"), F.count_if("circular_ownership").alias("circular"))
    c = owners.agg(F.count_if("is_beneficial_owner").alias("beneficial_owner_links"))
    return a.crossJoin(b).crossJoin(c).crossJoin(multi)  # one row each
