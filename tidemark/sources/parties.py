"""Entities from the customer table, and the spine of ownership around them, as functions of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SEGMENTS = ("salaried", "retired", "gig", "self_employed", "ecommerce", "wholesale", "professional_services", "retail_cash_intensive")


def entities_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, entity_no, display_name, entity_type, segment: the first three segments are individuals, and a half of the fourth."""
    k = F.col("c_custkey")
    business = (k % 8 > 3) | ((k % 8 == 3) & (F.floor(k / 8) % 2 == 1))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("ENT-"), F.lpad(k.cast("string"), 6, "0")).alias("entity_id"), k.alias("entity_no"), F.translate("c_name", "#", " ").alias("display_name"),
        F.when(business, "business").otherwise("individual").alias("entity_type"), F.element_at(F.array(*[F.lit(s) for s in SEGMENTS]), (k % 8 + 1).cast("int")).alias("segment"),
    )


ENTITIES_SQL = f"""
entities AS (
  SELECT 'ENT-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS entity_id, c_custkey AS entity_no, replace(c_name, '#', ' ') AS display_name,
    CASE WHEN c_custkey % 8 > 3 OR (c_custkey % 8 = 3 AND (c_custkey // 8) % 2 = 1) THEN 'business' ELSE 'individual' END AS entity_type,
    CASE c_custkey % 8 {' '.join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SEGMENTS))} END AS segment
  FROM customer
)"""


def profiles_from_entities(entities: DataFrame) -> DataFrame:
    """entity_id, pep_status, onboarding_channel, adverse_media, declared_monthly_inflow_cad, as functions of the number."""
    k = F.col("entity_no")
    return entities.select(
        "entity_id",
        F.when(k % 97 == 0, "foreign_pep").when(k % 53 == 0, "domestic_pep_or_hio").otherwise("none").alias("pep_status"),
        F.when(k % 4 == 0, "non_face_to_face").otherwise("branch").alias("onboarding_channel"),
        (k % 61 == 0).alias("adverse_media"),
        (500 + (k * 37) % 50000).cast("double").alias("declared_monthly_inflow_cad"),
    )


HOLDINGS = 60


def ownership_from_entities(entities: DataFrame) -> DataFrame:
    """owner, owned, share, owner_type, owner_opaque_jurisdiction: businesses owned by people and holdings, holdings by people
    and other holdings, with a few loops."""
    k = F.col("entity_no")
    person = lambda x: F.concat(F.lit("PER-"), F.lpad((x % 500).cast("string"), 4, "0"))
    holding = lambda x: F.concat(F.lit("HLD-"), F.lpad((x % HOLDINGS).cast("string"), 3, "0"))
    opaque = lambda x: (x % HOLDINGS) % 9 == 0
    edge = lambda owner, share, kind, hidden: F.struct(owner.alias("owner"), F.lit(share).alias("share"), F.lit(kind).alias("owner_type"), hidden.alias("owner_opaque_jurisdiction"))
    no = F.lit(False)
    business = F.array(
        F.when(k % 3 == 0, edge(holding(k), 0.625, "holding", opaque(k))).otherwise(edge(person(k), 0.5, "person", no)),
        edge(person(k * 7 + 1), 0.125, "person", no),
        F.when(k % 5 != 0, edge(person(k * 11 + 2), 0.25, "person", no)),
    )
    firms = entities.where("entity_type = 'business'").select(F.col("entity_id").alias("owned"), F.explode(F.filter(business, lambda e: e.isNotNull())).alias("e"))
    h = F.col("id")
    upper = F.array(
        edge(person(h * 3), 0.5, "person", no),
        F.when(h % 4 != 3, edge(holding(h + 1), 0.375, "holding", opaque(h + 1))).when(h % 8 == 7, edge(holding(h - 1), 0.25, "holding", opaque(h - 1))),
    )
    above = entities.sparkSession.range(HOLDINGS).select(holding(h).alias("owned"), F.explode(F.filter(upper, lambda e: e.isNotNull())).alias("e"))
    return firms.unionByName(above).select("e.owner", "owned", "e.share", "e.owner_type", "e.owner_opaque_jurisdiction")


PROFILES_SQL = """
profiles AS (
  SELECT entity_id, CASE WHEN entity_no % 97 = 0 THEN 'foreign_pep' WHEN entity_no % 53 = 0 THEN 'domestic_pep_or_hio' ELSE 'none' END AS pep_status, CASE WHEN entity_no % 4 = 0 THEN 'non_face_to_face' ELSE 'branch' END AS onboarding_channel,
    entity_no % 61 = 0 AS adverse_media, CAST(500 + (entity_no * 37) % 50000 AS DOUBLE) AS declared_monthly_inflow_cad FROM entities
)"""
OWNERSHIP_SQL = f"""
own AS (
  SELECT CASE WHEN entity_no % 3 = 0 THEN 'HLD-' || lpad(CAST(entity_no % {HOLDINGS} AS VARCHAR), 3, '0') ELSE 'PER-' || lpad(CAST(entity_no % 500 AS VARCHAR), 4, '0') END AS owner, entity_id AS owned, CASE WHEN entity_no % 3 = 0 THEN 0.625::DOUBLE ELSE 0.5::DOUBLE END AS share,
    CASE WHEN entity_no % 3 = 0 THEN 'holding' ELSE 'person' END AS owner_type, entity_no % 3 = 0 AND (entity_no % {HOLDINGS}) % 9 = 0 AS owner_opaque_jurisdiction FROM entities WHERE entity_type = 'business'
  UNION ALL SELECT 'PER-' || lpad(CAST((entity_no * 7 + 1) % 500 AS VARCHAR), 4, '0'), entity_id, 0.125::DOUBLE, 'person', FALSE FROM entities WHERE entity_type = 'business'
  UNION ALL SELECT 'PER-' || lpad(CAST((entity_no * 11 + 2) % 500 AS VARCHAR), 4, '0'), entity_id, 0.25::DOUBLE, 'person', FALSE FROM entities WHERE entity_type = 'business' AND entity_no % 5 <> 0
  UNION ALL SELECT 'PER-' || lpad(CAST((h * 3) % 500 AS VARCHAR), 4, '0'), 'HLD-' || lpad(CAST(h AS VARCHAR), 3, '0'), 0.5::DOUBLE, 'person', FALSE FROM (SELECT unnest(generate_series(0, {HOLDINGS - 1})) AS h)
  UNION ALL SELECT 'HLD-' || lpad(CAST((h + 1) % {HOLDINGS} AS VARCHAR), 3, '0'), 'HLD-' || lpad(CAST(h AS VARCHAR), 3, '0'), 0.375::DOUBLE, 'holding', ((h + 1) % {HOLDINGS}) % 9 = 0 FROM (SELECT unnest(generate_series(0, {HOLDINGS - 1})) AS h) WHERE h % 4 <> 3
  UNION ALL SELECT 'HLD-' || lpad(CAST(h - 1 AS VARCHAR), 3, '0'), 'HLD-' || lpad(CAST(h AS VARCHAR), 3, '0'), 0.25::DOUBLE, 'holding', (h - 1) % 9 = 0 FROM (SELECT unnest(generate_series(0, {HOLDINGS - 1})) AS h) WHERE h % 8 = 7
)"""
