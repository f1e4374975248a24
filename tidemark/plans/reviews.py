"""Review notes on the registered cases, drafted from the register and the graph with faults by the entity's number, and their assessment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases, notes
from .console import GRAPH, register1
from .evaluation import scored1
from .queries import register

#: Kinds of drafts: 0, 7 and 8 are sound; a sound one cites its case or (7) its first counterparty; 8 has label words as values only.
KINDS = 13
LABEL = "chr(92) || 'u0063ase_id'"  # the key of a label, its first letter as an escape
#: The JSON of a note, in SQL that Spark and the oracle read alike: from investigation_id, rules_fired, first_cp and k.
DRAFT = f"""'{{"schema_version": ' || CASE k WHEN 1 THEN '2' ELSE '1' END || ', "investigation_id": "' || CASE k WHEN 2 THEN 'INV-0' ELSE investigation_id END || '", "observed_facts": ['
  || CASE k WHEN 3 THEN '' ELSE '{{"observation": "' || CASE k WHEN 4 THEN ' ' WHEN 8 THEN chr(92) || '"case_id' || chr(92) || '": typology' ELSE rules_fired END || '", "source_ref": "'
    || CASE k WHEN 5 THEN 'counterparty:none' WHEN 7 THEN COALESCE('counterparty:' || first_cp, 'register:' || investigation_id) ELSE 'register:' || investigation_id END || '"}}' END
  || '], "alternative_explanation": "Ordinary trade.", "discriminator": "Contracts.", "more": ["Contracts", {{"' || CASE k WHEN 6 THEN {LABEL} ELSE 'kept' END || '": 1}}], "analysis": "' || CASE k WHEN 9 THEN '' ELSE 'Amounts repeat.' END
  || '", "recommended_next_step": "Ask.", "missing_evidence": ' || CASE k WHEN 10 THEN '"contracts"' ELSE '["contracts"]' END || ', "recommendation": "' || CASE k WHEN 11 THEN 'propose_closure' ELSE 'request_information' END
  || '", "human_approved": ' || CASE k WHEN 12 THEN 'true' ELSE 'false' END || ', "filing_status": "NOT FILED"}}'"""


def drafts(investigations: DataFrame, graph: DataFrame) -> DataFrame:
    """(draft, note)."""
    first = graph.groupBy("entity_id").agg(F.min("counterparty_id").alias("first_cp"))
    rows = investigations.join(first, "entity_id", "left").withColumn("k", F.substring("entity_id", 5, 20).cast("int") % KINDS)
    return rows.select(F.col("investigation_id").alias("draft"), F.expr(DRAFT).alias("note"))


def review_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = register1(spark, sf_dir)
    graph = cases.entity_graph(scored1(spark, sf_dir), reg)
    found = notes.assess(drafts(reg, graph), reg, notes.case_references(reg, graph))
    return found.select("draft", "investigation_id", F.array_join("problems", "; ").alias("problems"), "status")


TEXT = lambda c: f"json_type(note, '$.{c}') = 'VARCHAR' AND regexp_matches(json_extract_string(note, '$.{c}'), '[^ ]')"
MUSTS = {
    "not a version 1 note": "json_extract_string(note, '$.schema_version') = '1'", "unknown investigation": "inv IN (SELECT investigation_id FROM reg)",
    "holds a label key": f"NOT EXISTS (SELECT 1 FROM json_tree(note) t WHERE t.key IN {notes.PROHIBITED})", "unknown recommendation": f"json_extract_string(note, '$.recommendation') IN {notes.RECOMMENDATIONS}",
    "no facts": "json_array_length(note, '$.observed_facts') > 0",
    "a fact without an observation": "NOT EXISTS (SELECT 1 FROM facts f WHERE f.draft = d.draft AND NOT regexp_matches(observation, '[^ ]'))",
    "unknown references": "NOT EXISTS (SELECT 1 FROM facts f WHERE f.draft = d.draft AND (f.inv, f.ref) NOT IN (SELECT investigation_id, ref FROM refs))",
    "a text field is empty": " AND ".join(TEXT(c) for c in notes.TEXTS), "missing evidence is not a list of texts": "json_type(note, '$.missing_evidence') = 'ARRAY'",
    "closes while evidence is missing": "NOT (json_extract_string(note, '$.recommendation') = 'propose_closure' AND json_array_length(note, '$.missing_evidence') > 0)",
    "claims approval or a filing": "json_extract_string(note, '$.human_approved') = 'false' AND json_extract_string(note, '$.filing_status') = 'NOT FILED'",
}
register("review_notes", review_notes, f"""{GRAPH}, cps AS (SELECT entity_id, MIN(counterparty_id) AS first_cp FROM edges GROUP BY 1),
  refs AS (SELECT investigation_id, 'register:' || investigation_id AS ref FROM reg UNION ALL SELECT investigation_id, 'counterparty:' || counterparty_id FROM edges JOIN reg USING (entity_id)),
  based AS (SELECT reg.*, first_cp, CAST(substr(reg.entity_id, 5) AS INTEGER) % {KINDS} AS k FROM reg LEFT JOIN cps ON cps.entity_id = reg.entity_id),
  d AS (SELECT investigation_id AS draft, {DRAFT} AS note FROM based), dn AS (SELECT *, json_extract_string(note, '$.investigation_id') AS inv FROM d),
  facts AS (SELECT draft, inv, json_extract_string(x, '$.observation') AS observation, json_extract_string(x, '$.source_ref') AS ref FROM (SELECT draft, inv, unnest(json_extract(note, '$.observed_facts[*]')) AS x FROM dn)),
  found AS (SELECT draft, inv, concat_ws('; ', {", ".join(f"CASE WHEN ({must}) THEN NULL ELSE '{problem}' END" for problem, must in MUSTS.items())}) AS problems FROM dn d)
  SELECT draft, inv AS investigation_id, problems, CASE WHEN problems = '' THEN 'READY FOR REVIEW' ELSE 'BLOCKED' END AS status FROM found""")
