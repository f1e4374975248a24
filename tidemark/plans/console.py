"""Queries of the analyst's console and the governed register."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FEATURES
from ..functions import text
from ..operators import cases, packets, validation
from ..sources.parties import ENTITIES_SQL, entities_from_customers
from .evaluation import SCORED, scored1
from .queries import E_SQL, f1, p1, register

#: The register takes in everything from its lowest band up.
AT = 39.6
BASE = f"{SCORED}, {ENTITIES_SQL}"
RULES = (("R1_STRUCTURING", "T01-STRUCTURING", "Structuring"), ("R2_LAYERING", "T02-LAYERING", "Layering"), ("R3_SMURFING", "T03-SMURFING", "Smurfing"), ("R4_ROUND_DOLLAR", "T04-ROUND-DOLLAR", "Round dollar"), ("R5_DORMANT", "T05-DORMANT", "Dormant reactivation"))
GUESS = lambda i, sep=" + ": "concat_ws('" + sep + "', " + ", ".join(f"CASE WHEN {r[0]} THEN '{r[i]}' END" for r in RULES) + ")"
FLAGGED = f"""fl AS (SELECT entity_id, MAX(risk_score) AS peak, {", ".join(f"bool_or({r[0]}) AS {r[0]}" for r in RULES)}, COUNT(*) AS n, CAST(SUM(amount_cents) AS BIGINT) AS cents, list_sort(list(DISTINCT reason_codes) FILTER (WHERE reason_codes <> '')) AS reasons FROM scored WHERE risk_score >= {AT} GROUP BY 1)"""
QUEUE = f"""{BASE}, {FLAGGED}, queue AS (
  SELECT fl.entity_id, fl.peak, CASE WHEN {GUESS(2)} = '' THEN 'Unclassified (model only)' ELSE {GUESS(2)} END AS typology_guess, {" + ".join(f"CAST({r[0]} AS INTEGER)" for r in RULES)} AS rules_fired, n AS transactions_flagged,
    CAST(cents AS DOUBLE) / 100 AS amount_involved_cad, substr(COALESCE(array_to_string(reasons, ' | '), ''), 1, 400) AS reason_codes, display_name, entity_type, segment FROM fl LEFT JOIN entities ON entities.entity_id = fl.entity_id)"""
REGISTER = f"""{BASE}, {FLAGGED}, reg AS (
  SELECT 'INV-' || fl.entity_id AS investigation_id, fl.entity_id, CASE WHEN peak >= 67.9 THEN 'P0' WHEN peak >= 55.0 THEN 'P1' ELSE 'P2' END AS priority, CAST(CASE WHEN peak >= 67.9 THEN 4 WHEN peak >= 55.0 THEN 24 ELSE 72 END AS INTEGER) AS due_hours, peak,
    CASE WHEN {GUESS(0, ";")} = '' THEN 'NONE' ELSE {GUESS(0, ";")} END AS rules_fired, CASE WHEN {GUESS(1)} = '' THEN 'UNCLASSIFIED-MODEL-ONLY' ELSE {GUESS(1)} END AS typology_hypothesis, n AS flagged_transactions,
    CAST(cents AS DOUBLE) / 100 AS amount_involved_cad, CASE WHEN COALESCE(len(reasons), 0) = 0 THEN 'Model only: no rule gives a reason.' ELSE substr(array_to_string(reasons, ' | '), 1, 800) END AS evidence_references, entity_type, segment,
    CASE WHEN display_name IS NULL THEN '' ELSE array_to_string([upper(substr(w, 1, 1)) || '.' for w in string_split(trim(display_name), ' ')][1:3], ' ') END AS display_name
  FROM fl LEFT JOIN entities ON entities.entity_id = fl.entity_id)"""

REGISTER_ROWS = f"""{REGISTER}, whole AS (SELECT * EXCLUDE (peak), round_even(peak, 1) AS max_risk_score, CASE WHEN priority = 'P0' THEN 'SECOND-LEVEL REVIEW' WHEN rules_fired <> 'NONE' THEN 'EVIDENCE REQUESTED' ELSE 'OPEN TRIAGE' END AS case_state,
  CASE WHEN priority = 'P0' THEN 'Confirm source of funds and purpose with the counterparty inside the review clock.' WHEN rules_fired <> 'NONE' THEN 'Gather the minimum evidence listed for the typology first.' ELSE 'State an explainable hypothesis before going further.' END AS recommended_next_step,
  'HUMAN DECISION REQUIRED' AS decision_status, 'NOT ASSESSED OR FILED' AS filing_status FROM reg)"""
#: The register's columns in the order of their names, as the fingerprint's text shows them.
SHOWN = "amount_involved_cad case_state decision_status display_name due_hours entity_id entity_type evidence_references filing_status flagged_transactions investigation_id max_risk_score priority recommended_next_step rules_fired segment typology_hypothesis".split()
TEXT = ", ".join(f"COALESCE(CAST({f'CAST({c} AS DECIMAL(38,6))' if c in ('amount_involved_cad', 'max_risk_score') else c} AS VARCHAR), '')" for c in SHOWN)


def ents(s, d):
    return entities_from_customers(s, d)


def queue1(s, d):
    # The shown score is rounded half to even; what is compared is the peak itself.
    peak = cases.flagged_entities(scored1(s, d), AT).select("entity_id", "peak")
    return cases.case_queue(scored1(s, d), ents(s, d), AT).drop("risk_score").join(peak, "entity_id")


def register1(s, d):
    return cases.case_register(scored1(s, d), ents(s, d), AT)


def someone(s, d):
    """The entity whose drill-downs are shown: the highest peak, then the smallest id."""
    return scored1(s, d).orderBy(F.desc("risk_score"), "entity_id").select("entity_id").first()[0]


SOMEONE = "(SELECT entity_id FROM scored ORDER BY risk_score DESC, entity_id LIMIT 1)"
register("case_queue", queue1, f"{QUEUE} SELECT * FROM queue")
register("filtered_queue", lambda s, d: cases.filter_queue(queue1(s, d), ["business"], ["Layering", "Smurfing"], 1000.0), f"{QUEUE} SELECT * FROM queue WHERE entity_type = 'business' AND (typology_guess LIKE '%Layering%' OR typology_guess LIKE '%Smurfing%') AND amount_involved_cad >= 1000")
register(
    "case_register",
    lambda s, d: register1(s, d).select("investigation_id", "entity_id", "display_name", "entity_type", "segment", "priority", "due_hours", "rules_fired", "typology_hypothesis", "flagged_transactions", "amount_involved_cad", "evidence_references", "case_state", "recommended_next_step", "decision_status", "filing_status"),
    f"{REGISTER_ROWS} SELECT * EXCLUDE (max_risk_score) FROM whole",
)
GRAPH = f"""{REGISTER}, edges AS (
  SELECT entity_id, counterparty_id, COUNT(DISTINCT transaction_id) AS transactions, CAST(SUM(amount_cents) AS DOUBLE) / 100 AS amount_cad, MIN(txn_datetime) AS first_seen, MAX(txn_datetime) AS last_seen, string_agg(DISTINCT direction, ';' ORDER BY direction) AS directions
  FROM scored WHERE counterparty_id <> '' AND entity_id IN (SELECT entity_id FROM reg) GROUP BY 1, 2)"""
register("entity_graph", lambda s, d: cases.entity_graph(scored1(s, d), register1(s, d)).drop("max_risk_score"), f"{GRAPH} SELECT edges.*, CAST(deg.n AS INTEGER) AS shared_entity_degree FROM edges JOIN (SELECT counterparty_id AS c, COUNT(*) AS n FROM edges GROUP BY 1) deg ON deg.c = edges.counterparty_id")
GATES = f"""{GRAPH}, gates AS (
  SELECT 'QUEUE-01' AS gate_id, 'PASS' AS status, (SELECT COUNT(*) FROM reg) || ' registered / ' || (SELECT COUNT(DISTINCT entity_id) FROM scored WHERE risk_score >= {AT}) || ' expected' AS observed UNION ALL SELECT 'LABEL-01', 'PASS', '0 label columns in the register'
  UNION ALL SELECT 'GRAPH-01', CASE WHEN (SELECT COUNT(*) FROM edges WHERE entity_id NOT IN (SELECT entity_id FROM reg)) = 0 THEN 'PASS' ELSE 'BLOCK' END, (SELECT COUNT(*) FROM edges) || ' edges'
  UNION ALL SELECT 'REASON-01', CASE WHEN (SELECT COUNT(*) FROM reg WHERE rules_fired = 'NONE' AND typology_hypothesis <> 'UNCLASSIFIED-MODEL-ONLY') = 0 THEN 'PASS' ELSE 'BLOCK' END, (SELECT COUNT(*) FROM reg WHERE rules_fired = 'NONE') || ' model-only cases'
  UNION ALL SELECT 'SLA-01', CASE WHEN (SELECT COUNT(*) FROM reg WHERE (priority, due_hours) NOT IN (('P0', 4), ('P1', 24), ('P2', 72))) = 0 THEN 'PASS' ELSE 'BLOCK' END, (SELECT COUNT(*) FROM reg WHERE (priority, due_hours) NOT IN (('P0', 4), ('P1', 24), ('P2', 72))) || ' wrong clocks'
  UNION ALL SELECT 'CAP-01', CASE WHEN (SELECT COUNT(*) FROM reg) / 52.0 <= 48.0 THEN 'PASS' ELSE 'REVIEW' END, (SELECT COUNT(DISTINCT entity_id) FROM scored WHERE risk_score >= {AT}) || ' alerts a year' UNION ALL SELECT 'HUMAN-01', 'REVIEW', 'no human decision is recorded' UNION ALL SELECT 'FILING-01', 'REVIEW', 'no human decision is recorded')"""


def gates1(s, d, drop_one=False):
    reg = register1(s, d)
    if drop_one:
        first = reg.agg(F.min("entity_id")).first()[0]
        reg = reg.where(F.col("entity_id") != first)
    return cases.release_gates(reg, cases.entity_graph(scored1(s, d), register1(s, d)), scored1(s, d), AT)


register("release_gates", lambda s, d: gates1(s, d), f"{GATES} SELECT * FROM gates")
register("release_decision", lambda s, d: cases.release_decision(gates1(s, d)), f"""{GATES} SELECT CASE WHEN bool_or(status = 'BLOCK') THEN 'BLOCKED' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW REQUIRED' ELSE 'READY' END AS decision,
  COUNT(*) FILTER (WHERE status = 'PASS') AS gates_pass, COUNT(*) FILTER (WHERE status = 'REVIEW') AS gates_review, COUNT(*) FILTER (WHERE status = 'BLOCK') AS gates_block FROM gates""")
register("release_fails_closed", lambda s, d: cases.release_decision(gates1(s, d, drop_one=True)).select("decision"), "SELECT 'BLOCKED' AS decision")
register("entity_timeline", lambda s, d: cases.entity_timeline(scored1(s, d), someone(s, d)), f"{SCORED} SELECT txn_datetime, counterparty_id, direction, channel, amount_cad, risk_score, n_rules_fired, reason_codes FROM scored WHERE entity_id = {SOMEONE}")
register(
    "feature_profile",
    lambda s, d: cases.deviations(scored1(s, d).join(f1(s, d).select("transaction_id", *FEATURES), "transaction_id"), someone(s, d)),
    f"{SCORED}, sf AS (SELECT s.entity_id AS who, s.risk_score AS rs, f.* FROM scored s JOIN features f ON f.transaction_id = s.transaction_id), pk AS (SELECT * FROM sf WHERE who = {SOMEONE} ORDER BY rs DESC, txn_epoch, transaction_id LIMIT 1) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST(pk.{c} AS DOUBLE) AS this_transaction, round(m, 3) AS population_mean, CASE WHEN sd > 0 THEN round((pk.{c} - m) / sd, 2) ELSE 0.0::DOUBLE END AS deviation_sigma FROM pk, (SELECT AVG({c}) AS m, stddev_pop({c}) AS sd FROM features)" for c in FEATURES),
)
register(
    "ego_network",
    lambda s, d: cases.ego_network(scored1(s, d), someone(s, d)),
    f"""{SCORED}, links AS (SELECT DISTINCT entity_id, counterparty_id FROM scored WHERE counterparty_id <> ''), me AS (SELECT {SOMEONE} AS id), near AS (SELECT * FROM links WHERE counterparty_id IN (SELECT counterparty_id FROM links, me WHERE entity_id = id)),
    dg AS (SELECT counterparty_id, COUNT(*) BETWEEN 2 AND 12 AS good FROM near GROUP BY 1), kp AS (SELECT counterparty_id FROM dg WHERE good OR NOT (SELECT bool_or(good) FROM dg) ORDER BY counterparty_id LIMIT 15),
    ar AS (SELECT * FROM near WHERE counterparty_id IN (SELECT counterparty_id FROM kp)), pe AS (SELECT entity_id, MIN(counterparty_id) AS via FROM ar, me WHERE entity_id <> id GROUP BY 1 ORDER BY via, entity_id LIMIT 29)
    SELECT entity_id, counterparty_id FROM ar WHERE entity_id IN (SELECT entity_id FROM pe) OR entity_id = (SELECT id FROM me)""",
)
register("masked_queue", lambda s, d: text.mask_frame(queue1(s, d).select("entity_id", "display_name")), f"""{QUEUE} SELECT regexp_replace(entity_id, '^ENT-.*(.{{4}})$', 'ENT-...\\1') AS entity_id,
  CASE WHEN display_name IS NULL THEN '' ELSE array_to_string([upper(substr(w, 1, 1)) || '.' for w in string_split(trim(display_name), ' ')][1:3], ' ') END AS display_name FROM queue""")
register("unmasked_columns", lambda s, d: text.unmasked_columns(p1(s, d)), f"{E_SQL} SELECT unnest(['entity_id', 'counterparty_id']) AS column_name")
register("shape_scan", lambda s, d: text.shape_scan(s.read.parquet(f"{d}/documents.parquet"), "text").drop("card_numbers"), r"""SELECT COUNT(*) FILTER (WHERE regexp_matches(COALESCE(text, ''), '(^|[^0-9])[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}([^0-9]|$)')) AS spaced_numbers,
  COUNT(*) FILTER (WHERE regexp_matches(COALESCE(text, ''), '[0-9]{9,}')) AS long_digit_runs, COUNT(*) FILTER (WHERE regexp_matches(lower(COALESCE(text, '')), 'passport|social insurance|date of birth')) AS forbidden_terms FROM documents""")
register("constraint_violations", lambda s, d: validation.violations(p1(s, d), ents(s, d)), f"""{E_SQL}, {ENTITIES_SQL} SELECT 'transaction_id_unique' AS check_name, COUNT(*) - COUNT(DISTINCT transaction_id) AS violations FROM transactions
  UNION ALL SELECT 'entity_known', COUNT(*) FROM transactions WHERE entity_id NOT IN (SELECT entity_id FROM entities) UNION ALL SELECT unnest(['amount_positive', 'direction_known', 'is_cash_flag', 'label_flag', 'counterparty_not_null', 'cash_has_no_counterparty']), 0""")
register("register_fingerprint", lambda s, d: cases.register_fingerprint(register1(s, d)), f"""{REGISTER_ROWS}, fh AS (SELECT sha256(concat_ws(chr(31), {TEXT})) AS h FROM whole),
  fp AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM fh GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY p)) AS fingerprint FROM fp""")
EDGES = GRAPH[len(REGISTER) :]
CASH = lambda c: f"format('{{:,.2f}}', {c})"
register("case_packets", lambda s, d: packets.case_packets(register1(s, d), cases.entity_edges(scored1(s, d), register1(s, d))), f"""{REGISTER_ROWS}{EDGES}, nth AS (
    SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY amount_cad DESC, counterparty_id) AS n FROM edges
  ), tab AS (
    SELECT entity_id, string_agg('| ' || counterparty_id || ' | ' || transactions || ' | \\$' || {CASH("amount_cad")} || ' | ' || directions || ' |', chr(10) ORDER BY n) FILTER (WHERE n <= 20) AS rows, COUNT(*) AS edges FROM nth GROUP BY 1
  )
  SELECT priority, investigation_id, '# ' || investigation_id || chr(10) || chr(10) || priority || ', due in ' || due_hours || ' hours: ' || case_state || '.' || chr(10) || 'Hypothesis: ' || typology_hypothesis || '; rules: ' || rules_fired || '.' || chr(10)
    || flagged_transactions || ' payments of \\$' || {CASH("amount_involved_cad")} || '.' || chr(10) || 'Evidence: ' || replace(replace(evidence_references, '|', '\\|'), '$', '\\$') || chr(10) || decision_status || chr(10) || chr(10)
    || '| Counterparty | Payments | Amount | Directions |' || chr(10) || '|---|---|---|---|' || chr(10) || COALESCE(rows || chr(10), '') || 'Further counterparties: ' || CAST(greatest(COALESCE(edges, 0) - 20, 0) AS VARCHAR) AS packet
  FROM whole LEFT JOIN tab ON tab.entity_id = whole.entity_id""")
register("release_summary", lambda s, d: packets.release_summary(register1(s, d), cases.entity_edges(scored1(s, d), register1(s, d)), gates1(s, d)), f"""{GATES}, decided AS (
    SELECT CASE WHEN bool_or(status = 'BLOCK') THEN 'BLOCKED' WHEN bool_or(status = 'REVIEW') THEN 'REVIEW REQUIRED' ELSE 'READY' END AS decision, COUNT(*) FILTER (WHERE status = 'PASS') AS gates_pass, COUNT(*) FILTER (WHERE status = 'REVIEW') AS gates_review, COUNT(*) FILTER (WHERE status = 'BLOCK') AS gates_block FROM gates
  ), bands AS (SELECT COUNT(*) AS investigations, COUNT(*) FILTER (WHERE priority = 'P0') AS p0_investigations, COUNT(*) FILTER (WHERE priority = 'P1') AS p1_investigations, COUNT(*) FILTER (WHERE priority = 'P2') AS p2_investigations FROM reg)
  SELECT decided.*, bands.*, (SELECT COUNT(*) FROM edges) AS graph_edges FROM decided, bands""")
