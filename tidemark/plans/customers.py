"""Queries of customer risk and beneficial ownership."""

from __future__ import annotations

from ..config import KycConfig
from ..operators import customers as c
from ..sources.parties import ENTITIES_SQL, OWNERSHIP_SQL, PROFILES_SQL, entities_from_customers, ownership_from_entities, profiles_from_entities
from .queries import E_RULES, held, hits1, p1, register

K = KycConfig()
ALL = f"{E_RULES.replace('WITH', 'WITH RECURSIVE', 1)}, {ENTITIES_SQL}, {PROFILES_SQL}, {OWNERSHIP_SQL}"
CHAINS = """
walk AS (
  SELECT entity_id, entity_id AS node, 'holding' AS kind, 1.0::DOUBLE AS product, [entity_id] AS chain, FALSE AS loop, FALSE AS opaque FROM entities WHERE entity_type = 'business'
  UNION ALL
  SELECT w.entity_id, o.owner, o.owner_type, w.product * o.share, list_append(w.chain, o.owner), list_contains(w.chain, o.owner), o.owner_opaque_jurisdiction
  FROM walk w JOIN own o ON o.owned = w.node WHERE w.kind <> 'person' AND NOT w.loop
), per AS (
  SELECT entity_id, node AS person_id, SUM(product) AS share, COUNT(*) AS chains, MIN(array_to_string(chain, ' <- ')) AS example_chain, MAX(len(chain) - 1) AS depth FROM walk WHERE kind = 'person' AND NOT loop GROUP BY 1, 2
), ownf AS (
  SELECT e.entity_id, COALESCE(n, 0) AS beneficial_owners, COALESCE(layers, 0) AS layers, COALESCE(layers, 0) >= 2 AS layered_ownership, COALESCE(opq, FALSE) AS opaque_jurisdiction, COALESCE(cir, FALSE) AS circular_ownership, COALESCE(n, 0) = 0 AS no_25pct_owner, round(COALESCE(acc, 0), 6) AS accounted_share
  FROM (SELECT entity_id FROM entities WHERE entity_type = 'business') e
  LEFT JOIN (SELECT entity_id AS a, COUNT(*) FILTER (WHERE share >= 0.25 - 1e-12) AS n, CAST(MAX(depth) AS INTEGER) AS layers, SUM(share) AS acc FROM per GROUP BY 1) x ON a = e.entity_id
  LEFT JOIN (SELECT entity_id AS b, bool_or(loop) AS cir, bool_or(opaque AND NOT loop) AS opq FROM walk WHERE len(chain) > 1 GROUP BY 1) y ON b = e.entity_id
)"""
ACTIVITY = """
act AS (
  SELECT entity_id AS aid, COALESCE(SUM(CASE WHEN direction = 'inbound' THEN amount_cents END), 0) / 100.0::DOUBLE / m AS actual_monthly_inflow_cad,
    COALESCE(CAST(SUM(CASE WHEN direction = 'inbound' AND is_cash = 1 THEN amount_cents END) AS DOUBLE) / SUM(CASE WHEN direction = 'inbound' THEN amount_cents END), 0.0::DOUBLE) AS cash_share_of_inflows,
    COALESCE(CAST(SUM(CASE WHEN direction <> 'inbound' AND channel = 'wire' THEN amount_cents END) AS DOUBLE) / SUM(CASE WHEN direction <> 'inbound' THEN amount_cents END), 0.0::DOUBLE) AS wire_share_of_outflows
  FROM transactions, (SELECT greatest(1.0::DOUBLE, (MAX(txn_epoch) - MIN(txn_epoch)) / (86400 * 30.4375::DOUBLE)) AS m FROM transactions) GROUP BY entity_id, m
)"""
SEG = "CASE segment " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.segment_points.items()) + " END"
FACTORS = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN {cond} THEN '{name} +{points}' END" for name, cond, points in (
        ("business", "e.entity_type = 'business'", 1), ("SEGMENT", "", 0), ("domestic_pep_or_hio", "pep_status = 'domestic_pep_or_hio'", 2), ("non_face_to_face", "onboarding_channel = 'non_face_to_face'", 1), ("adverse_media", "adverse_media", 3),
        ("layered_ownership", "layered_ownership", 2), ("opaque_jurisdiction", "opaque_jurisdiction", 2), ("no_25pct_owner", "no_25pct_owner", 1),
        ("activity_over_3x_declared", "COALESCE(actual_monthly_inflow_cad, 0) / declared_monthly_inflow_cad > 3", 2), ("activity_over_1_5x_declared", "COALESCE(actual_monthly_inflow_cad, 0) / declared_monthly_inflow_cad > 1.5 AND COALESCE(actual_monthly_inflow_cad, 0) / declared_monthly_inflow_cad <= 3", 1),
        ("cash_over_half_of_inflows", "cash_share_of_inflows > 0.5", 1), ("wires_over_fifth_of_outflows", "wire_share_of_outflows > 0.2", 1),
        ("monitoring_alert", "e.entity_id IN (SELECT t.entity_id FROM transactions t JOIN rule_hits h ON h.transaction_id = t.transaction_id WHERE n_rules_fired > 0)", 2),
    )
) + ")"
FACTORS = FACTORS.replace("CASE WHEN  THEN 'SEGMENT +0' END", f"CASE WHEN {SEG} > 0 THEN 'segment:' || segment || ' +' || {SEG} END")
EDD = """concat_ws(' | ', CASE WHEN pep_status = 'foreign_pep' THEN 'foreign PEP: source of funds, senior approval, enhanced monitoring' END, CASE WHEN refresh_rating = 'High' THEN 'high risk: enhanced measures and monitoring' END,
  CASE WHEN biz AND noown THEN 'no owner at the line: verify the most senior managing officer' END, CASE WHEN biz AND circ THEN 'circular ownership: obtain the structure chart' END)"""
RISK = f"""{ALL}, {CHAINS}, {ACTIVITY}, base AS (
  SELECT e.entity_id, e.entity_type, e.segment, p.pep_status, p.declared_monthly_inflow_cad, COALESCE(actual_monthly_inflow_cad, 0.0::DOUBLE) AS actual_monthly_inflow_cad, e.entity_type = 'business' AS biz, COALESCE(no_25pct_owner, FALSE) AS noown, COALESCE(circular_ownership, FALSE) AS circ, {FACTORS} AS factors,
    CASE WHEN e.entity_type = 'business' THEN 1 ELSE 0 END + {SEG} + CASE WHEN pep_status = 'domestic_pep_or_hio' THEN 2 ELSE 0 END + CASE WHEN onboarding_channel = 'non_face_to_face' THEN 1 ELSE 0 END + CASE WHEN adverse_media THEN 3 ELSE 0 END
      + CASE WHEN layered_ownership THEN 2 ELSE 0 END + CASE WHEN opaque_jurisdiction THEN 2 ELSE 0 END + CASE WHEN no_25pct_owner THEN 1 ELSE 0 END AS onp,
    CASE WHEN COALESCE(actual_monthly_inflow_cad, 0) / declared_monthly_inflow_cad > 3 THEN 2 WHEN COALESCE(actual_monthly_inflow_cad, 0) / declared_monthly_inflow_cad > 1.5 THEN 1 ELSE 0 END + CASE WHEN cash_share_of_inflows > 0.5 THEN 1 ELSE 0 END
      + CASE WHEN wire_share_of_outflows > 0.2 THEN 1 ELSE 0 END + CASE WHEN e.entity_id IN (SELECT t.entity_id FROM transactions t JOIN rule_hits h ON h.transaction_id = t.transaction_id WHERE n_rules_fired > 0) THEN 2 ELSE 0 END AS more
  FROM entities e JOIN profiles p ON p.entity_id = e.entity_id LEFT JOIN ownf f ON f.entity_id = e.entity_id LEFT JOIN act ON aid = e.entity_id
), risk AS (
  SELECT *, CAST(onp AS INTEGER) AS onboarding_points, CAST(onp + more AS INTEGER) AS refresh_points, CASE WHEN pep_status = 'foreign_pep' OR onp >= 6 THEN 'High' WHEN onp >= 3 THEN 'Medium' ELSE 'Low' END AS onboarding_rating,
    CASE WHEN pep_status = 'foreign_pep' OR onp + more >= 6 THEN 'High' WHEN onp + more >= 3 THEN 'Medium' ELSE 'Low' END AS refresh_rating FROM base
), risk2 AS (
  SELECT *, pep_status = 'foreign_pep' OR refresh_rating = 'High' OR (biz AND noown) OR (biz AND circ) AS edd_required, {EDD} AS edd_reasons, CASE refresh_rating WHEN 'High' THEN '2027-07-31' WHEN 'Medium' THEN '2028-07-31' ELSE '2029-07-31' END AS next_review FROM risk)"""


def ents(s, d):
    return entities_from_customers(s, d)


def owners1(s, d):
    return c.beneficial_owners(ents(s, d), ownership_from_entities(ents(s, d)))


def make_risk(s, d):
    e = ents(s, d)
    alerted = hits1(s, d).where("n_rules_fired > 0").join(p1(s, d).select("transaction_id", "entity_id"), "transaction_id").select("entity_id")
    return c.rate(e, profiles_from_entities(e), owners1(s, d)[1], c.activity(p1(s, d)), alerted)


def risk1(s, d):
    return held(s, d, "customer-risk", lambda: make_risk(s, d))


register("beneficial_owners", lambda s, d: owners1(s, d)[0], f"{ALL}, {CHAINS} SELECT entity_id, person_id, round(share, 6) AS effective_share, share >= 0.25 - 1e-12 AS is_beneficial_owner, chains, example_chain FROM per")
register("ownership_flags", lambda s, d: owners1(s, d)[1], f"{ALL}, {CHAINS} SELECT * FROM ownf")
register("activity_ratios", lambda s, d: c.activity(p1(s, d)), f"{ALL}, {ACTIVITY} SELECT aid AS entity_id, * EXCLUDE (aid) FROM act")
register("customer_risk", lambda s, d: risk1(s, d), f"{RISK} SELECT entity_id, entity_type, segment, pep_status, onboarding_points, onboarding_rating, refresh_points, refresh_rating, declared_monthly_inflow_cad, actual_monthly_inflow_cad, factors, edd_required, edd_reasons, next_review FROM risk2")
register("rating_migration", lambda s, d: c.migration(risk1(s, d)), f"""{RISK} SELECT r AS onboarding_rating, COUNT(*) FILTER (WHERE refresh_rating = 'Low') AS "Low", COUNT(*) FILTER (WHERE refresh_rating = 'Medium') AS "Medium", COUNT(*) FILTER (WHERE refresh_rating = 'High') AS "High"
  FROM (SELECT unnest(['Low', 'Medium', 'High']) AS r) LEFT JOIN risk2 ON onboarding_rating = r GROUP BY 1""")
register("rating_counts", lambda s, d: c.rating_counts(risk1(s, d), "refresh_rating"), f"{RISK} SELECT r AS rating, COUNT(entity_id) AS customers FROM (SELECT unnest(['Low', 'Medium', 'High']) AS r) LEFT JOIN risk2 ON refresh_rating = r GROUP BY 1")
register("edd_histogram", lambda s, d: c.edd_histogram(risk1(s, d)), f"""{RISK} SELECT reason, COUNT(*) AS customers FROM (SELECT 'foreign PEP' AS reason FROM risk2 WHERE pep_status = 'foreign_pep' UNION ALL SELECT 'high risk' FROM risk2 WHERE refresh_rating = 'High'
  UNION ALL SELECT 'no owner at the line' FROM risk2 WHERE biz AND noown UNION ALL SELECT 'circular ownership' FROM risk2 WHERE biz AND circ) GROUP BY 1""")
register("customer_summary", lambda s, d: c.summary(risk1(s, d), owners1(s, d)[1], owners1(s, d)[0]), f"""{RISK} SELECT (SELECT COUNT(*) FROM risk2) AS customers, (SELECT COUNT(*) FROM risk2 WHERE edd_required) AS edd_required, (SELECT COUNT(*) FROM risk2 WHERE pep_status <> 'none') AS peps,
  (SELECT COUNT(*) FROM ownf) AS businesses, (SELECT COUNT(*) FROM ownf WHERE layered_ownership) AS layered, (SELECT COUNT(*) FROM ownf WHERE opaque_jurisdiction) AS opaque, (SELECT COUNT(*) FROM ownf WHERE no_25pct_owner) AS without_owner, (SELECT COUNT(*) FROM ownf WHERE circular_ownership) AS circular,
  (SELECT COUNT(*) FROM per WHERE share >= 0.25 - 1e-12) AS beneficial_owner_links, (SELECT COUNT(*) FROM (SELECT person_id FROM per WHERE share >= 0.25 - 1e-12 GROUP BY 1 HAVING COUNT(DISTINCT entity_id) >= 2)) AS persons_owning_two_or_more""")
