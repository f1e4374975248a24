"""The plain relational steps that the larger queries are made of, each against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import FEATURES
from ..operators import cases
from ..operators import evaluation as ev
from ..operators.features import two_pass_zscore
from ..sources.parties import ENTITIES_SQL, OWNERSHIP_SQL, PROFILES_SQL, entities_from_customers, ownership_from_entities, profiles_from_entities
from ..sources.payments import EVENTS_SQL, LINEITEM_SQL, payments_from_lineitem
from .console import SOMEONE, someone
from .evaluation import AT, SCORED, scored1
from .queries import E_SQL, f1, p1, register

E = f"WITH {EVENTS_SQL}"
register("payments_events", p1, f"{E} SELECT * FROM transactions")
register("payments_lineitem", payments_from_lineitem, f"WITH {LINEITEM_SQL} SELECT * FROM transactions")
register("entities", entities_from_customers, f"WITH {ENTITIES_SQL} SELECT * FROM entities")
register("customer_profiles", lambda s, d: profiles_from_entities(entities_from_customers(s, d)), f"WITH {ENTITIES_SQL}, {PROFILES_SQL} SELECT * FROM profiles")
register("ownership_edges", lambda s, d: ownership_from_entities(entities_from_customers(s, d)), f"WITH {ENTITIES_SQL}, {OWNERSHIP_SQL} SELECT * FROM own")
register("counterparty_first_seen", lambda s, d: p1(s, d).where("counterparty_id != ''").groupBy("counterparty_id").agg(F.min("txn_epoch").alias("first_epoch")), f"{E} SELECT counterparty_id, MIN(txn_epoch) AS first_epoch FROM transactions WHERE counterparty_id <> '' GROUP BY 1")
register("pair_first_seen", lambda s, d: p1(s, d).where("counterparty_id != ''").groupBy("counterparty_id", "entity_id").agg(F.min("txn_epoch").alias("first_epoch")), f"{E} SELECT counterparty_id, entity_id, MIN(txn_epoch) AS first_epoch FROM transactions WHERE counterparty_id <> '' GROUP BY 1, 2")
register("naive_baseline", lambda s, d: p1(s, d).where("amount_cents > 1000000").select("transaction_id", "entity_id", "amount_cad"), f"{E} SELECT transaction_id, entity_id, amount_cad FROM transactions WHERE amount_cad > 10000")
register("band_deposits", lambda s, d: p1(s, d).where("is_cash = 1 AND direction = 'inbound' AND amount_cents BETWEEN 750000 AND 999999").select("transaction_id"), f"{E} SELECT transaction_id FROM transactions WHERE is_cash = 1 AND direction = 'inbound' AND amount_cents BETWEEN 750000 AND 999999")
register("average_rank", lambda s, d: ev.average_rank(p1(s, d).select("transaction_id", "amount_cents"), "amount_cents"), f"{E} SELECT transaction_id, amount_cents, (rank() OVER (ORDER BY amount_cents) + (COUNT(*) OVER (PARTITION BY amount_cents) - 1) / 2.0::DOUBLE) / COUNT(*) OVER () AS average_rank FROM transactions")
register("best_amount_f1", lambda s, d: ev.best_amount_f1(p1(s, d)), f"""{E} SELECT 2 * tp / CAST(flagged + p AS DOUBLE) AS best_f1, amount_cents AS threshold_cents FROM (
  SELECT amount_cents, SUM(SUM(is_suspicious)) OVER (ORDER BY amount_cents DESC) AS tp, SUM(COUNT(*)) OVER (ORDER BY amount_cents DESC) AS flagged, SUM(SUM(is_suspicious)) OVER () AS p FROM transactions GROUP BY 1) ORDER BY best_f1 DESC, amount_cents DESC LIMIT 1""")
register("entity_rollup", lambda s, d: ev.entity_rollup(scored1(s, d)), f"{SCORED} SELECT entity_id, MAX(risk_score) AS risk_score, MAX(is_suspicious) AS is_suspicious FROM scored GROUP BY 1")
register("top_deviations", lambda s, d: cases.top_deviations(scored1(s, d).join(f1(s, d).select("transaction_id", *FEATURES), "transaction_id"), someone(s, d), 8).select("feature", "deviation_sigma"),
  f"{SCORED}, sf AS (SELECT s.entity_id AS who, s.risk_score AS rs, f.* FROM scored s JOIN features f ON f.transaction_id = s.transaction_id), pk AS (SELECT * FROM sf WHERE who = {SOMEONE} ORDER BY rs DESC, txn_epoch, transaction_id LIMIT 1), dv AS ("
  + " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN sd > 0 THEN round((pk.{c} - m) / sd, 2) ELSE 0.0::DOUBLE END AS deviation_sigma FROM pk, (SELECT AVG({c}) AS m, stddev_pop({c}) AS sd FROM features)" for c in FEATURES)
  + ") SELECT * FROM dv ORDER BY abs(deviation_sigma) DESC, feature LIMIT 8")
register("two_pass_zscore", lambda s, d: two_pass_zscore(p1(s, d)).withColumn("zscore", F.round("zscore", 6)), f"{E_SQL} SELECT transaction_id, round(amount_zscore_entity, 6) AS zscore FROM features")
register("flagged_not_naive", lambda s, d: scored1(s, d).where(F.col("risk_score") >= AT).select("entity_id").exceptAll(scored1(s, d).where("amount_cents > 1000000").select("entity_id")), f"{SCORED} SELECT entity_id FROM scored WHERE risk_score >= {AT} EXCEPT ALL SELECT entity_id FROM scored WHERE amount_cents > 1000000")
