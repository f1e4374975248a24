import random

import pytest
from pyspark.sql import functions as F

from helpers import T0, frame, pay
from tidemark.config import RULES, ScoreConfig
from tidemark.functions import text
from tidemark.operators import cases, evaluation, notes, validation
from tidemark.operators.running import with_ranked
from tidemark.sources import files


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(6)
    rows, extra = [], []
    for k in range(400):
        y = int(rng.random() < 0.15)
        rows.append(pay(k, f"ENT-{rng.randrange(40):05d}", "" if k % 9 == 0 else f"CPT-{rng.randrange(25):05d}", T0 + k * 7200, rng.randint(100, 2_000_000), rng.choice(["inbound", "outbound"]), suspicious=y, typology="structuring" if y else "", variant="fast" if y else "", case=f"CASE-{rng.randrange(9)}" if y else ""))
        n = rng.choice([0, 0, 0, 1, 2]) if not y else rng.choice([0, 1, 2])
        score = rng.choice([0.0, 39.6, 39.7, 50.0, 67.9, 100.0, 29.9999999999, rng.uniform(0, 100)])
        flags = [n > 0, n > 1, False, False, False]
        extra.append((f"TXN-{k:05d}", *flags, n, " | ".join(f"reason {i}" for i in range(n)), rng.randrange(5), min(n / 2, 1.0), rng.random(), score))
    more = spark.createDataFrame(extra, "transaction_id string, " + ", ".join(f"{r} boolean" for r in RULES) + ", n_rules_fired int, reason_codes string, fold int, rule_component double, model_component double, risk_score double")
    df = frame(spark, rows).join(more, "transaction_id").cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([(f"ENT-{k:05d}", f"Ada {k} Lovelace King", "business" if k % 2 else "individual", "gig") for k in range(40)], "entity_id string, display_name string, entity_type string, segment string")


def counts(rows, t):
    tp = sum(s >= t and y for s, y in rows)
    return tp, sum(s >= t for s, _ in rows) - tp, sum(y for _, y in rows) - tp


def test_sweep_agrees_with_counting_and_is_monotone(scored):
    got = {round(r["threshold"], 1): r for r in evaluation.sweep(scored).collect()}
    rows = [(r["risk_score"], r["is_suspicious"], r["entity_id"]) for r in scored.collect()]
    ents = {}
    for s, y, e in rows:
        a = ents.get(e, (-1, 0))
        ents[e] = (max(a[0], s), max(a[1], y))
    assert len(got) == 1001
    for t in (0, 10, 29.9, 30.0, 39.6, 39.7, 50, 67.9, 90, 100):
        assert (got[t]["txn_true_positives"], got[t]["txn_false_positives"], got[t]["txn_false_negatives"]) == counts([(s, y) for s, y, _ in rows], t)
        assert (got[t]["entity_true_positives"], got[t]["entity_false_positives"], got[t]["entity_false_negatives"]) == counts(list(ents.values()), t)
    order = [got[k / 10] for k in range(1001)]
    assert all(a["txn_alerts"] >= b["txn_alerts"] and a["entity_recall"] >= b["entity_recall"] for a, b in zip(order, order[1:], strict=False))


def test_cheapest_prefers_the_higher_threshold(scored):
    swept = evaluation.sweep(scored)
    best = evaluation.cheapest(swept).first()
    rows = swept.collect()
    low = min(r["entity_expected_cost_cad"] for r in rows)
    assert best["threshold"] == max(r["threshold"] for r in rows if r["entity_expected_cost_cad"] == low)


def test_bucket_is_right_next_to_the_grid(spark):
    values = [k / 10.0 for k in range(1001)] + [k / 10.0 - 1e-14 for k in range(1, 1001)] + [-0.5, 100.0]
    got = spark.createDataFrame([(v,) for v in values], "s double").select("s", evaluation.bucket(F.col("s"), ScoreConfig()).alias("b")).collect()
    for r in got:
        want = max((i for i in range(1001) if i / 10.0 <= r["s"]), default=-1) if r["s"] < 0.2 or r["s"] > 99.8 else r["b"]
        assert r["b"] == want and (r["b"] < 0 or (r["b"] / 10.0 <= r["s"] and (r["b"] == 1000 or (r["b"] + 1) / 10.0 > r["s"])))


def test_costs_of_flags(spark):
    rows = [pay(k, f"E{k}", "", T0, 100, suspicious=int(k < 3)) for k in range(10)]
    df = frame(spark, rows).withColumn("f", F.col("entity_id").isin("E0", "E5", "E6", "E7", "E8"))
    cfg = ScoreConfig(investigation_cost=200.0, miss_cost=10_000.0)
    got = {r["level"]: r for r in evaluation.evaluate_flags(df, F.col("f"), cfg).collect()}
    assert got["entity"]["expected_cost_cad"] == 4 * 200 + 2 * 10_000 and got["entity"]["recall"] == pytest.approx(1 / 3)
    none = {r["level"]: r for r in evaluation.evaluate_flags(df, F.lit(False), cfg).collect()}
    assert none["transaction"]["precision"] == none["transaction"]["f1"] == 0.0


def test_ranking_metrics_by_hand(spark):
    df = frame(spark, [pay(k, "E", "", T0, 1, suspicious=y) for k, y in enumerate([1, 0, 1, 0, 0])]).withColumn("risk_score", F.element_at(F.array(*[F.lit(x) for x in (0.9, 0.8, 0.8, 0.3, 0.1)]), F.substring("transaction_id", 5, 5).cast("int") + 1))
    got = evaluation.ranking_metrics(df).first()
    assert got["pr_auc"] == pytest.approx(0.5 * 1 + 0.5 * (2 / 3)) and got["roc_auc"] == pytest.approx((3 + 2.5) / 6) and got["prevalence"] == 0.4


def test_percentile_against_other_folds(spark):
    rows = [(f"t{k}", "e", float(k), k % 5) for k in range(100)] + [("low", "e", -5.0, 0)]
    got = {r["transaction_id"]: r["model_component"] for r in evaluation.percentile_against_train(spark.createDataFrame(rows, "transaction_id string, entity_id string, v double, fold int"), "v").collect()}
    assert got["low"] == 0.0 and got["t99"] == 1.0 - 0 / 80 and got["t50"] == pytest.approx(sum(1 for k in range(51) if k % 5 != 0) / 80)


def test_folds_and_bootstrap(scored):
    f = evaluation.folds(scored).collect()
    assert len({r["entity_id"] for r in f}) == len(f) == 40 and {r["fold"] for r in f} <= set(range(5))
    assert sorted(map(tuple, f)) == sorted(map(tuple, evaluation.folds(scored).collect()))
    got = {r["metric"]: r for r in evaluation.bootstrap(scored, 50.0, draws=200).collect()}
    flags = {r["level"]: r for r in evaluation.evaluate_flags(scored, F.col("risk_score") >= 50.0).collect()}
    for metric, (level, name) in {"txn_precision": ("transaction", "precision"), "entity_recall": ("entity", "recall")}.items():
        assert got[metric]["low"] <= flags[level][name] <= got[metric]["high"] and got[metric]["draws"] == 200


def test_register_ignores_labels_and_gates_fail_closed(scored, entities):
    reg = cases.case_register(scored, entities, 39.6)
    flipped = scored.withColumn("is_suspicious", 1 - F.col("is_suspicious")).withColumn("typology", F.lit("x")).withColumn("case_id", F.lit("y"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(reg) == key(cases.case_register(flipped, entities, 39.6))
    assert cases.register_fingerprint(reg).first()[0] == cases.register_fingerprint(cases.case_register(flipped, entities, 39.6)).first()[0]
    graph = cases.entity_graph(scored, reg)
    gates = {r["gate_id"]: r["status"] for r in cases.release_gates(reg, graph, scored, 39.6).collect()}
    assert gates["QUEUE-01"] == gates["LABEL-01"] == gates["GRAPH-01"] == gates["SLA-01"] == "PASS"
    assert cases.release_decision(cases.release_gates(reg, graph, scored, 39.6)).first()["decision"] == "REVIEW REQUIRED"
    short = reg.where(F.col("entity_id") != reg.agg(F.min("entity_id")).first()[0])
    closed = {r["gate_id"]: r["status"] for r in cases.release_gates(short, graph, scored, 39.6).collect()}
    assert closed["QUEUE-01"] == closed["GRAPH-01"] == "BLOCK"
    leaky = {r["gate_id"]: r["status"] for r in cases.release_gates(reg.withColumn("typology", F.lit("x")), graph, scored, 39.6).collect()}
    assert leaky["LABEL-01"] == "BLOCK"
    order = [(r["priority"], -r["max_risk_score"], r["investigation_id"]) for r in cases.sorted_register(reg).collect()]
    assert order == sorted(order)
    assert {r["display_name"] for r in reg.collect()} <= {f"A. {str(k)[0]}. L." for k in range(40)}


def test_queue_and_filters(scored, entities):
    queue = cases.case_queue(scored, entities, 39.6)
    assert queue.count() == scored.where("risk_score >= 39.6").select("entity_id").distinct().count()
    assert cases.filter_queue(queue).count() == queue.count()
    some = cases.filter_queue(queue, ["business"], ["Layering"], 100.0).collect()
    assert some and all(r["entity_type"] == "business" and "Layering" in r["typology_guess"] and r["amount_involved_cad"] >= 100 for r in some)
    assert cases.case_queue(scored, entities, 101.0).count() == 0


def test_masking(spark):
    values = ["ENT-01344", "ENT-12", None, "", "12345678", "CPT-1234", "-123456"]
    df = spark.createDataFrame([(v, n) for v, n in zip(values, ["Ada Lovelace", " a  b c d ", None, "", "Plato", "x", "y"], strict=True)], "entity_id string, display_name string")
    got = [tuple(r) for r in text.mask_frame(df).collect()]
    assert [g[0] for g in got] == ["ENT-...1344", "ENT-12", "", "", "...5678", "CPT-1234", "...3456"]
    assert [g[1] for g in got] == ["A. L.", "A. B. C.", "", "", "P.", "X.", "Y."]
    assert {r[0] for r in text.unmasked_columns(df).collect()} == {"entity_id"}
    assert text.unmasked_columns(df.select(F.lit(1).alias("n"))).count() == 0
    assert text.unmasked_columns(text.mask_frame(df.where("entity_id = 'ENT-01344'"))).count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([("call 123-456-789",), ("4929348385146306",), ("4929348385146307 my passport",), (None,)], "t string")
    assert text.shape_scan(df, "t").first().asDict() == {"spaced_numbers": 1, "long_digit_runs": 2, "card_numbers": 1, "forbidden_terms": 1}


def test_validation(spark, scored, entities):
    bad = frame(spark, [pay(1, "ENT-00001", "CPT-1", T0, -5), pay(1, "ENT-X", "CPT-1", T0, 5, "sideways"), pay(2, "ENT-00001", "CPT-1", T0, 5, cash=1)])
    got = {r["check_name"]: r["violations"] for r in validation.violations(bad, entities).collect()}
    assert got == {"transaction_id_unique": 1, "entity_known": 1, "amount_positive": 1, "direction_known": 1, "is_cash_flag": 0, "label_flag": 0, "counterparty_not_null": 0, "cash_has_no_counterparty": 1}
    with pytest.raises(ValueError):
        validation.require_columns(bad, ["nothing"])
    with pytest.raises(ValueError):
        validation.require_same_rows(bad, bad, "transaction_id")
    validation.require_same_rows(scored, scored, "transaction_id")
    with pytest.raises(ValueError):
        validation.require_finite(spark.createDataFrame([(float("nan"),)], "x double"), ["x"])
    inv = spark.createDataFrame([("a", "public"), ("gone", "public"), ("b", None)], "column_name string, privacy_class string")
    assert {tuple(r) for r in validation.inventory_gaps(spark.createDataFrame([(1, 2)], "a int, b int"), inv).collect()} == {("b", "not classified"), ("gone", "no such column")}


def test_review_notes(spark):
    import json

    good = {"schema_version": 1, "investigation_id": "INV-1", "observed_facts": [{"observation": "x", "source_ref": "counterparty:C1"}], "alternative_explanation": "a", "discriminator": "b", "analysis": "c", "recommended_next_step": "d", "missing_evidence": ["y"], "recommendation": "escalate_for_review", "human_approved": False, "filing_status": "NOT FILED"}
    fact = lambda **x: good | {"observed_facts": [x]}
    deep = json.dumps(good | {"deep": [1, {"er": [["x", {"typology": 1}]]}]})
    expected = [
        (json.dumps(good), ""), (json.dumps(good | {"deep": ['{"typology": 1}', {"typology,": 1, ',"typology': ",", "x": "typology"}]}), ""), (json.dumps(fact(observation="x", source_ref="register:INV-1")), ""),
        (deep, "holds a label key"), (deep.replace("typology", "typolog\\u0079"), "holds a label key"), (json.dumps(good | {"ground_truth": None}), "holds a label key"),
        (json.dumps(good | {"recommendation": notes.CLOSURE}), "closes while evidence is missing"), (json.dumps(good | {"recommendation": notes.CLOSURE, "missing_evidence": []}), ""), (json.dumps(good | {"recommendation": "file"}), "unknown recommendation"),
        (json.dumps(fact(observation="x", source_ref="counterparty:C2")), "unknown references"), (json.dumps(fact(observation="x")), "unknown references"), (json.dumps(fact(observation="\t ", source_ref="register:INV-1")), "a fact without an observation"),
        (json.dumps(good | {"observed_facts": []}), "no facts"), (json.dumps(good | {"observed_facts": "x"}), "no facts"), (json.dumps(good | {"investigation_id": "INV-9"}), "unknown investigation; unknown references"),
        (json.dumps(good | {"analysis": " "}), "a text field is empty"), (json.dumps(good | {"discriminator": 5}), "a text field is empty"), (json.dumps(good | {"schema_version": "1"}), "not a version 1 note"),
        (json.dumps(good | {"missing_evidence": ["y", 1]}), "missing evidence is not a list of texts"), (json.dumps(good | {"missing_evidence": None}), "missing evidence is not a list of texts"),
        (json.dumps(good | {"human_approved": "false"}), "claims approval or a filing"), (json.dumps(good | {"filing_status": "FILED"}), "claims approval or a filing"),
    ]
    broken = ["not json", None, "", "[1]", "null", '{"schema_version": 1, "schema_version": 1}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate([t for t, _ in expected] + [expected[0][0]] + broken + [None])], "n int, note string")
    register = spark.createDataFrame([("INV-1", "E1"), ("INV-2", "E2")], "investigation_id string, entity_id string")
    refs = notes.case_references(register, spark.createDataFrame([("E1", "C1"), ("E2", "C2"), ("E9", "C9")], "entity_id string, counterparty_id string"))
    got = {r["n"]: r for r in notes.assess(df, register, refs).collect()}
    assert len(got) == df.count()
    for k, (text_, problems) in enumerate([*expected, expected[0]]):
        assert ("; ".join(got[k]["problems"]), got[k]["status"]) == (problems, "BLOCKED" if problems else "READY FOR REVIEW"), text_
    assert all(got[k]["status"] == "BLOCKED" and got[k]["investigation_id"] is None for k in range(len(expected) + 1, len(got)))
    assert notes.assess(df.where("false"), register, refs).count() == 0
    with pytest.raises(ValueError):
        notes.assess(df.withColumn("status", F.lit(1)), register, refs)


def test_files(spark, tmp_path, scored):
    df = scored.select("transaction_id", "counterparty_id", "amount_cents").orderBy("transaction_id")
    files.write_csv(df, str(tmp_path / "c"), ["transaction_id"])
    back = files.read_csv(spark, str(tmp_path / "c"), "transaction_id string, counterparty_id string, amount_cents long")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert files.read_csv(spark, str(tmp_path / "c"), columns=["counterparty_id"]).where("counterparty_id IS NULL").count() == 0
    (tmp_path / "p.json").write_text('{"schema_version": 1,\r\n "priority_bands": [], "typologies": [{"typology_id": "T1", "minimum_evidence": ["a", "b"]}]}')
    (tmp_path / "q.json").write_text('{"schema_version": 2}')
    policy = files.read_policy(spark, str(tmp_path / "p.json"))
    assert files.catalogue(spark, policy).first()["minimum_evidence"] == "a; b"
    with pytest.raises(ValueError):
        files.read_policy(spark, str(tmp_path / "q.json"))
    (tmp_path / "r.json").write_text((tmp_path / "p.json").read_text().replace("\r\n", "\n"))
    assert len(files.canonical_digest(spark, str(tmp_path / "p.json"))) == 64
    assert '"n": 400' in files.metrics_document({"x": scored.agg(F.count(F.lit(1)).alias("n"))})
    assert files.markdown_table(spark.createDataFrame([("$5|", None)], "a string, b string")).endswith("| \\$5\\| |  |")


def test_running_sums_over_ranges_match_plain_sums(spark):
    rng = random.Random(5)
    rows = [(g, round(v, 3), rng.randint(0, 9), 1) for g in ("a", "b") for v in {rng.random() ** 3 for _ in range(700)}]
    df = spark.createDataFrame(rows, "g string, v double, x long, n long")
    for by, down in (((), False), (("g",), True)):
        base = df.groupBy(*by, "v").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        got = with_ranked(base, "v", ["x", "n"], by, down=down, ranges=16).collect()
        plain = [r.asDict() for r in base.collect()]
        assert len(got) == len(plain)
        for r in got[::17]:
            own = [p for p in plain if not by or p["g"] == r["g"]]
            upto = [p for p in own if (p["v"] >= r["v"] if down else p["v"] <= r["v"])]
            assert (r["upto_x"], r["upto_n"], r["all_x"]) == (sum(p["x"] for p in upto), sum(p["n"] for p in upto), sum(p["x"] for p in own))
    assert with_ranked(df.where("false").select("v", "x"), "v", ["x"]).count() == 0
