"""What keeps large inputs in time: work done once, and by many tasks."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import T0, frame, pay
from tidemark.operators import evaluation, packets, running
from tidemark.operators.features import features
from tidemark.operators.models import IsolationForest
from tidemark.plans import models as plans
from tidemark.plans import queries, streams


def jobs_rows(spark, run):
    """What an accumulator counted while run(count) was at work: rows that passed a function in tasks."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    run(count)
    return seen.value


def test_packets_read_the_graph_once(spark):
    register = spark.createDataFrame([("INV-1", "E1", "P1", 24, "S", "T", "R", 3, 1.5, "e", "d")], "investigation_id string, entity_id string, priority string, due_hours int, case_state string, typology_hypothesis string, rules_fired string, flagged_transactions long, amount_involved_cad double, evidence_references string, decision_status string")
    edges = spark.range(30).selectExpr("'E1' AS entity_id", "concat('C', id) AS counterparty_id", "1L AS transactions", "1D AS amount_cad", "'inbound' AS directions")
    rows = jobs_rows(spark, lambda f: packets.case_packets(register, edges.mapInArrow(f, edges.schema)).collect())
    assert rows == 30


def test_draws_are_dealt_to_tasks(spark):
    rows = [(f"E{k}", int(k % 9 == 0), float(k % 100)) for k in range(300)]
    df = spark.createDataFrame(rows, "entity_id string, is_suspicious int, risk_score double")
    plan = evaluation.bootstrap(df, 50.0, draws=40)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_counts_are_made_once_for_ranks(spark):
    df = spark.range(500).selectExpr("CAST(id % 50 AS DOUBLE) AS v", "1L AS n")
    rows = jobs_rows(spark, lambda f: running.with_ranked(df.mapInArrow(f, df.schema).groupBy("v").agg(F.sum("n").alias("n")), "v", ["n"]).collect())
    assert rows == 500


def test_forest_scores_are_made_once(spark, monkeypatch, tmp_path):
    """Of rows that percentiles, sweeps and rankings read again, each is put through the forest once; nothing when held."""
    df = spark.range(200).selectExpr("concat('T', id) AS transaction_id", "CAST(id % 5 AS INT) AS fold", "CAST(id % 7 AS DOUBLE) AS score")
    hits = df.select("transaction_id", F.lit(1).alias("n_rules_fired"))

    def run(f):
        monkeypatch.setattr(plans, "inputs", lambda s, d: None)
        monkeypatch.setattr(plans.m, "cross_validated", lambda rows, model: df.mapInArrow(f, df.schema))
        monkeypatch.setattr(plans, "hits1", lambda s, d: hits)
        monkeypatch.setattr(plans, "p1", lambda s, d: df.select("transaction_id"))
        for _ in range(2):
            assert plans.model_scored(spark, str(tmp_path)).count() == 200

    assert jobs_rows(spark, run) == 200


def test_steps_through_trees_are_the_plain_walk():
    """Leaves at many depths, and values that are missing or infinite."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((300, 4)), np.zeros((40, 4)), rng.standard_normal((5, 4)) * 50])
    forest = IsolationForest(x, trees=12, size=128)
    asked = np.concatenate([x, [[np.nan, 0, 1, np.inf], [-np.inf, np.inf, 0, 0]]])
    want = []
    for row in asked:
        total = 0.0
        for column, cut, child, extra in forest.trees:
            node = 0
            total += extra[0]
            while column[node] >= 0:
                node = child[node] + int(row[column[node]] >= cut[node])
                total += extra[node]
        want.append(2.0 ** (-total / 12 / forest.norm))
    assert forest.score(asked) == pytest.approx(want, rel=1e-12)


def test_the_streams_files_are_written_by_tasks(spark, monkeypatch, tmp_path):
    rows = [pay(k, f"E{k % 4}", "", T0 + k * 3600, 800_000 + k, cash=1) for k in range(240)]
    df = frame(spark, rows).repartition(3)
    monkeypatch.setattr(streams, "p1", lambda s, d: df)
    monkeypatch.setattr(streams, "scratch", lambda s: str(tmp_path))
    found = streams.cw.flagged_members(streams.streamed(spark, "any"))
    assert streams.cw.difference(found, streams.batch_members(spark, "any")).count() == 0 and found.count() > 0
    assert len(list(tmp_path.glob("stream-*/in/part-*"))) == 3 * streams.BATCHES


def test_rows_are_never_broadcast_to_their_values(spark, monkeypatch):
    """Rows that look small as a file stay where they are beside few values, and are dealt beside many."""
    rows = spark.range(400).selectExpr("concat('T', id) AS transaction_id", "CAST(id % 5 AS INT) AS fold", "CAST(id % 7 AS DOUBLE) AS score")
    found = []
    for few in (evaluation.FEW, 3):
        monkeypatch.setattr(evaluation, "FEW", few)
        out = evaluation.percentile_against_train(rows, "score")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and bool(re.search(r"SortMergeJoin \[[^]]*score", plan)) == (few == 3)
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] and len(found[0]) == 400
    hits = rows.selectExpr("transaction_id", "1 AS n_rules_fired")
    model = out.select("transaction_id", "model_component")
    assert "SortMergeJoin [transaction_id" in evaluation.risk_scores(hits, model)._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    """Features are made by so many tasks as rows need, whatever number of partitions the session has."""
    monkeypatch.setattr(running, "ROWS", 10)
    df = frame(spark, [pay(k, f"E{k % 40}", f"C{k % 30}", T0 + k * 3600, 1000 + k) for k in range(200)])
    plan = features(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id" in plan and plan.count(", 20), REPARTITION_BY_NUM") == 2
    assert features(df).count() == 200 and features(df.where("false")).count() == 0


def test_labels_and_folds_need_no_shuffle_of_features(spark, monkeypatch, tmp_path):
    """Rows are dealt by counterparty and by entity for the features, and not again for labels, folds or what a ranking reads."""
    rows = [pay(k, f"E{k % 40}", f"C{k % 30}", T0 + k * 3600, 1000 + k, suspicious=int(k % 9 == 0)) for k in range(200)]
    rows += [(*pay(200, "", "C1", T0, 7)[:1], None, *pay(200, "", "C1", T0, 7)[2:])]
    made = []
    monkeypatch.setattr(queries, "p1", lambda s, d: frame(spark, rows))
    monkeypatch.setattr(queries, "held", lambda s, d, name, make: made.append(make()) or made[-1])
    got = {r["transaction_id"]: (r["is_suspicious"], r["fold"]) for r in plans.inputs(spark, str(tmp_path)).collect()}
    folds = {r["entity_id"]: r["fold"] for r in evaluation.folds(frame(spark, rows)).collect()}
    assert got == {r[0]: (r[10], folds[r[1]]) for r in rows[:-1]}
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\([^\n]*REPARTITION_BY_NUM", plan)) == 2
    assert not re.search(r"Exchange hashpartitioning\(transaction_id", plan)
    assert queries.f1(spark, str(tmp_path)).count() == 201 and queries.f1(spark, str(tmp_path)).columns == features(frame(spark, rows)).columns
    plan = plans.ranking("gbt")(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "transaction_id" not in "".join(re.findall(r"SortMergeJoin[^\n]*", plan))
