import random
from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import DAY, HOUR, T0, frame, pay, plain_features, plain_large_cash, plain_layering, plain_smurfing, plain_structuring
from tidemark.config import FeatureConfig, RuleConfig
from tidemark.operators import rules
from tidemark.operators.features import features, two_pass_zscore

LOOSE = replace(RuleConfig(), r3_senders=3)


def random_rows(seed, n=120, entities=4, hot=0.4):
    """Payments with ties, gaps, a hot entity, shared counterparties and amounts around every threshold."""
    rng = random.Random(seed)
    rows, t = [], T0
    for k in range(n):
        t += rng.choice([0, 0, 60, HOUR, 12 * HOUR, DAY, 2 * DAY, 7 * DAY])
        cash = rng.random() < 0.3
        cents = rng.choice([100, 100_000, 500_000, 749_999, 750_000, 999_999, 1_000_000, 1_500_000, 3_000_000, rng.randint(1, 2_000_000)])
        rows.append(pay(k, "ENT-0" if rng.random() < hot else f"ENT-{rng.randrange(1, entities)}", "" if cash else f"CPT-{rng.randrange(6)}", t - rng.choice([0, 0, HOUR]), cents, rng.choice(["inbound", "inbound", "outbound"]) if not cash else "inbound", int(cash)))
    rng.shuffle(rows)
    return rows


def check_features(spark, rows, cfg=None):
    want = plain_features(rows)
    got = {r["transaction_id"]: r for r in features(frame(spark, rows), cfg).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == pytest.approx(v, abs=1e-6), (k, c)
    return got


def check_rules(spark, rows):
    df = frame(spark, rows)
    assert {r["transaction_id"]: (r["deposits"], r["total_cents"]) for r in rules.structuring(df).collect()} == plain_structuring(rows)
    assert {r["transaction_id"]: (r["anchor_id"], r["legs"], r["counterparties"]) for r in rules.layering(df).collect()} == plain_layering(rows)
    assert {r["transaction_id"]: (r["anchor_id"], r["senders"], r["payments"]) for r in rules.smurfing(df, LOOSE).collect()} == plain_smurfing(rows, senders=3)
    assert {r["transaction_id"] for r in rules.large_cash(df).collect()} == plain_large_cash(rows)


@pytest.mark.parametrize("seed", range(3))
def test_features_match_definitions(spark, seed):
    rows = random_rows(seed)
    check_features(spark, rows)


def test_results_do_not_depend_on_the_span(spark):
    rows = random_rows(9)
    for chunk in (HOUR, 400 * DAY):
        check_features(spark, rows, FeatureConfig(chunk=chunk))


def test_two_pass_control_agrees(spark):
    df = frame(spark, random_rows(4))
    joined = features(df).join(two_pass_zscore(df), "transaction_id").collect()
    assert all(abs(r["zscore"] - r["amount_zscore_entity"]) < 1e-6 for r in joined)


def test_constant_history_null_counterparty_and_calendar(spark):
    rows = [pay(k, "ENT-1", None if k % 2 else "CPT-1", T0 + k * DAY + 5 * HOUR, 5_000) for k in range(9)]
    got = {r["transaction_id"]: r for r in features(frame(spark, rows)).collect()}
    assert all(r["amount_zscore_entity"] == 0.0 for r in got.values())
    assert [got[f"TXN-{k:05d}"]["counterparty_id"] for k in range(2)] == ["CPT-1", ""]
    assert [got[f"TXN-{k:05d}"]["is_weekend"] for k in range(9)] == [0, 0, 0, 0, 0, 1, 1, 0, 0]
    assert {r["hour_of_day"] for r in got.values()} == {5}
    assert features(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(10, 14))
def test_rules_match_definitions(spark, seed):
    check_rules(spark, random_rows(seed, n=160))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from([0, 1, HOUR, DAY, 2 * DAY, 3 * DAY, 7 * DAY]), st.sampled_from([400_000, 450_000, 800_000, 999_999, 1_600_000]), st.booleans(), st.booleans()), min_size=1, max_size=60))
def test_rules_on_any_sequence(spark, steps):
    rows, t = [], T0
    for k, (e, cp, gap, cents, out, cash) in enumerate(steps):
        t += gap
        rows.append(pay(k, f"ENT-{e}", "" if cash else f"CPT-{cp}", t, cents, "inbound" if cash or not out else "outbound", int(cash)))
    check_rules(spark, rows)


def fires(spark, rows, code, cfg=None):
    df = frame(spark, rows)
    out = rules.apply_rules(df, features(df), cfg).collect()
    assert all((r["n_rules_fired"] == 0) == (r["reason_codes"] == "") for r in out)
    assert all(r["n_rules_fired"] == sum(r[c] for c in rules.RULES) for r in out)
    return sum(r[code] for r in out), " ".join(r["reason_codes"] for r in out if r[code])


def deposits(days, cents=900_000, cash=1):
    return [pay(k, "ENT-1", "" if cash else "CPT-1", T0 + int(d * DAY), cents, cash=cash) for k, d in enumerate(days)]


def test_structuring_edges(spark):
    assert fires(spark, deposits([0, 2, 7]), "R1_STRUCTURING") == (3, " ".join(["R1_STRUCTURING: 3 cash deposits totalling $27,000.00 in 7.0 days, each between $7,500 and $10,000"] * 3))
    late = [*deposits([0, 2])[:2], pay(2, "ENT-1", "", T0 + 7 * DAY + 1, 900_000, cash=1)]
    for quiet in (late, deposits([0, 2]), deposits([0, 1, 2], cash=0), deposits([0, 1, 2], 1_000_000), deposits([0, 12, 24])):
        assert fires(spark, quiet, "R1_STRUCTURING")[0] == 0


def layers(out=(2_000_000, 2_000_000, 1_600_000), cps=("A", "B", "C"), hours=(1, 10, 48), credit=8_000_000):
    return [pay(0, "ENT-1", "CPT-X", T0, credit), *[pay(k + 1, "ENT-1", f"CPT-{c}", T0 + h * HOUR, x, "outbound") for k, (x, c, h) in enumerate(zip(out, cps, hours, strict=True))]]


def test_layering_edges(spark):
    n, reason = fires(spark, layers(), "R2_LAYERING")  # exactly 70 % and exactly 48 hours
    assert n == 4 and "R2_LAYERING: $80,000.00 inbound dispersed to 3 counterparties in 3 transfers within 48h, 70% passed through" in reason
    for quiet in (layers(out=(2_000_000, 2_000_000, 1_599_999)), layers(cps=("A", "A", "B")), layers(hours=(1, 10, 49)), layers(credit=1_499_999, out=(500_000,) * 3)):
        assert fires(spark, quiet, "R2_LAYERING")[0] == 0


def test_smurfing_edges(spark):
    many = [pay(k, "ENT-1", f"CPT-{k}", T0 + k * 6 * HOUR, 150_000 + 1_000 * k) for k in range(12)]
    n, reason = fires(spark, many, "R3_SMURFING")
    assert n == 12 and "12 distinct senders" in reason
    for quiet in (many[:3], [pay(k, "ENT-1", f"CPT-{k}", T0 + k * HOUR, 10_000 if k % 2 else 900_000) for k in range(12)], [pay(k, "ENT-1", f"CPT-{k}", T0 + k * 2 * DAY, 150_000) for k in range(12)]):
        assert fires(spark, quiet, "R3_SMURFING")[0] == 0


def test_round_and_dormant_edges(spark):
    history = [pay(k, "ENT-1", "CPT-1", T0 + k * DAY, 1_500 + 100 * (k % 3)) for k in range(12)]
    assert fires(spark, [*history, pay(50, "ENT-1", "CPT-1", T0 + 13 * DAY, 500_000)], "R4_ROUND_DOLLAR")[0] == 1
    assert fires(spark, [*history, pay(50, "ENT-1", "CPT-1", T0 + 13 * DAY, 500_001)], "R4_ROUND_DOLLAR")[0] == 0
    assert fires(spark, [*history[:4], pay(50, "ENT-1", "CPT-1", T0 + 13 * DAY, 500_000)], "R4_ROUND_DOLLAR")[0] == 0
    assert fires(spark, [*history, pay(50, "ENT-1", "CPT-1", T0 + 101 * DAY, 50_000)], "R5_DORMANT")[0] == 1
    assert fires(spark, [*history, pay(50, "ENT-1", "CPT-1", T0 + 100 * DAY, 50_000)], "R5_DORMANT")[0] == 0
    assert fires(spark, [*history, pay(50, "ENT-1", "CPT-1", T0 + 101 * DAY, 6_000)], "R5_DORMANT")[0] == 0


def test_quiet_account(spark):
    rows = [pay(k, "ENT-1", "CPT-1", T0 + k * DAY, 2_000 + k, "outbound" if k % 2 else "inbound") for k in range(30)]
    df = frame(spark, rows)
    assert rules.rule_hits(df, features(df)).count() == 0


def dense(n, seconds):
    """One entity's day: credits and debits of many counterparties in turn."""
    return [pay(k, "ENT-1", f"CPT-{k % 50}", T0 + k * seconds // n, 1_600_000 if k % 3 == 0 else 400_000 + k % 7, "inbound" if k % 3 != 1 else "outbound") for k in range(n)]


def test_windows_that_hold_every_payment(spark):
    check_rules(spark, dense(400, DAY))


def test_dense_windows_cost_no_more_a_row(spark):
    """A hundred thousand payments of one entity in a day: five thousand million pairs, which no plan lists."""
    rows = frame(spark, dense(100_000, DAY)).cache()
    legs = rules.layering(rows)
    got = legs.agg(F.count(F.lit(1)).alias("n"), F.max("legs").alias("most")).first()
    assert got.n > 0 and got.most > 2
    few = rules.smurfing(rows, replace(RuleConfig(), r3_mean=10**9, r3_cv=10.0)).agg(F.count(F.lit(1)).alias("n"), F.max("payments").alias("most")).first()
    assert few.n == few.most == sum(k % 3 != 1 for k in range(100_000))
