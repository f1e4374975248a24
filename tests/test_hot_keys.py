import pytest

from helpers import frame
from test_features_rules import check_features, check_rules, random_rows
from tidemark.operators import running
from tidemark.operators.features import features
from tidemark.operators.rules import layering


@pytest.mark.parametrize("long,wide", [(25, 40), (1, 1)])
def test_keys_dealt_by_spans_and_whole_keys_agree(spark, monkeypatch, long, wide):
    """A hot entity and hot counterparties among others, and all of them hot."""
    monkeypatch.setattr(running, "LONG", long)
    monkeypatch.setattr(running, "WIDE", wide)
    check_features(spark, random_rows(21))
    check_rules(spark, random_rows(22, n=160))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_of_ordinary_keys_are_dealt_once(spark):
    """Payments by counterparty and by entity, and no table of totals as large as they are."""
    df = frame(spark, random_rows(23))
    assert exchanges(features(df)) <= 3
    assert exchanges(layering(df)) <= 6
