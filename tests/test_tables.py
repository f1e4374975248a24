import pytest
from pyspark.sql import functions as F

from tidemark.plans import tables as plans
from tidemark.sources import tables

ROWS = "entity_id string, week long, `odd``name` string, tags array<struct<a:int>>, amount_cents long"


def rows(spark, *pairs):
    return spark.createDataFrame([(e, w, None, [(1,)], c) for e, w, c in pairs], ROWS)


@pytest.fixture
def name(spark, tmp_path):
    yield f"t_{tmp_path.name}".replace("-", "_").lower()
    spark.sql(f"DROP TABLE IF EXISTS t_{tmp_path.name}".replace("-", "_").lower())


def test_a_batch_replaces_itself_and_survives_the_session(spark, tmp_path, name):
    first = rows(spark, ("a", 1, 5), ("a", 1, 5), ("b", None, 7))
    path = str(tmp_path / "it's")
    assert tables.open_table(spark, name, path, first.schema, plans.BY, 4).count() == 0
    held = lambda: sorted((r["batch"], r["entity_id"], r["amount_cents"]) for r in spark.table(name).collect())
    tables.load(first, name, 1)
    tables.load(rows(spark, ("c", 2, 1)).selectExpr("'x' AS more", "*"), name, 2)
    tables.load(first, name, 1)
    whole = [(1, "a", 5), (1, "a", 5), (1, "b", 7), (2, "c", 1)]
    assert held() == whole
    # Another session knows the folder only.
    spark.sql(f"DROP TABLE {name}")
    assert tables.open_table(spark, name, path, first.schema, plans.BY, 4).count() == 4 and held() == whole
    tables.load(first.where("false"), name, 1)
    assert held() == whole[3:]


def test_other_definitions_are_refused(spark, tmp_path, name):
    schema = rows(spark).schema
    tables.open_table(spark, name, str(tmp_path / "x"), schema, plans.BY, 4)
    tables.open_table(spark, name, str(tmp_path / "x"), schema, plans.BY, 4)
    for other in ((str(tmp_path / "x"), schema, plans.BY, 8), (str(tmp_path / "y"), schema, plans.BY, 4), (str(tmp_path / "x"), schema, ["week"], 4), (str(tmp_path / "x"), rows(spark).withColumn("z", F.lit(1)).schema, plans.BY, 4)):
        with pytest.raises(ValueError):
            tables.open_table(spark, name, *other)
    with pytest.raises(ValueError):
        tables.open_table(spark, name, str(tmp_path / "z"), rows(spark).withColumnRenamed("week", "Batch").schema, ["entity_id"], 4)


def test_groups_and_joins_by_bucket_need_no_exchange(spark, tmp_path, name):
    df = rows(spark, *[(f"e{k % 7}", k % 3, k) for k in range(400)])
    tables.open_table(spark, name, str(tmp_path / "x"), df.schema, plans.BY, 4)
    for batch in range(2):
        tables.load(df.where(f"amount_cents % 2 = {batch}"), name, batch)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (plans.weeks(spark.table(name)), plans.shares(spark.table(name).withColumn("transaction_id", F.col("week")))):
            assert "Exchange" not in query._jdf.queryExecution().executedPlan().toString()
        got = {(r["entity_id"], r["week"]): (r["payments"], r["week_cents"], r["largest_cents"]) for r in plans.weeks(spark.table(name)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = {}
    for k in range(400):
        plain.setdefault((f"e{k % 7}", k % 3), []).append(k)
    assert got == {k: (len(v), sum(v), max(v)) for k, v in plain.items()}
