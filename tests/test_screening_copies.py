from pyspark.sql import functions as F

from tidemark.operators.screening import matches, screen


def test_many_parties_and_queries_of_one_name(spark):
    """Only the first parties of a name can be among the best; with birth years, of a name and year."""
    party = F.concat(F.lit("P"), F.lpad(F.col("id").cast("string"), 4, "0"))
    listed = spark.range(600).select(party.alias("party"), F.lit("individual").alias("kind"), F.array(F.lit("Olga Zhukova"), F.lit("Zhukova Olga")).alias("names"), (1950 + F.col("id") % 3).cast("int").alias("birth_year"))
    asked = spark.range(50).select(F.col("id").alias("query_id"), F.lit("Olga Zhukova").alias("name"), F.lit(1952).alias("born"))
    got = screen(asked, listed, top=3).collect()
    assert len(got) == 150 and {(r["rank"], r["party"], r["matched_name"]) for r in got} == {(k + 1, f"P{k:04d}", "Olga Zhukova") for k in range(3)}
    near = screen(asked, listed, year_col="born", top=3).collect()
    assert {(r["rank"], r["party"]) for r in near} == {(1, "P0001"), (2, "P0002"), (3, "P0004")}
    none = matches(asked.select("query_id", F.lit("Qxyq").alias("name")), listed).collect()
    assert len(none) == 50 and all(r["hits"] is None for r in none)
