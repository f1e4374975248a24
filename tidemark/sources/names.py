"""Listed parties and customers' names as functions of keys, for screening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

GIVEN = ("Aleksandr", "Yevgeniya", "Mariam", "Ibrahim", "Olga", "Khaled", "Svetlana", "Tomasz", "Li", "Nadezhda", "Jorge", "Ekaterina")
FAMILY = ("Khodorov", "Petrosyan", "Al-Rashid", "Lukashevich", "Zhukova", "Marquez", "Schneider", "Wojcik", "Na", "Tchaikov", "Oyelaran", "Brightwater", "Quintana", "Yakovenko", "Fitzgerald-Moss")


def pick(names: tuple[str, ...], k):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))


def customer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("query_id"), F.concat_ws(" ", pick(GIVEN, k * 7), pick(FAMILY, k * 11 + F.floor(k / 13))).alias("name"))


def listed_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    given, family = pick(GIVEN, k * 5 + F.floor(k / 12)), pick(FAMILY, k * 2 + F.floor(k / 15))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S|"), k.cast("string"), F.lit("|X")).alias("party"), F.lit("individual").alias("kind"), F.array(F.concat_ws(" ", given, family), F.concat_ws(" ", given, F.concat(F.left(family, F.lit(1)), F.lit(".")), family)).alias("names"),
        (1950 + k % 50).cast("int").alias("birth_year"), F.lit("X").alias("country"), F.lit("2020-01-01").alias("listed_on"),
    )


CUSTOMER_NAMES_SQL = f"""
cnames AS (
  SELECT c_custkey AS query_id, list_extract([{', '.join(f"'{n}'" for n in GIVEN)}], CAST((c_custkey * 7) % {len(GIVEN)} + 1 AS INTEGER)) || ' ' || list_extract([{', '.join(f"'{n}'" for n in FAMILY)}], CAST((c_custkey * 11 + c_custkey // 13) % {len(FAMILY)} + 1 AS INTEGER)) AS name FROM customer
)"""


#: Words of many scripts and spellings, of which names are made by key.
VARIED_GIVEN = ("Александр", "José", "Ekaterina", "Юлия", "Zoë", "Jo", "Ибрагим", "X", "Seán", "Ｌｉ", "Aleksandr", "محمد", "Władysław", "Iosif", "Cecilia", "Щукина", "Đorđe")
VARIED_FAMILY = ("Müller", "Щербаков", "O'Brien", "Al-Rashid", "Khodorkovskiy", "Ходорковский", "Groupe & Fils SA", "ﬁsher", "Νίκος", "Yevtushenko LLC", "Łuczak", "Škvorecký", "Zzyzx")


def varied_name(k):
    return F.concat_ws(" ", pick(VARIED_GIVEN, k * 7 + F.floor(k / 17)), pick(VARIED_FAMILY, k * 5 + F.floor(k / 13)))


def varied_names(spark: SparkSession, sf_dir: str, table_name: str = "customer", key: str = "c_custkey") -> DataFrame:
    """query_id, name: of customers or suppliers, in several scripts."""
    return table(spark, sf_dir, table_name).select(F.col(key).alias("query_id"), varied_name(F.col(key)).alias("name"))


def list_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as an XML list has them, one a supplier: people, ships and companies with aliases in several layouts."""
    k = F.col("s_suppkey")
    person = k % 3 == 0
    between = F.element_at(F.array(*[F.lit(x) for x in ("; ", "\n", " / ", " aka ", " a.k.a. ", ", ")]), (k % 6 + 1).cast("int"))
    aliases = F.when(k % 7 == 0, F.lit(None)).otherwise(F.concat(varied_name(k + 1), between, varied_name(k + 2), F.lit(" ,. "), between, varied_name(k + 1)))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Country "), (F.col("s_nationkey") % 5).cast("string")).alias("Country"), F.when(person, pick(VARIED_FAMILY, k)).alias("LastName"), F.when(person & (k % 2 == 0), pick(VARIED_GIVEN, k)).alias("GivenName"), aliases.alias("Aliases"),
        F.concat(F.lit("about "), (F.lit(1890) + k % 150).cast("string"), F.lit(" or later")).alias("DateOfBirthOrShipBuildDate"), F.lit("1").alias("Schedule"), k.cast("string").alias("Item"), F.lit("2020-01-01").alias("DateOfListing"),
        F.when(~person & (k % 11 != 1), varied_name(k)).alias("EntityOrShip"), F.when(k % 5 == 1, F.lit("9074729")).alias("ShipIMONumber"),
    )


def _picked(names: tuple[str, ...], k: str) -> str:
    quoted = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"list_extract([{quoted}], CAST(({k}) % {len(names)} + 1 AS INTEGER))"


def _varied(k: str) -> str:
    return f"({_picked(VARIED_GIVEN, f'({k}) * 7 + ({k}) // 17')} || ' ' || {_picked(VARIED_FAMILY, f'({k}) * 5 + ({k}) // 13')})"


VARIED_SQL = f"vnames AS (SELECT c_custkey AS query_id, {_varied('c_custkey')} AS name FROM customer), vlisted AS (SELECT s_suppkey AS query_id, {_varied('s_suppkey')} AS name FROM supplier)"
_BETWEEN = "list_extract(['; ', chr(10), ' / ', ' aka ', ' a.k.a. ', ', '], CAST(s_suppkey % 6 + 1 AS INTEGER))"
RECORDS_SQL = f"""records AS (
  SELECT 'Country ' || CAST(s_nationkey % 5 AS VARCHAR) AS country, CASE WHEN s_suppkey % 3 = 0 THEN {_picked(VARIED_FAMILY, "s_suppkey")} END AS last, CASE WHEN s_suppkey % 6 = 0 THEN {_picked(VARIED_GIVEN, "s_suppkey")} END AS given,
    CASE WHEN s_suppkey % 7 <> 0 THEN {_varied("s_suppkey + 1")} || {_BETWEEN} || {_varied("s_suppkey + 2")} || ' ,. ' || {_BETWEEN} || {_varied("s_suppkey + 1")} END AS aliases,
    'about ' || CAST(1890 + s_suppkey % 150 AS VARCHAR) || ' or later' AS born, CAST(s_suppkey AS VARCHAR) AS item,
    CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 11 <> 1 THEN {_varied("s_suppkey")} END AS body, CASE WHEN s_suppkey % 5 = 1 THEN '9074729' END AS imo FROM supplier)"""
