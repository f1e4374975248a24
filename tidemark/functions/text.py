"""Column functions: masking, identifier and shape detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTIFIERS, NAMES = ("entity_id", "counterparty_id"), ("display_name", "entity_name", "counterparty_name")


def mask_identifier(value: Column, visible: int = 4) -> Column:
    """What stands before the first '-', and the last characters of the rest behind '...'; short rests stay. Null: ''."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    at = F.instr(text, "-")
    prefix, tail = F.when(at > 0, F.substring_index(text, "-", 1)).otherwise(""), F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise(text)
    shown = F.when(F.length(tail) <= visible, tail).otherwise(F.concat(F.lit("..."), F.right(tail, F.lit(visible))))
    return F.when(prefix != "", F.concat(prefix, F.lit("-"), shown)).otherwise(shown)


def mask_name(value: Column, parts: int = 3) -> Column:
    """Initials of the first parts, each with a point. Null or blank: ''."""
    words = F.filter(F.split(F.trim(F.coalesce(value.cast("string"), F.lit(""))), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(F.slice(words, 1, parts), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit("."))), " ")


def mask_frame(df: DataFrame) -> DataFrame:
    """df with its identifier and name columns masked."""
    return df.withColumns({c: mask_identifier(F.col(c)) for c in IDENTIFIERS if c in df.columns} | {c: mask_name(F.col(c)) for c in NAMES if c in df.columns})


def unmasked_columns(df: DataFrame) -> DataFrame:
    """(column_name) of the text columns with a whole party identifier in any row, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string")
    found = df.agg(*[F.coalesce(F.bool_or(F.col(c).rlike(r"^(ENT|CPT)-\d+$")), F.lit(False)).alias(c) for c in names])
    return found.select(F.explode(F.array(*[F.when(F.col(c), F.lit(c)) for c in names])).alias("column_name")).where("column_name IS NOT NULL")


#: Words that must not occur in published data.
FORBIDDEN = ("passport", "social insurance", "date of birth")


def shape_scan(df: DataFrame, text: str) -> DataFrame:
    """One row of counts: values with a spaced 3-3-3 number, with a run of at least 9 digits, with a card number that
    passes the Luhn check, with a forbidden term."""
    c = F.coalesce(F.col(text), F.lit(""))
    cards = F.filter(F.regexp_extract_all(c, F.lit(r"(?<![0-9])([0-9]{13,19})(?![0-9])"), F.lit(1)), lambda x: F.call_function("luhn_check", x))
    return df.agg(
        F.count_if(c.rlike(r"(^|[^0-9])[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}([^0-9]|$)")).alias("spaced_numbers"),
        F.count_if(c.rlike("[0-9]{9,}")).alias("long_digit_runs"),
        F.count_if(F.size(cards) > 0).alias("card_numbers"),
        F.count_if(F.lower(c).rlike("|".join(FORBIDDEN))).alias("forbidden_terms"),
    )
