"""Files in and out: CSV, JSON policies, XML by way of screening.read_list, metrics and reports."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTIONS = (
    "transaction_id string, entity_id string, counterparty_id string, txn_datetime string, txn_epoch long, amount_cents long, amount_cad double, direction string, channel string, is_cash int, is_suspicious int, "
    "typology string, typology_variant string, case_id string"
)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header, gzip or not; empty fields of text columns are '' and not null. Without a schema all columns
    are text. Columns that aren't asked for are not parsed."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", False)).csv(path)
    df = df.select(*columns) if columns else df
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """A gzip CSV export; with an order, range-partitioned and sorted, so that its part files read in order are sorted."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode("overwrite").option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)


def read_policy(spark: SparkSession, path: str, required: tuple[str, ...] = ("priority_bands", "typologies"), version: int = 1) -> dict[str, Any]:
    """A JSON policy, read through Spark so that any store will do; ValueError unless its version and keys are as expected."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect())
    policy = json.loads(text)
    if policy.get("schema_version") != version:
        raise ValueError(f"schema_version is {policy.get('schema_version')}, not {version}")
    missing = [k for k in required if k not in policy]
    if missing:
        raise ValueError(f"policy lacks {missing}")
    return policy


def catalogue(spark: SparkSession, policy: dict[str, Any]) -> DataFrame:
    """The policy's typologies, one row each, with minimum_evidence joined by '; '."""
    names = sorted({k for t in policy["typologies"] for k in t} - {"minimum_evidence"})
    rows = [(*[str(t.get(k, "")) for k in names], list(t.get("minimum_evidence", []))) for t in policy["typologies"]]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("minimum_evidence", T.ArrayType(T.StringType()))])
    return spark.createDataFrame(rows, schema).withColumn("minimum_evidence", F.array_join("minimum_evidence", "; "))


def metrics_document(parts: dict[str, DataFrame], most: int = 2_000) -> str:
    """Small result tables as one JSON text; ValueError for a table of more than `most` rows."""
    out = {}
    for name, df in parts.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        out[name] = [r.asDict(recursive=True) for r in rows]
    return json.dumps(out, indent=2, sort_keys=True, default=str)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result table in Markdown; '$' is escaped, as it starts formulas there. ValueError for more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("$", "\\$")
    lines = [df.columns, ["---"] * len(df.columns), *[[cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def canonical_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a text file's content, whatever its line ends and compression (Spark unpacks by the file's suffix). Of several
    files, that of their digests in order. The driver gets digests only."""
    digest = F.sha2(F.replace("value", F.lit("\r\n"), F.lit("\n")), 256)
    found = sorted(r[0] for r in spark.read.text(path, wholetext=True).select(digest).collect())
    return found[0] if len(found) == 1 else hashlib.sha256("".join(found).encode()).hexdigest()
