"""The corpus pipeline: documents to packed sequences, in five stages that are each one of the corpus operators.

A stage takes all that its predecessor kept; its result is written as Parquet in the shared folder and read again as the
next stage's documents. The last stage's rows are the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ship, table
from tidemark.llm.mixing import apply_mix
from tidemark.llm.packing import pack
from tidemark.llm.pii import replace
from tidemark.llm.quality import keep_good
from tidemark.llm.queries import PII_KEY, quality_model, tokenizer_path
from tidemark.llm.simhash import drop_near_duplicates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels outside the held-out fold, rejects go."""
    ship(spark)
    return keep_good(docs, quality_model(spark, docs, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    ship(spark)
    return drop_near_duplicates(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced; n_chars follows the new text."""
    ship(spark)
    names = docs.columns
    out = replace(docs, PII_KEY)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    ship(spark)
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("surrogates", surrogates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the classifier nor XXH64 fingerprints nor the tokenizer: tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
