"""Helpers shared by the corpus operators: the shared scratch folder, table reading, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return scratch(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and any executor can read it again."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like materialize, dealt into files by the key's hash, which Spark knows when it reads them: joins on the key don't shuffle
    these rows again. The table stands in the session's catalog, its files in the shared folder."""
    spark, table = df.sparkSession, f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", f"{scratch(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def ship(spark: SparkSession) -> None:
    """Lets Python workers on this machine, or with this folder mounted, import the package; else ship it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no column called so, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pow2_at_least(x: float) -> int:
    n = 1
    while n < x:
        n *= 2
    return n


def bitmap(spark: SparkSession, rows: DataFrame, spot: str, bits: int):
    """A broadcast bitmap of 2^bits bits, in bytes from the lowest bit up, in which the rows' spots (0 to 2^bits - 1) are set. The
    driver gets no more than the bitmap; rows without a spot are skipped."""
    import numpy as np

    at = F.col(spot) + 1  # these functions count from one
    parts = rows.where(F.col(spot).isNotNull()).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out)]
        out[(r["bucket"] - 1) * 4096 :][: len(part)] = part
    return spark.sparkContext.broadcast(out)
