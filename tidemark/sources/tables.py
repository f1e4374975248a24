"""Catalog tables of batches, bucketed: a batch that is loaded again replaces itself, and what groups or joins by the bucketing
columns reads them without a shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = "batch"


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _bucketing(about: dict[str, str]) -> list[str]:
    """The bucketing columns that DESCRIBE tells."""
    return [c.strip().strip("`") for c in about["Bucket Columns"].strip("[]").split(",")]


def open_table(spark: SparkSession, name: str, path: str, schema: T.StructType, by: list[str], buckets: int) -> DataFrame:
    """The table at path with all its batches, entered into the session's catalog if it isn't there; a new one is empty.

    Rows are dealt by the columns `by`. Name a span of time beside an entity, so that an entity with very many rows is many
    buckets. A bucket is one task's read, so choose as many as make it some hundred MB. ValueError if schema has a column
    `batch`, or if the catalog has the name with other columns, bucketing or place.
    """
    if BATCH in (f.name.lower() for f in schema.fields):
        raise ValueError(f"the column {BATCH} is the table's own")
    columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, {BATCH} BIGINT) USING parquet PARTITIONED BY ({BATCH}) CLUSTERED BY ({', '.join(map(_quoted, by))}) INTO {buckets} BUCKETS LOCATION '{place}'")
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    found = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema.fields]
    wanted = [*((f.name, f.dataType.simpleString()) for f in schema.fields), (BATCH, "bigint")]
    if found != wanted or _bucketing(about) != by or int(about["Num Buckets"]) != buckets or not about["Location"].rstrip("/").endswith(path.split(":", 1)[-1].lstrip("/").rstrip("/")):
        raise ValueError(f"{name} is in the catalog with other columns, bucketing or place")
    # An empty append, so that the folder is there to be searched for batches.
    spark.createDataFrame([], schema).withColumn(BATCH, F.lit(0)).write.mode("append").partitionBy(BATCH).parquet(path)
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.table(name)


def load(df: DataFrame, name: str, batch: int) -> None:
    """Writes df as the table's batch of that number, in the place of what the batch held: a load that is tried again adds
    nothing, and an empty df empties the batch. After a load that failed the batch may be missing until it is loaded again.
    Columns are taken by name; others than the table's are left out."""
    spark = df.sparkSession
    about = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    by = _bucketing(about)
    # Dealt like the buckets, so that each task writes whole buckets and not a file for every bucket.
    rows = df.select([_quoted(c) for c in spark.table(name).columns if c != BATCH]).repartition(int(about["Num Buckets"]), *map(_quoted, by))
    view = f"load_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    try:
        spark.sql(f"INSERT OVERWRITE TABLE {name} PARTITION ({BATCH} = {int(batch)}) SELECT * FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
