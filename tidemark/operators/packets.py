"""What leaves the register: a Markdown packet for each case, made and written on the executors, the release's summary, and a
manifest of written files as a tree of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cases import release_decision

#: Counterparties that a packet lists.
LISTED = 20


def escaped(text) -> F.Column:
    """Text inside Markdown tables: bars and dollar signs, which start formulas there, are escaped."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("$"), F.lit("\\$"))


def case_packets(register: DataFrame, graph: DataFrame, listed: int = LISTED) -> DataFrame:
    """(priority, investigation_id, packet): the case's facts, and its counterparties with the largest amounts, of equal ones
    the first by id, as a table; how many more there are is told."""
    order = Window.partitionBy("entity_id").orderBy(F.desc("amount_cad"), "counterparty_id")
    ranked = graph.withColumn("nth", F.row_number().over(order))
    row = F.concat(F.lit("| "), escaped(F.col("counterparty_id")), F.lit(" | "), F.col("transactions").cast("string"), F.lit(" | \\$"), F.format_number("amount_cad", 2), F.lit(" | "), F.col("directions"), F.lit(" |"))
    listed_rows = F.collect_list(F.when(F.col("nth") <= listed, F.struct("nth", row.alias("row"))))
    # The table and the count come from one pass over the edges.
    tables = ranked.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(listed_rows), lambda x: x["row"]), "\n").alias("rows"), F.count(F.lit(1)).alias("edges"))
    joined = register.join(tables, "entity_id", "left")
    more = F.coalesce("edges", F.lit(0)) - F.least(F.coalesce("edges", F.lit(0)), F.lit(listed))
    packet = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("investigation_id")), F.lit(""), F.concat(F.col("priority"), F.lit(", due in "), F.col("due_hours").cast("string"), F.lit(" hours: "), F.col("case_state"), F.lit(".")),
        F.concat(F.lit("Hypothesis: "), F.col("typology_hypothesis"), F.lit("; rules: "), F.col("rules_fired"), F.lit(".")),
        F.concat(F.col("flagged_transactions").cast("string"), F.lit(" payments of \\$"), F.format_number("amount_involved_cad", 2), F.lit(".")),
        F.concat(F.lit("Evidence: "), escaped(F.col("evidence_references"))), F.col("decision_status"), F.lit(""), F.lit("| Counterparty | Payments | Amount | Directions |"), F.lit("|---|---|---|---|"), F.col("rows"),
        F.concat(F.lit("Further counterparties: "), more.cast("string")),
    )
    return joined.select("priority", "investigation_id", packet.alias("packet"))


def write_packets(packets: DataFrame, path: str) -> None:
    """A folder of text files for each priority; packets are parted by a line of '---'."""
    packets.select("priority", F.col("packet").alias("value")).write.partitionBy("priority").option("lineSep", "\n---\n").mode("errorifexists").text(path)


def release_summary(register: DataFrame, graph: DataFrame, gates: DataFrame) -> DataFrame:
    """One row: the decision, gates by status, investigations by priority, edges."""
    bands = register.agg(F.count(F.lit(1)).alias("investigations"), *[F.count_if(F.col("priority") == p).alias(f"{p.lower()}_investigations") for p in ("P0", "P1", "P2")])
    edges = graph.agg(F.count(F.lit(1)).alias("graph_edges"))
    return release_decision(gates).crossJoin(bands).crossJoin(edges)  # one row each


def manifest(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """(name, bytes, sha256) of the files at path and below: each is hashed in a task, none passes the driver.
    Empty files are left out, as Spark skips them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    return found.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_root(files: DataFrame) -> DataFrame:
    """(files, bytes, root): lines of name, space, hash in order are hashed by the first two digits of the name's hash, and the
    at most 256 hashes of these in their order once more."""
    line = F.struct("name", F.concat_ws(" ", "name", "sha256").alias("line"))
    parts = files.groupBy(F.substring(F.sha2("name", 256), 1, 2).alias("p")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("root"))
