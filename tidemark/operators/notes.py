"""Assessment of investigators' review notes, which are JSON: references, prohibited keys, and closure with open evidence."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TRUTH

# The note's format.
PROHIBITED = (*TRUTH, "ground_truth")
RECOMMENDATIONS = ("request_information", "escalate_for_review", "propose_closure")
CLOSURE = "propose_closure"
TEXTS = ("alternative_explanation", "discriminator", "analysis", "recommended_next_step")
FILING = "NOT FILED"


def holds_key(document: Column, names: tuple[str, ...]) -> Column:
    """Whether a VARIANT has one of the names (of letters, digits and _) as a key of an object at any depth.

    Its text is canonical: escapes are resolved and no blanks stand outside of strings, so {" or ," before and ": behind
    a name are found around keys only.
    """
    return F.coalesce(document.cast("string").rlike(rf'[{{,]"({"|".join(names)})":'), F.lit(False))


def case_references(register: DataFrame, graph: DataFrame) -> DataFrame:
    """(investigation_id, source_ref): what a note on a case may cite: its entry in the register, and its entity's counterparties."""
    own = register.select("investigation_id", F.concat(F.lit("register:"), F.col("investigation_id")).alias("source_ref"))
    near = graph.select("entity_id", "counterparty_id").distinct().join(register.select("entity_id", "investigation_id"), "entity_id")
    return own.unionByName(near.select("investigation_id", F.concat(F.lit("counterparty:"), F.col("counterparty_id")).alias("source_ref")))


def assess(notes: DataFrame, register: DataFrame, references: DataFrame, text_col: str = "note") -> DataFrame:
    """The columns of notes, and investigation_id, problems (array), status (READY FOR REVIEW or BLOCKED).

    references: investigation_id, source_ref. A note must be a JSON object of version 1 without repeated keys, name a
    registered case, hold no label key at any depth, give a known recommendation and facts with known references, fill its
    texts, list what evidence is missing, not close while some is, and claim neither approval nor a filing. A null text, or one
    that isn't JSON or too large for a VARIANT, is blocked with investigation_id null. Equal texts are assessed once; rows of
    notes stay as they are, repeated ones too.
    """
    spare = [c for c in ("investigation_id", "problems", "status", "_text") if c in notes.columns]
    if spare:
        raise ValueError(f"notes has columns of the result: {spare}")
    texts = notes.select(F.col(text_col).alias("_text")).distinct().withColumn("v", F.try_parse_json("_text"))
    kind = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    value = lambda path, t: F.try_variant_get("v", path, t)
    filled = lambda path: (kind(path) == "STRING") & value(path, "string").rlike(r"\S")
    facts, missing = value("$.observed_facts", "array<variant>"), value("$.missing_evidence", "array<variant>")
    named = F.when(kind("$.investigation_id") == "STRING", value("$.investigation_id", "string"))
    of = lambda x, path, t="string": F.try_variant_get(x, path, t)
    parsed = texts.withColumns({"investigation_id": named, "facts": facts, "missing": missing})
    cited = parsed.select("_text", "investigation_id", F.explode(F.array_distinct(F.transform("facts", lambda x: F.coalesce(of(x, "$.source_ref"), F.lit(""))))).alias("source_ref"))
    unknown = cited.join(references.select("investigation_id", "source_ref"), ["investigation_id", "source_ref"], "left_anti").select("_text").distinct().withColumn("unknown", F.lit(True))
    known = register.select("investigation_id").distinct().withColumn("registered", F.lit(True))
    df = parsed.join(known, "investigation_id", "left").join(unknown, "_text", "left")
    holds = lambda c: F.coalesce(c, F.lit(False))
    # Problems by what must hold; what is absent or of another type does not.
    musts = {
        "not a version 1 note": (kind("$.schema_version") == "BIGINT") & (value("$.schema_version", "long") == 1),
        "unknown investigation": F.col("registered"),
        "holds a label key": ~holds_key(F.col("v"), PROHIBITED),
        "unknown recommendation": value("$.recommendation", "string").isin(*RECOMMENDATIONS),
        "no facts": F.size("facts") > 0,
        "a fact without an observation": F.coalesce(F.forall("facts", lambda x: F.coalesce(of(x, "$.observation").rlike(r"\S"), F.lit(False))), F.lit(True)),
        "unknown references": F.col("unknown").isNull(),
        "a text field is empty": reduce(and_, [holds(filled(f"$.{c}")) for c in TEXTS]),
        "missing evidence is not a list of texts": F.forall("missing", lambda x: F.coalesce((F.schema_of_variant(x) == "STRING") & x.cast("string").rlike(r"\S"), F.lit(False))),
        "closes while evidence is missing": ~((value("$.recommendation", "string") == CLOSURE) & F.coalesce(F.size("missing") > 0, F.lit(False))),
        "claims approval or a filing": (kind("$.human_approved") == "BOOLEAN") & ~value("$.human_approved", "boolean") & (value("$.filing_status", "string") == FILING),
    }
    found = F.filter(F.array(*[F.when(~holds(must), F.lit(problem)) for problem, must in musts.items()]), lambda x: x.isNotNull())
    status = F.when(F.size("problems") == 0, "READY FOR REVIEW").otherwise("BLOCKED")
    assessed = df.select("_text", "investigation_id", found.alias("problems")).withColumn("status", status)
    return notes.join(assessed, notes[text_col].eqNullSafe(assessed["_text"]), "left").drop("_text")
