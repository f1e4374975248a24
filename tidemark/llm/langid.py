"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary, cut from a bounded sample of its labelled documents. A text is
compressed against every dictionary, whole, in blocks of a few KB so that the dictionary counts all the way through; the
smallest total wins. Where the runner-up is within the margin, the text can be rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import hash60

OTHER = re.compile(r"[\W\d_]+")
BLOCK = 4096


def plain(text: str) -> bytes:
    """What is compressed: the letters in lower case, runs of anything else as one space."""
    return OTHER.sub(" ", text).lower().encode()


def learn_dictionaries(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = 131072, slice_chars: int = 1024) -> dict[str, bytes]:
    """A raw-content dictionary per language, of at most dict_bytes, from slices of hash-sampled labelled documents.

    What reaches the driver is bounded: about 4 * dict_bytes / slice_chars slices a language, whatever the table's size.
    Null languages and null or empty texts teach nothing, and a row that repeats teaches once. Rows are sampled by id and
    text, so that rows with one id, or none, are no block. No labelled rows: no dictionaries.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    wanted = 4 * dict_bytes // slice_chars
    limit = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, wanted / n) * 2**60))])
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - slice_chars, F.lit(1))).cast("int") + 1
    picked = rows.withColumn("h", hash60(F.concat_ws(" ", F.col("id").cast("string"), F.xxhash64("text")))).where(F.col("h") < limit[F.col("lang")]).select("lang", "h", F.substring("text", start, F.lit(slice_chars)).alias("part")).distinct()
    parts: dict[str, list] = {}
    for r in picked.collect():
        parts.setdefault(r["lang"], []).append((r["h"], r["part"]))
    out = {}
    for lang in sorted(parts, key=lambda x: (-counts[x], x)):
        seen, size, taken = set(), 0, []
        for _, part in sorted(parts[lang]):
            data = plain(part)
            if data and part not in seen and size < dict_bytes:
                seen.add(part)
                taken.append(data[: dict_bytes - size])
                size += len(taken[-1])
        if taken:
            out[lang] = b"\n".join(taken)[:dict_bytes]
    return out


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes], level: int):
        import zstandard

        self.langs = list(dictionaries)
        self.packs = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.packs.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> list[int]:
        data = plain(text)
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return [sum(len(pack(b)) for b in blocks) for pack in self.packs]


def classify(sizes: list[int], langs: list[str]) -> tuple[str, float, float]:
    """The language, a score from 0 to 1, and the runner-up's relative excess in size (the margin)."""
    k = min(range(len(sizes)), key=sizes.__getitem__)  # ties: the more frequent language, which comes first
    rest = [s / sizes[k] - 1 for i, s in enumerate(sizes) if i != k]
    return langs[k], 1.0 / (1.0 + sum(math.exp(-60.0 * x) for x in rest)), min(rest, default=1.0)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.0, level: int = 9) -> DataFrame:
    """One row per input row: id, lang_pred, score, margin, rejected. Only the text is looked at. No shuffle.

    Null texts, texts without a letter, and all texts where nothing was learned: lang_pred 'und', score and margin 0.
    Whole texts are compressed, whatever their length; rows that repeat are answered alike. Empty table: empty result.
    rejected: the margin is below min_margin (lang_pred keeps the best guess).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = Compressors(dictionaries, level)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                rows.append(classify(packs.sizes(text), packs.langs) if text and packs.langs and any(map(str.isalpha, text)) else ("und", 0.0, 0.0))
            lang, score, margin = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array([x < min_margin or n == "und" for x, n in zip(margin, lang, strict=True)], pa.bool_())],
                ["id", "lang_pred", "score", "margin", "rejected"],
            )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
