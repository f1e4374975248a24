"""Best-fit packing of token sequences, planned over a histogram of lengths.

Best-fit decreasing runs over counts of lengths, never over documents: open sequences with the same room left form one
group, so the plan's size depends on the sequence length alone. The plan gives, for each length, which ranks go to which
sequences at which place; each document piece takes the slot of its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pow2_at_least

#: The split pattern of byte-level BPE vocabularies of this family: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern has it: fixed values.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on are cut out before splitting, in texts from that length on: the splitter's stack
#: gives out at some 900,000.
LONG_RUN, LONG_TEXT = 1000, 100_000
SALT_ROWS = 2048


class ByteBpe:
    """Ids of a byte-level BPE by tiktoken, special strings as special ids, and texts with white space of any length."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]):
        import tiktoken

        self.split = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.ranks, self.special = ranks, special
        self.specials = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None
        self.run = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")

    @cached_property
    def whole(self):
        """The same vocabulary over unsplit texts; few texts need it."""
        import tiktoken

        return tiktoken.Encoding("byte-bpe-runs", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_TEXT or not self.run.search(text):
            return self.split.encode(text, allowed_special="all")
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            out += [self.special[part]] if part in self.special else self.around_runs(part)
        return out

    def around_runs(self, text: str) -> list[int]:
        """The pattern takes a run of white space but for its last character, which stays with what follows, or to the end."""
        out, at = [], 0
        for m in self.run.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += self.split.encode_ordinary(text[at : m.start()]) + self.whole.encode_ordinary(text[m.start() : end])
            at = end
        return out + self.split.encode_ordinary(text[at:])


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """The byte-level BPE of a tokenizers .json file, run by tiktoken: the same ids several times faster.

    Special strings in a text become their special ids, as is the tokenizers library's default. A file whose text is
    normalised or split in another way, whose merges are not in the order of their ids, or whose special strings take in
    what stands around them, is refused.
    """

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
    merged = [vocab[x.replace(" ", "") if isinstance(x, str) else "".join(x)] for x in spec["model"]["merges"]]
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError("not a plain byte-level BPE with merges in the order of their ids")
    if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
        raise ValueError("special strings take in what stands around them")
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return ByteBpe(ranks, special)


def pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, spread): each document's ids and end_id, longer ones cut into pieces of size
    tokens of which the first may be shorter. spread tells rows apart that are the same otherwise."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer).encode
        for batch in batches:
            for first in range(0, batch.num_rows, 512):  # the texts of few rows at a time are held
                part, rows = batch.slice(first, 512), []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    rows += [(k, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                row, n, start, length, crc = zip(*rows, strict=True)
                spread = pa.array(np.array(row, dtype=np.int32) + first)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), spread], ["id", "piece", "start", "length", "ids_crc32", "spread"]
                )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, spread int")


def plan(counts: dict[int, int], size: int = 2048) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): ranks from there on take successive sequences at that offset.

    Lengths go from long to short, each into the open sequences with the least room that fits; a sequence takes as many
    of one length as fit. A group is a range of sequences with the same room.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    opened, runs = 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else size
            fit = min(room // length, left)
            n = left // fit
            if at < len(rooms):
                first, have = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
                n = min(n, have)
                put(room, first + n, have - n)
            else:
                first, opened = opened, opened + n
            for k in range(fit):
                runs.append((length, rank + k * n, first, size - room + k * length))
            put(room - fit * length, first, n)
            left, rank = left - fit * n, rank + fit * n
    return runs


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Texts are read once and not shuffled.

    Null text counts as empty: one piece with end_id alone. Ids may repeat or be null. Empty table: empty result.
    Rows that repeat, and texts of any length, are packed like others.
    Ranks within a length are counted in salted parts, each with an offset from the counts, so that a length which very
    many pieces share is dealt to many tasks.
    """
    cut = materialize(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, size=size, end_id=end_id), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `size` rows
    runs = np.array(sorted(plan(counts, size)) or np.zeros((0, 4)), dtype=np.int64)
    planned = cut.sparkSession.sparkContext.broadcast(runs)

    salts = pow2_at_least(sum(counts.values()) / SALT_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "spread"), F.lit(salts)))
    parts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    parts = materialize(parts.select("length", "salt", before.alias("before")), "pack-parts")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "start", "ids_crc32", "spread"))
    ranked = salted.withColumn("local", local).join(parts, ["length", "salt"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = planned.value.reshape(-1, 4).T
        key = length << 40 | first
        for batch in batches:
            rank, size_of = batch.column(5).to_numpy(), batch.column(3).to_numpy()
            at = np.searchsorted(key, size_of << 40 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)
