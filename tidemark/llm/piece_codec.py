"""Encoding and decoding with a merge-type (BPE) sentencepiece model, exactly, by backtracking.

An encoding is the merges' own result if and only if every two neighbouring tokens are what merging their joint text gives.
So a text is walked from the left: at each place the longest piece that starts there (all of them found by one Aho-Corasick
pass) is tried, then its shorter prefixes that are pieces; a piece is taken if it is compatible with the token before it. Where
none is, the place is marked in a bitfield of failed places and the last token gives way to its next shorter prefix. What
stands before a place has one encoding only, so a place that failed once fails always, and no place is tried twice.

Compatibility of two pieces is found by merging their joint text and held in a table of bounded size. No piece spans the border
before a space mark, and characters that are no piece never merge, so a text falls apart there into stretches that are
encoded on their own and remembered, also within bounds; a stretch may be as long as the text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .token_counts import SPACE

#: Stretches, and characters in them, that are remembered at most; stretches above LONG characters are not.
REMEMBERED, REMEMBERED_CHARS, LONG = 400_000, 8_000_000, 64
PAIRS = 600_000


class PieceCodec:
    """A sentencepiece model's pieces, their order of merging, and the pieces of single bytes."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids) or sum(sp.is_byte(i) for i in ids) != 256:
            raise ValueError("the model must have pieces for all bytes and no unused pieces")
        if sp.normalize(" a  \téﬁａé ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}\téﬁａé{SPACE}":
            raise ValueError("the model changes texts before it encodes them")
        normal = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces span words")
        scores = sorted({sp.get_score(i) for i in normal.values()}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {p: place[sp.get_score(i)] for p, i in normal.items()}
        self.begin, self.end, self.n = sp.bos_id(), sp.eos_id(), len(ids)
        self.bytes = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
        self.byte_ids = [self.bytes[f"<0x{b:02X}>"] for b in range(256)]
        # What an id stands for in a decoded text, in UTF-8; begin and end stand for nothing.
        self.stands_for = [b""] * self.n
        for p, i in normal.items():
            self.stands_for[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.stands_for[i] = bytes([b])
        single = "".join(re.escape(p) for p in sorted(normal) if len(p) == 1 and p != SPACE)
        self.stretches = re.compile(f"{SPACE}*[{single}]+|{SPACE}+|[^{single}{SPACE}]").findall
        self.single = {p for p in normal if len(p) == 1}
        # Pieces that their own text merges to; others can't be tokens.
        self.text = {i: p for p, i in normal.items() if self.merged(p) == [p]}
        self.search = ahocorasick.Automaton()
        for i, p in self.text.items():
            self.search.add_word(p, (len(p) - 1, i))
        self.search.make_automaton()
        able = {p: i for i, p in self.text.items()}
        self.shorter = {i: next((able[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in able), None) for i, p in self.text.items()}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.known_chars = 0

    def merged(self, text: str, border: int = 0) -> list[str] | None:
        """The result of merging a short text, always the best pair, the leftmost of equals; None as soon as a merge takes in
        the border after so many characters."""
        rank, none, parts = self.rank.get, self.n, list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            k = ranks.index(best)
            if k == border - 1:
                return None
            if k < border:
                border -= 1
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joint text of two pieces leaves the border between them, and so the two pieces."""
        found = self.fits.get(a * self.n + b)
        if found is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            left = self.text[a]
            found = self.fits[a * self.n + b] = self.merged(left + self.text[b], len(left)) is not None
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch all of whose characters are pieces."""
        longest: list[int | None] = [None] * len(text)
        for end, (back, piece) in self.search.iter(text):  # ends grow, so the longest comes last
            longest[end - back] = piece
        failed = bytearray(len(text) // 8 + 1)
        taken: list[int] = []
        at, piece = 0, longest[0]
        while True:
            while piece is not None:
                after = at + len(self.text[piece])
                if not failed[after >> 3] >> (after & 7) & 1 and (not taken or self.compatible(taken[-1], piece)):
                    break
                piece = self.shorter[piece]
            if piece is None:
                if not taken:
                    raise AssertionError("a text of pieces has an encoding")
                failed[at >> 3] |= 1 << (at & 7)
                last = taken.pop()
                at, piece = at - len(self.text[last]), self.shorter[last]
                continue
            taken.append(piece)
            at += len(self.text[piece])
            if at == len(text):
                return taken
            piece = longest[at]

    def stretch(self, text: str) -> bytes:
        """Ids of a stretch, as little-endian unsigned 32-bit integers."""
        if text[-1] not in self.single:
            ids = [self.byte_ids[b] for b in text.encode()]
        else:
            ids = self.backtrack(text)
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
        known = self.known
        out = [self.begin.to_bytes(4, "little")]
        for s in self.stretches(SPACE + text.replace(" ", SPACE)) if text else ():
            ids = known.get(s)
            if ids is None:
                ids = self.stretch(s)
                if len(s) <= LONG:
                    if len(known) >= REMEMBERED or self.known_chars >= REMEMBERED_CHARS:
                        known.clear()
                        self.known_chars = 0
                    known[s] = ids
                    self.known_chars += len(s)
            out.append(ids)
        out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids: bytes that are no UTF-8 become U+FFFD, and the space put before the text goes."""
        held = array("I", ids)
        text = b"".join(map(self.stands_for.__getitem__, held)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256, and with keep ids (binary, little-endian unsigned 32-bit)
    and decoded. The model file must be at the same path on every executor.

    Null text counts as empty: begin and end alone, decoded as ''. Ids of rows may repeat or be null; each row has its own
    result. Other columns are ignored, whatever their names. A text may be of any length. No shuffle; an empty table gives none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model)

        def rows(batch: pa.RecordBatch, found: list[tuple[bytes, str]]) -> pa.RecordBatch:
            sha = lambda x: hashlib.sha256(x).hexdigest()
            out = [batch.column(0), pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([sha(i) for i, _ in found]), pa.array([sha(t.encode()) for _, t in found])]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                out += [pa.array([i for i, _ in found], pa.binary()), pa.array([t for _, t in found])]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(out, names)

        for batch in batches:
            found, began, size = [], 0, 0
            for k in range(batch.num_rows):
                ids = codec.encode(batch.column(1)[k].as_py() or "")
                found.append((ids, codec.decode(ids)))
                size += len(ids)
                if size > 1 << 24 or k == batch.num_rows - 1:  # what is held is bounded in bytes
                    yield rows(batch.slice(began, k + 1 - began), found)
                    found, began, size = [], k + 1, 0

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    more = ", ids binary, decoded string" if keep else ""
    out = src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
    return out.withColumnRenamed("id", id_col)
