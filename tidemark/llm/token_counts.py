"""Exact token counts of a byte-fallback piece BPE, by merging batches of pre-tokens as numpy arrays.

No piece of the vocabulary spans the border between a character and a following space mark, nor holds a character that is
not itself a piece, so a text falls apart there into pre-tokens that merge on their own. Each batch's unseen pre-tokens
are laid out as ragged arrays of symbols (one flat array, rows by length class); in every round each row applies its own
best-ranked pair, leftmost first, all rows at once, until no row has a pair left. The survivors are the tokens; symbols
that are not pieces count as their UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NO_PAIR = np.iinfo(np.int64).max
#: Rows up to this length merge as arrays; longer ones one by one with a heap, which stays near-linear in their length.
ARRAY_ROW = 256
CACHED = 400_000


class PieceModel:
    """The merge table of a sentencepiece BPE model: pair of symbols -> rank and merged symbol."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        names = sorted(pieces, key=pieces.get)
        self.symbols = {p: k for k, p in enumerate(names)}
        n = len(names)
        pairs = {}
        for p in names:
            for cut in range(1, len(p)):
                a, b = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = self.symbols[p]
        # Symbols are numbered by rank, so the merged symbol is its own rank.
        self.base, self.keys = n, np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.pairs = pairs
        single = sorted(p for p in names if len(p) == 1 and p != SPACE)
        known = "".join(re.escape(c) for c in single)
        if any(SPACE in p.lstrip(SPACE) for p in names):
            raise ValueError("pieces span words: this model needs whole texts as rows")
        self.split = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{known}{SPACE}]").findall
        self.cache: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where the two do not merge or a side is empty (-1)."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NO_PAIR)

    def survivors(self, rows: np.ndarray) -> np.ndarray:
        """Symbols left in each row (a matrix padded by -1 on the right) after all merges."""
        left = (rows >= 0).sum(axis=1)
        todo, at = rows, np.arange(len(rows))
        rank = self.ranks(todo[:, :-1].ravel(), todo[:, 1:].ravel()).reshape(len(todo), -1)
        while rank.shape[1] and len(todo):
            best = rank.argmin(axis=1)
            score = rank[np.arange(len(rank)), best]
            live = score != NO_PAIR
            if not live.all():
                todo, at, rank, best, score = todo[live], at[live], rank[live], best[live], score[live]
                if not len(todo):
                    break
            k = np.arange(len(todo))
            width = todo.shape[1]
            # The pair becomes one symbol and what stands behind it moves up by one.
            cols = np.arange(width - 1)[None, :]
            moved = np.where(cols > best[:, None], todo[:, 1:], todo[:, :-1])
            moved[k, best] = score
            todo = moved
            left[at] -= 1
            rank = np.where(np.arange(width - 2)[None, :] > best[:, None], rank[:, 1:], rank[:, :-1])
            for shift in (-1, 0):  # only the pairs on both sides of the new symbol change
                i = best + shift
                ok = (i >= 0) & (i < width - 2)
                rank[k[ok], i[ok]] = self.ranks(todo[k[ok], i[ok]], todo[k[ok], i[ok] + 1])
        return left

    def long_row(self, row: list[int]) -> int:
        """The same for one long row, by a heap of (rank, place)."""
        nxt, prev = list(range(1, len(row) + 1)), list(range(-1, len(row) - 1))
        n, sym, left = len(row), list(row), len(row)
        get = self.pairs.get
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := get(sym[i] * self.base + sym[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j], nxt[i], left = r, -1, nxt[j], left - 1
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := get(r * self.base + sym[nxt[i]])) is not None:
                    heapq.heappush(heap, (q, i, r, sym[nxt[i]]))
            if prev[i] >= 0 and (q := get(sym[prev[i]] * self.base + r)) is not None:
                heapq.heappush(heap, (q, prev[i], sym[prev[i]], r))
        return left

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token."""
        get = self.symbols.get
        out = np.zeros(len(words), dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = "".join(words)
        codes = np.frombuffer(flat.encode("utf-32-le"), dtype=np.uint32)
        chars, at = np.unique(codes, return_inverse=True)
        symbol = np.array([s if (s := get(chr(c))) is not None else -1 for c in chars.tolist()], dtype=np.int64)
        ids, starts = symbol[at] if len(at) else np.zeros(0, np.int64), np.cumsum(sizes) - sizes
        for i in np.nonzero(ids[np.minimum(starts, len(ids) - 1)] < 0)[0].tolist():  # a lone character that is no piece
            out[i] = len(words[i].encode())
        todo = np.nonzero(out == 0)[0]
        edges = [0, 4, 8, 16, 32, 64, 128, ARRAY_ROW]
        for low, high in zip(edges, edges[1:], strict=False):
            rows = todo[(sizes[todo] > low) & (sizes[todo] <= high)]
            if len(rows):
                span = np.arange(high)[None, :]
                inside = span < sizes[rows][:, None]
                m = np.where(inside, ids[np.minimum(starts[rows][:, None] + span, len(ids) - 1)], -1)
                out[rows] = self.survivors(m)
        for i in todo[sizes[todo] > ARRAY_ROW].tolist():
            out[i] = self.long_row(ids[starts[i] : starts[i] + sizes[i]].tolist())
        return out.tolist()

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        rows = [self.split(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.cache) > CACHED:
            self.cache.clear()
        cache = self.cache
        new = list({w for row in rows for w in row if w not in cache})
        if new:
            cache.update(zip(new, self.count(new), strict=True))
        get = cache.__getitem__
        return [sum(map(get, row)) for row in rows]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def token_counts(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, step: int = 512) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit. The model file must be at the same path on every executor.

    Null text counts as empty: 0 bytes, 0 tokens. Ids may repeat or be null. Other columns are ignored. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = m.totals(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(work, f"id {src.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
