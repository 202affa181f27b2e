"""Exact token counts at every prefix of a text, by dynamic programming.

The vocabulary is a sentencepiece BPE model whose pieces hold a word marker only
in front, so a text falls into chunks (spaces and the word after them) that
never merge with each other. Within a chunk the encoding of a prefix is found
from those of shorter prefixes: its last piece is the one piece p, ending
there, that the library leaves standing after the last piece of the prefix
before p. The count at a prefix is one more than the count before its last
piece. Counts of a text are its chunks' counts on top of running totals, and
truncation or budget questions are searches in them: nothing is encoded again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import forget_others, remembered, slices

MODEL = "piece_bpe_32k.model"
#: Different chunks that a worker remembers, and slots (a power of two) of its memory of pairs of pieces.
REMEMBERED, PAIR_SLOTS = 800_000, 1 << 21
#: Chunks of up to so many code points are solved many at a time.
SHORT = 48
_CHUNK = re.compile(r" +[^ ]*")
#: A line break is no part of any piece but its own byte's, so nothing merges across it.
_WALL = "\n"
_BYTE = -1
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class PrefixCounter:
    """Prefix counts under one sentencepiece BPE model (identity normalisation, byte fallback)."""

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.vocab_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        self.pieces = {p: i for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.text = pieces
        self.longest = max(map(len, self.pieces))
        self.stands: dict[int, bool] = {}
        self.totals: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.pair_keys = np.full(PAIR_SLOTS, -1, dtype=np.int64)
        self.pair_stands = np.zeros(PAIR_SLOTS, dtype=bool)
        self.slots = self._slots()

    def _slots(self) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Hash tables of the pieces; a piece whose slot is taken goes to the next table."""
        left, out, shift = [(p, i) for p, i in self.pieces.items()], [], 44
        with np.errstate(over="ignore"):
            while left:
                keys, ids = np.zeros(1 << 20, dtype=np.uint64), np.full(1 << 20, -1, dtype=np.int32)
                rest = []
                for p, i in left:
                    h = np.uint64(0)
                    for c in p:
                        h = h * _STEP + np.uint64(ord(c) + 1)
                    slot = int(h * _SPREAD >> np.uint64(shift)) & 0xFFFFF
                    if ids[slot] >= 0:
                        rest.append((p, i))
                    else:
                        keys[slot], ids[slot] = h, i
                out.append((keys, ids, shift))
                left, shift = rest, shift - 7
        return out

    def _pieces(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        found = np.full(len(hashes), -1, dtype=np.int64)
        for keys, ids, shift in self.slots:
            slot = ((hashes * _SPREAD) >> np.uint64(shift)).astype(np.int64) & 0xFFFFF
            found = np.where((keys[slot] == hashes) & (ids[slot] >= 0), ids[slot], found)
        return found

    def _all_stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * 1_000_003 + right
        slot = ((keys * 0x9E3779B1) >> 11) & (PAIR_SLOTS - 1)
        strange = np.flatnonzero(self.pair_keys[slot] != keys)
        out = self.pair_stands[slot]
        if len(strange):
            new, where = np.unique(keys[strange], return_inverse=True)
            known = np.array([self._stands(k // 1_000_003, k % 1_000_003) for k in new.tolist()], dtype=bool)
            out[strange] = known[where]
            self.pair_keys[slot[strange]] = keys[strange]
            self.pair_stands[slot[strange]] = out[strange]
        return out

    def _solve(self, chunks: list[str]) -> np.ndarray:
        """Counts (prefix length x chunk) of short chunks given by descending length."""
        sizes = np.array([len(c) for c in chunks])
        most, n = int(sizes[0]), len(chunks)
        codes = np.frombuffer("".join(c.ljust(most, "\0") for c in chunks).replace(" ", "▁").encode("utf-32-le"), dtype=np.uint32).reshape(n, most).T.astype(np.uint64)
        width = 1 + (codes > 0x7F).astype(np.int32) + (codes > 0x7FF) + (codes > 0xFFFF)
        counts, last = np.zeros((most + 1, n), dtype=np.int32), np.full((most + 1, n), _BYTE, dtype=np.int64)
        with np.errstate(over="ignore"):
            prefix = np.zeros((most + 1, n), dtype=np.uint64)
            for i in range(most):
                prefix[i + 1] = prefix[i] * _STEP + codes[i] + np.uint64(1)
            power = [np.uint64(1)]
            for _ in range(self.longest):
                power.append(power[-1] * _STEP)
            for end in range(1, most + 1):
                open_ = np.arange(np.searchsorted(-sizes, -end, side="right"))
                for start in range(max(0, end - self.longest), end):
                    piece = self._pieces(prefix[end][open_] - prefix[start][open_] * power[end - start])
                    hit = np.flatnonzero(piece >= 0)
                    if not len(hit):
                        continue
                    row, piece = open_[hit], piece[hit]
                    before = last[start][row]
                    fits = before == _BYTE
                    ask = np.flatnonzero(~fits)
                    if len(ask):
                        fits[ask] = self._all_stand(before[ask], piece[ask])
                    row, piece = row[fits], piece[fits]
                    counts[end][row] = counts[start][row] + 1
                    last[end][row] = piece
                    left = np.ones(len(open_), dtype=bool)
                    left[hit[fits]] = False
                    open_ = open_[left]
                    if not len(open_):
                        break
                counts[end][open_] = counts[end - 1][open_] + width[end - 1][open_]
        return counts

    def _learn(self, chunks: list[str]) -> None:
        if len(self.stands) > PAIR_SLOTS:
            self.stands.clear()
        short = sorted((c for c in chunks if len(c) <= SHORT), key=len, reverse=True)
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            counts = self._solve(part)
            ends = counts[[len(c) for c in part], np.arange(len(part))].tolist()
            self.totals.update(zip(part, ends))
        for c in chunks:
            if len(c) > SHORT:
                self.totals[c] = self.chunk(c)[-1]

    def _stands(self, left: int, right: int) -> bool:
        """Whether the library leaves the two pieces apart when one follows the other."""
        key = left * 1_000_003 + right
        known = self.stands.get(key)
        if known is None:
            got = self.model.encode((_WALL + self.text[left] + self.text[right]).replace("▁", " "))
            known = self.stands[key] = got[-2:] == [left, right] and len(got) == 4
        return known

    def chunk(self, chunk: str) -> tuple[int, ...]:
        """Token counts of the prefixes of 0, 1, 2, ... code points of one chunk."""
        marked = chunk.replace(" ", "▁")
        counts, last = [0], [_BYTE]
        pieces, stands = self.pieces, self.stands
        for end in range(1, len(marked) + 1):
            char = marked[end - 1]
            if char not in pieces:
                counts.append(counts[-1] + len(char.encode()))
                last.append(_BYTE)
                continue
            for start in range(max(0, end - self.longest), end):
                piece = pieces.get(marked[start:end])
                if piece is None:
                    continue
                before = last[start]
                if before != _BYTE:
                    fits = stands.get(before * 1_000_003 + piece)
                    if not (self._stands(before, piece) if fits is None else fits):
                        continue
                counts.append(counts[start] + 1)
                last.append(piece)
                break
        return tuple(counts)

    def _chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text.replace("▁", " ")) if text else []

    def totals_of(self, texts: list[str]) -> list[int]:
        """Tokens of the whole texts: the counts at their last prefixes."""
        if len(self.totals) > REMEMBERED:
            self.older, self.totals = self.totals, {}
        split = [self._chunks(t) for t in texts]
        totals, older = self.totals, self.older
        unknown = []
        for c in {c for chunks in split for c in chunks if c not in totals}:
            n = older.get(c)
            if n is None:
                unknown.append(c)
            else:
                totals[c] = n
        if unknown:
            self._learn(unknown)
        lookup = totals.__getitem__
        return [sum(map(lookup, chunks)) for chunks in split]

    def table(self, text: str) -> np.ndarray:
        """Token count of each prefix of 0, 1, ..., len(text) code points."""
        parts, before = [np.zeros(1, np.int64)], 0
        for i, c in enumerate(self._chunks(text)):
            counts = np.array(self.chunk(c), dtype=np.int64)
            # The first chunk's leading space is the library's own and counts with the first code point.
            parts.append(before + counts[1 + (i == 0) :])
            before += int(counts[-1])
        return np.concatenate(parts)

    @staticmethod
    def fitting(table: np.ndarray, budget: int) -> int:
        """Code points of the longest prefix of at most `budget` tokens: a search in a text's table."""
        fits = np.flatnonzero(table <= budget)
        return int(fits[-1]) if len(fits) else 0


def counter(path: str) -> PrefixCounter:
    held = remembered("tokens")
    if path not in held:
        held[path] = PrefixCounter(path)
    return held[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, model_path: str | None = None, budgets: tuple[int, ...] = ()) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, and fit_<budget> (code points) for each budget, per row.

    Counts are the library's for the whole text without added tokens. Null texts
    count as empty: no bytes, no tokens. Ids may be null or repeat; every row
    gives one row, an empty table none. Texts of any length take memory by their
    own length. Other columns of any name are not looked at.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("tokens")
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [n for a, b in slices([t.encode() for t in texts]) for n in own.totals_of(texts[a:b])]
            fit = [[own.fitting(table, b) for b in budgets] for table in map(own.table, texts)] if budgets else []
            fits = [pa.array([f[k] for f in fit], pa.int64()) for k in range(len(budgets))]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), *fits]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit", *(f"fit_{b}" for b in budgets)])

    schema = f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean" + "".join(f", fit_{b} long" for b in budgets)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(count, schema)


def prefix_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """id and prefix_tokens array<int>: the exact token count at every prefix (entry i: first i code points)."""
    path = model_path or public_tokenizers.path(MODEL)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("tokens")
        own = counter(path)
        for batch in batches:
            for i, t in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([own.table(t or "")], pa.list_(pa.int32()))], [id_col, "prefix_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tables, f"{id_col} long, prefix_tokens array<int>")
