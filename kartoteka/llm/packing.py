"""Cost-balanced packing of token sequences.

The cost of a document in a sequence is linear plus quadratic (attention) in
its tokens. Documents in descending order go to the sequence of lowest cost
that has room. Full sequences are cut off long documents first. Half of the
documents carry their token ids into the packing step: these may be cut where
they do not fit whole, so that sequences end full; capacities are chosen so
that a group fills them to the last token, its last ones powers of two.
Groups of a bounded number of tokens are packed independently.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kartoteka.llm.common import SPACE, cut, forget_others, give_back, hashed_words, remembered, slices

MODEL, SPECIAL = "word_bpe_49k.json", "<|endoftext|>"
#: Tokens of a sequence, tokens of an independently packed group, and words a worker remembers.
CAPACITY, GROUP_TOKENS, REMEMBERED = 2048, 1 << 21, 600_000
#: Cost of n tokens of one document: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1 / 4096
#: Kinds of bytes: 0 white space, 1 a letter of ASCII, 2 a mark that may end a word, 3 others.
_KINDS = np.full(256, 3, dtype=np.uint8)
_KINDS[SPACE] = 0
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[ord(c) for c in ".,!?;:"]] = 2
_MANY = np.iinfo(np.uint16).max


class WordEncoder:
    """Token ids of whole texts under a BPE whose pre-tokenizer drops white space.

    No token crosses white space, nor lies across a letter and a mark that
    white space follows. Texts are cut there into words; words are told apart
    by 64-bit hashes, and the library encodes each word only once while its
    ids are remembered.
    """

    def __init__(self, path: str, special: str = SPECIAL) -> None:
        self.model = Tokenizer.from_file(path)
        self.special, self.special_id = special, self.model.token_to_id(special)
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.at, self.size = (np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int32))
        self.flat = np.zeros(0, dtype=np.uint32)

    def _encode_new(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words from the library, many in one text with the special token between them."""
        odd = [i for i, w in enumerate(words) if self.special in w]
        apart = set(odd)
        plain = [i for i in range(len(words)) if i not in apart]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        blocks = [plain[i : i + 500] for i in range(0, len(plain), 500)]
        for block, got in zip(blocks, self.model.encode_batch_fast([self.special.join(words[i] for i in b) for b in blocks], add_special_tokens=False)):
            ids = np.array(got.ids, dtype=np.uint32)
            between = np.flatnonzero(ids == self.special_id)
            for i, own in zip(block, np.split(ids[ids != self.special_id], between - np.arange(len(between)))):
                out[i] = own
        for i in odd:
            out[i] = np.array(self.model.encode(words[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Adds words, given by ascending hash."""
        ids = self._encode_new(words)
        sizes = np.array([len(x) for x in ids], dtype=np.int32)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *ids])
        place = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at, self.size = (np.insert(old, place, new) for old, new in ((self.hashes, hashes), (self.at, at), (self.size, sizes)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.hashes) > REMEMBERED:
            self._clear()
        coded = [_lowered(t) for t in texts]
        data = np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)
        kind = _KINDS[data]
        before, after = np.zeros_like(kind), np.zeros_like(kind)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        starts = np.flatnonzero((kind != 0) & (before == 0) | (kind == 2) & (before == 1) & (after == 0))
        ends = np.cumsum([len(t) + 1 for t in coded])
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        segments = np.diff(np.append(starts, len(data)))
        lengths = np.add.reduceat((kind != 0).astype(np.int32), starts)
        words = hashed_words(data, starts, segments, lengths)
        unique, first, which = np.unique(words, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.hashes, unique)
        held = spot < len(self.hashes)
        held[held] = self.hashes[spot[held]] == unique[held]
        if not held.all():
            new = np.flatnonzero(~held)
            raw = data.tobytes()
            at = starts[first[new]]
            self._learn(unique[new], [raw[a : a + n].decode() for a, n in zip(at.tolist(), lengths[first[new]].tolist())])
            spot = np.searchsorted(self.hashes, unique)
        where = spot[which]
        sizes = self.size[where].astype(np.int64)
        done = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.at[where] - (done - sizes), sizes) + np.arange(done[-1])]
        last = np.searchsorted(starts, ends)
        return np.split(ids, np.where(last > 0, done[last - 1], 0)[:-1])


def _lowered(text: str) -> bytes:
    """UTF-8 bytes; A-Z lowered, as the library would, where no letter could combine with what follows."""
    data = text.encode()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return data
    return data.lower()


def encoder(path: str) -> WordEncoder:
    held = remembered("packing")
    if path not in held:
        held[path] = WordEncoder(path)
    return held[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("packing")
        own = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            carries = batch.column(2).to_pylist()
            for a, b in slices([t.encode() for t in texts], 1_000_000):
                totals, fulls, rests, crcs, carried = [], [], [], [], []
                for i, ids in enumerate(own.encode(texts[a:b])):
                    ids = np.append(ids, np.uint32(end_id))
                    whole = len(ids) // capacity
                    rest = ids[whole * capacity :]
                    totals.append(len(ids))
                    fulls.append([crc(ids[j * capacity : (j + 1) * capacity]) for j in range(whole)])
                    rests.append(len(rest))
                    crcs.append(crc(rest))
                    carried.append(rest.astype("<u2" if not len(rest) or rest.max() <= _MANY else "<u4").tobytes() if carries[a + i] else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(totals, pa.int64()), pa.array(fulls, pa.list_(pa.int64())), pa.array(rests, pa.int32()), pa.array(crcs, pa.int64()), pa.array(carried, pa.binary())],
                    ["doc_id", "doc_tokens", "full_crcs", "rest", "rest_crc", "rest_ids"],
                )
        give_back()

    return run


def sequences(rests: list[int], carried: list[bool], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Places rests (tokens of each document, below capacity) in sequences.

    Returns (document, from, length, sequence, offset). Only carried documents
    are cut. Ties go to the earlier document and the earlier sequence.
    """
    total = sum(rests)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (total % capacity) >> b & 1]
    room, cost, filled = np.array(sizes, dtype=np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
    out = []

    def place(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(filled[s])))
        room[s] -= n
        filled[s] += n
        cost[s] += linear * n + quadratic * n * n

    order = sorted((i for i, n in enumerate(rests) if n), key=lambda i: (carried[i], -rests[i], i))
    for i in order:
        start, n = 0, rests[i]
        while n:
            fits = room >= n
            if fits.any():
                place(i, start, n, int(np.where(fits, cost, np.inf).argmin()))
                break
            if carried[i] and (room > 0).any():
                s = int(np.where(room > 0, cost, np.inf).argmin())
                took = int(room[s])
                place(i, start, took, s)
                start, n = start + took, n - took
                continue
            room, cost, filled = np.append(room, capacity), np.append(cost, 0.0), np.append(filled, 0)
    used = np.flatnonzero(filled)
    name = dict(zip(used.tolist(), range(len(used))))
    return [(d, a, n, name[s], o) for d, a, n, s, o in out]


def _packed(capacity: int):
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("row").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids, totals, rests, crcs, carried = (t.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "rest", "rest_crc", "rest_ids"))
        base, local, rows = key[0].as_py() << 32, 0, []
        for i, whole in enumerate(t.column("full_crcs").to_pylist()):
            for j, c in enumerate(whole):
                rows.append((ids[i], j * capacity, capacity, c, totals[i], base + local, 0))
                local += 1
        for d, a, n, s, o in sequences(rests, [x is not None for x in carried], capacity):
            own = crcs[d]
            if n < rests[d]:
                own = crc(np.frombuffer(carried[d], dtype="<u2" if len(carried[d]) == 2 * rests[d] else "<u4")[a : a + n])
            rows.append((ids[d], totals[d] - rests[d] + a, n, own, totals[d], base + local + s, o))
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns)})

    return pack


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 1, tokenizer: str | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A row's ids are the tokenizer's without added tokens, then end_id; null and
    empty texts are end_id alone. Each id lies in exactly one piece. capacity
    must be a power of two. Repeated rows and ids are packed like any others; a
    null id stays null.
    """
    path = tokenizer or public_tokenizers.path(MODEL)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("carries", F.pmod(F.xxhash64(F.lit(7), "doc_id", F.length("text")), F.lit(2)) == 0)
    done = rows.mapInArrow(_tokenised(path, capacity, end_id), "doc_id long, doc_tokens long, full_crcs array<long>, rest int, rest_crc long, rest_ids binary")
    done = cut(done.withColumn("row", F.monotonically_increasing_id()))
    total = done.agg(F.sum("doc_tokens")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dealt = done.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("group").applyInArrow(_packed(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("doc_id", id_col)
