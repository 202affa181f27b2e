"""Removal of long repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are split into groups by most-significant-digit passes and never beyond
the threshold, so the groups that are left are exactly the repeated windows.

1. The first pass is over a sample of the suffixes, since all of them would
   shuffle several times the input: those that start at the q-gram of least hash
   of some window. Equal windows hold the same one at the same place, so no
   repeat is missed. The digit is the q-gram, the suffix's leading bytes. The
   windows that share it are neighbours; such a run of windows is one record. A
   digit that occurs once ends its run: none of its windows is repeated.
2. The digit is the whole content of the run. Runs that occur twice or more are
   repeated in full, however many copies there are; only counts are shuffled.
3. What is left, runs that share a q-gram but differ elsewhere, is sorted as
   suffixes: window by window, eight leading bytes after eight, groups split at
   each pass, suffixes alone in their group set aside, up to `length` bytes.
   A q-gram with very many different runs goes through a grouped count of
   windows, so no task gathers it.

The units are bytes, or words: then a text is the string of its words' 64-bit
hashes, `width` is 8, and places and lengths count words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import SPACE, cut, forget_others, is_empty, mix64, parts_for, powers, remembered, seeded, slices, text_bytes, word_hashes

#: Bytes of the first digit, and different runs of one digit that a task compares at most.
GRAM, RUNS_IN_TASK = 40, 5_000
#: Runs with more than this part of all records are counted as hot; so there are at most as many.
HOT_RUNS = 1_000
#: Where words are the units: words of the first digit, and bytes of a unit (a word's hash).
WORD_GRAM, WORD_WIDTH = 8, 8
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_VALUES = (seeded(31, 256), seeded(32, 256))
_POWERS: dict = remembered("suffix")
_HALF, _PLACE = np.uint64(32), np.uint64(0xFFFFFFFF)


def _packed_words(texts: list[bytes]) -> list[bytes]:
    """The hashes of each text's words, eight bytes each."""
    words, first = word_hashes(texts)
    return [words[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]


def _units(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(texts), dtype=np.uint8 if width == 1 else np.uint64)


def _values(data: np.ndarray, which: int) -> np.ndarray:
    return _VALUES[which][data] if data.dtype == np.uint8 else mix64(data + _VALUES[which][0])


def _rolling(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the units' polynomial, and the powers that move a difference to place 0."""
    base = _BASES[which]
    if len(_POWERS.get(which, ((),))[0]) < len(data) + 1:
        n = max(len(data) + 1, 1 << 19)
        _POWERS[which] = (powers(base, n), powers(pow(base, -1, 1 << 64), n))
    up, down = _POWERS[which]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_values(data, which) * up[: len(data)], out=sums[1:])
    return sums, down


def _window_hash(rolled: tuple[np.ndarray, np.ndarray], at: np.ndarray, length: int) -> np.ndarray:
    sums, down = rolled
    h = (sums[at + length] - sums[at]) * down[at]
    return h ^ (h >> np.uint64(29))


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by block-wise running minima from both sides."""
    n = len(grams)
    rows = -(-n // w)
    padded = np.full(rows * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = grams
    ahead = np.minimum.accumulate(padded.reshape(rows, w), axis=1).reshape(-1)
    back = np.minimum.accumulate(padded.reshape(rows, w)[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(texts: list[bytes], length: int, gram: int = GRAM, width: int = 1) -> tuple[np.ndarray, ...]:
    """(text, start, stop, digit): runs [start, stop] of window starts that share their least q-gram."""
    gram = min(gram, length)
    long = [i for i, t in enumerate(texts) if len(t) >= length * width]
    if not long:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    data = _units([texts[i] for i in long], width)
    sizes = np.array([len(texts[i]) // width for i in long])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    with np.errstate(over="ignore"):
        hashes = _window_hash(_rolling(data, 0), np.arange(len(data) - gram + 1), gram)
        spread = hashes * np.uint64(0x94D049BB133111EB)
    # the same 32 bits of the hash, then the place, in every slice: ties fall alike wherever a window stands
    least = _least((spread >> _HALF << _HALF) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    where = (least & _PLACE).astype(np.int64)
    valid = np.zeros(len(where) + 1, dtype=bool)
    for b, e in zip(begins, ends):
        valid[b : e - length + 1] = True
    valid[-1] = False
    change = np.ones(len(where), dtype=bool)
    change[1:] = where[1:] != where[:-1]
    change[begins[begins < len(change)]] = True
    first = np.flatnonzero(valid[:-1] & change)
    stop = valid[:-1] & (~valid[1:] | np.append(change[1:], True))
    last = np.flatnonzero(stop)
    doc = np.searchsorted(ends, first, side="right")
    return np.array(long)[doc], first - begins[doc], last - begins[doc], hashes[where[first]]


def _keyed(docs: DataFrame, id_col: str, text_col: str, others: list[str]) -> DataFrame:
    """Rows that agree in key and text hash have the same text and so the same spans. row: the other columns."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("key"), F.xxhash64(text).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text.alias("text")
    )


def _found_runs(length: int, width: int):
    """Runs of every text; place is start * length + (stop - start). A run's digit and content hash, 128 bits, tell it."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("suffix")
        for batch in batches:
            texts = text_bytes(batch.column(2))
            for a, b in slices(texts):
                part = texts[a:b] if width == 1 else _packed_words(texts[a:b])
                doc, start, stop, digit = runs(part, length, GRAM if width == 1 else WORD_GRAM, width)
                one = np.array([xxhash.xxh3_64_intdigest(part[d][s * width : (e + length) * width]) for d, s, e in zip(doc.tolist(), start.tolist(), stop.tolist())], dtype=np.uint64)
                pick = pa.array(doc + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(start * length + stop - start, pa.int64()), pa.array(digit.view(np.int64)), pa.array(one.view(np.int64))],
                    ["key", "text_hash", "place", "digit", "one"],
                )

    return find


def _contents(length: int, width: int):
    """The units of the runs that are asked for, from texts joined with lists of runs."""

    def emit(picked: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*picked))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "text_hash", "start", "digit", "sure", "content"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            picked, size = [], 0
            for i, (text, rows) in enumerate(zip(text_bytes(batch.column(3)), batch.column(4).to_pylist())):
                text = text if width == 1 else _packed_words([text])[0]
                for r in rows:
                    picked.append((keys[i], hashes[i], r["start"], r["digit"], r["sure"], text[r["start"] * width : (r["stop"] + length) * width]))
                    size += len(picked[-1][-1])
                if size > 4_000_000:
                    yield emit(picked)
                    picked, size = [], 0
            if picked:
                yield emit(picked)

    return read


def _places(contents: list[bytes], length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The units of all contents in a row, and (content, place in it, place in the row) of every window."""
    data = _units(contents, width)
    sizes = np.array([len(c) // width for c in contents])
    counts = sizes - length + 1
    row = np.repeat(np.arange(len(contents)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, row, place, np.repeat(np.cumsum(sizes) - sizes, counts) + place


def _windows(contents: list[bytes], length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, two hashes) of every window of the contents."""
    data, row, place, at = _places(contents, length, width)
    with np.errstate(over="ignore"):
        one, two = (_window_hash(_rolling(data, i), at, length) for i in (0, 1))
    return row, place, one, two


def _digits(data: np.ndarray, length: int) -> tuple[np.ndarray, list[int]]:
    """The digit that starts at each place (eight bytes, the first most significant, or a unit), and the depths to read one at."""
    if data.dtype != np.uint8:
        return data, list(range(length))
    eight = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(7, np.uint8)), 8)
    words = np.ascontiguousarray(eight).view(">u8")[:, 0].astype(np.uint64)
    if length < 8:
        return words >> np.uint64(8 * (8 - length)), [0]
    return words, [*range(0, length - 8, 8), length - 8]


def repeated_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows at places `at` equal another one, by most-significant-digit passes.

    `order` holds the windows still in question, each group in one piece. In a
    pass the windows with the digit of their group's middle one stay together in
    front, the others are sorted behind them, and windows left alone are dropped.
    """
    words, depths = _digits(data, length)
    again = np.zeros(len(at), dtype=bool)
    if len(at) < 2:
        return again
    rank = np.unique(words, return_inverse=True)[1]  # digits as small numbers in the same order
    bits = int(rank.max()).bit_length()
    order, begin = np.arange(len(at)), np.zeros(1, np.int64)
    for depth in depths:
        if not len(order):
            break
        digit = rank[at[order] + depth]
        sizes = np.diff(np.append(begin, len(order)))
        same = digit == np.repeat(digit[begin + sizes // 2], sizes)
        rest = np.flatnonzero(~same)
        if not len(rest):
            continue
        first = np.repeat(begin, sizes)  # of each window's group
        sort = rest[np.argsort(first[rest] << bits | digit[rest])]
        front = np.cumsum(same)
        front_of = lambda i: np.where(i > 0, front[i - 1], 0)
        ahead = front_of(begin)
        in_front = np.add.reduceat(same.astype(np.int64), begin)
        place = np.empty(len(order), dtype=np.int64)
        kept = np.flatnonzero(same)
        group = np.repeat(np.arange(len(begin)), sizes)
        place[kept] = first[kept] + front[kept] - 1 - ahead[group[kept]]
        g = group[sort]
        place[sort] = begin[g] + in_front[g] + np.arange(len(sort)) - (begin - ahead)[g]
        moved = np.empty_like(order)
        moved[place] = order
        new = np.zeros(len(order), dtype=bool)
        new[begin] = True
        new[place[sort]] = np.append(True, (g[1:] != g[:-1]) | (digit[sort[1:]] != digit[sort[:-1]]))
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(order)))
        shared = np.repeat(sizes > 1, sizes)
        order, begin = moved[shared], np.flatnonzero(new[shared])
    again[order] = True
    return again


def _spans(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring places within a row: (row, first, last)."""
    if not len(row):
        return row, place, place
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    return row[new], place[new], place[np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1)]


def _compared(length: int, width: int, most: int = 1_000_000):
    """Repeated windows among runs sorted by digit; whole digits are gathered up to `most` bytes."""

    def judge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        data, row, place, at = _places(t.column("content").to_pylist(), length, width)
        again = repeated_windows(data, at, length)
        again &= ~t.column("sure").to_numpy()[row]
        r, first, last = _spans(row[again], place[again])
        pick, start = pa.array(r), t.column("start").to_numpy()[r]
        one_chunk = t.select(["key", "text_hash"]).take(pick).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [*(pa.array(one_chunk.column(c).to_numpy(), pa.int64()) for c in range(2)), pa.array(start + first, pa.int64()), pa.array(start + last + length, pa.int64())],
            ["key", "text_hash", "from", "to"],
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            digits = batch.column(3).to_numpy()
            if size > most:
                cutting = int(np.argmax(digits != last)) if (digits != last).any() else None
                if cutting is not None:
                    yield judge([*held, batch.slice(0, cutting)])
                    held, size, batch = [], 0, batch.slice(cutting)
            held.append(batch)
            size += batch.nbytes
            last = digits[-1]
        if held:
            yield judge(held)

    return compare


def _window_rows(length: int, width: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, place, one, two = _windows(batch.column(5).to_pylist(), length, width)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(batch.column(2).to_numpy()[row] + place, pa.int64()), batch.column(4).take(pick), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))],
                    ["key", "text_hash", "from", "sure", "one", "two"],
                )

    return explode


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, runs_in_task: int = RUNS_IN_TASK) -> DataFrame:
    """(key, text_hash, from, to): bytes of texts covered by strings of `length` bytes that start elsewhere too.

    Spans of a text may overlap or repeat; their union is what is covered.
    """
    return _spans_of(_keyed(docs, id_col, text_col, [id_col]), length, runs_in_task)


def _spans_of(keyed: DataFrame, length: int, runs_in_task: int, width: int = 1) -> DataFrame:
    spark = keyed.sparkSession
    found = cut(keyed.select("key", "text_hash", "text").mapInArrow(_found_runs(length, width), "key long, text_hash long, place long, digit long, one long"))
    run = ["digit", "one"]
    counts = found.groupBy(*run).agg(F.count("*").alias("n"), F.min(F.struct("key", "text_hash", "place")).alias("sample"))
    digits = counts.groupBy("digit").agg(F.count("*").alias("different"), F.sum("n").alias("total")).filter("total > 1")
    counts = cut(counts.join(digits, "digit"))
    # at most HOT_RUNS runs have more than a HOT_RUNS-th of all records: their counts go to every task, the records stay where they are
    hot = F.broadcast(counts.filter(F.col("n") > F.lit(found.count() / HOT_RUNS)))
    known = found.join(hot, run).unionByName(found.join(hot, run, "left_anti").join(counts, run))
    known = known.withColumn("start", F.floor(F.col("place") / length)).withColumn("stop", F.col("start") + F.col("place") % length)
    spans = known.filter("n > 1").select("key", "text_hash", F.col("start").alias("from"), (F.col("stop") + length).alias("to"))
    sampled = F.struct("key", "text_hash", "place") == F.col("sample")
    open_runs = cut(known.filter((F.col("different") > 1) & ((F.col("n") == 1) | sampled)).select("key", "text_hash", "start", "stop", "digit", (F.col("n") > 1).alias("sure"), (F.col("different") > runs_in_task).alias("crowded")))

    def contents(asked: DataFrame) -> DataFrame:
        lists = asked.groupBy("key", "text_hash").agg(F.collect_set(F.struct("start", "stop", "digit", "sure")).alias("asked"))
        # all columns of keyed: then this shuffle of the texts also serves the join with the spans
        joined = keyed.join(lists.hint("shuffle_hash"), ["key", "text_hash"]).select("key", "text_hash", "row", "text", "asked")
        return joined.mapInArrow(_contents(length, width), "key long, text_hash long, start long, digit long, sure boolean, content binary")

    few = contents(open_runs.filter("not crowded"))
    n = parts_for(spark, open_runs.count(), 50_000)
    span = "key long, text_hash long, from long, to long"
    spans = spans.unionByName(few.repartition(n, "digit").sortWithinPartitions("digit").mapInArrow(_compared(length, width), span))
    crowded = open_runs.filter("crowded")
    if not is_empty(crowded):
        windows = contents(crowded).mapInArrow(_window_rows(length, width), "key long, text_hash long, from long, sure boolean, one long, two long")
        again = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
        spans = spans.unionByName(windows.filter("not sure").join(again, ["one", "two"]).select("key", "text_hash", "from", (F.col("from") + length).alias("to")))
    return spans


def _covered(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [tuple(x) for x in out]


def _joined(docs: DataFrame, id_col: str, text_col: str, others: list[str], length: int, runs_in_task: int, width: int = 1) -> DataFrame:
    """row, text, spans of every row of docs."""
    keyed = _keyed(docs, id_col, text_col, others)
    spans = _spans_of(keyed, length, runs_in_task, width)
    lists = spans.groupBy("key", "text_hash").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    return keyed.join(lists.hint("shuffle_hash"), ["key", "text_hash"], "left").select("row", "text", "spans")


def _bytes_of_words(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of bytes, from the first byte of the first word to the last of the last."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[np.frombuffer(text, dtype=np.uint8)], [True]]).astype(np.int8)))
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, runs_in_task: int = RUNS_IN_TASK, words: bool = False, spans_col: str = "removed_spans") -> DataFrame:
    """docs with repeated strings cut out of text_col, and an array<struct<from, to>> (bytes) `spans_col`.

    Every byte covered by a `length`-byte string of the UTF-8 text that also
    starts anywhere else, in the same or another row, is removed; matches never
    cross rows and are judged on the input. A code point whose bytes are cut
    apart is dropped from the text. Null texts stay null, with no spans; an
    empty table gives an empty one. Repeated rows and rows of one or no id are
    rows like others and repeat each other's strings. Texts are read whole; one
    text must fit a worker's memory a few times over. Other columns pass
    unchanged, whatever their names; a column named as `spans_col` is replaced.
    words: length counts words (`[^\\x20\\x09-\\x0D]+`), whatever white space is
    between them; spans are in bytes still.
    """
    names = docs.columns
    joined = _joined(docs, id_col, text_col, [c for c in names if c != text_col], length, runs_in_task, WORD_WIDTH if words else 1)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out, gone = [], []
            for t, s in zip(texts, lists):
                cutting = _covered(s)
                if words and cutting:
                    cutting = _bytes_of_words(t.encode(), cutting)
                gone.append([{"from": a, "to": b} for a, b in cutting])
                if t is not None and cutting:
                    t = b"".join(_kept(t.encode(), cutting)).decode("utf-8", "ignore")
                out.append(t)
            spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(gone, spans_type)], ["row", "text", "removed_spans"])

    row_type = joined.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(strip, f"row {row_type}, text string, removed_spans array<struct<from:bigint,to:bigint>>")
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names if c != spans_col], F.col("removed_spans").alias(spans_col))


def _kept(text: bytes, cutting: list[tuple[int, int]]) -> Iterator[bytes]:
    at = 0
    for a, b in cutting:
        yield text[at:a]
        at = b
    yield text[at:]


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, runs_in_task: int = RUNS_IN_TASK) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that remain (null text: empty).

    Every row gives one row, those of null and repeated ids too; see remove_repeats.
    """
    joined = _joined(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col, [id_col], length, runs_in_task)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = text_bytes(batch.column(1)), [_covered(s) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).field(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(b - a for a, b in s) for s in lists], pa.int64()),
                    pa.array([len(s) for s in lists], pa.int64()),
                    pa.array([hashlib.sha256(b"".join(_kept(t, s))).hexdigest() for t, s in zip(texts, lists)], pa.string()),
                ],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(report, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
