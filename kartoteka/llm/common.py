"""Shared helpers: table access, lineage cuts, checked sizes and vectorised hashing.

The numpy helpers work on one bounded slice of rows at a time, so a task's
memory follows the slice and the longest single text, never the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
SLICE_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches of long texts small, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Where none is set, it is a
    temporary folder on a single machine and one in the warehouse elsewhere.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        own = tempfile.mkdtemp(prefix="kartoteka-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir')}/_kartoteka"
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or own)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table of written() that nothing reads any more, and frees finished shuffles.

    Spark's cleaner removes shuffle files once the driver's garbage is
    collected; on a long job this need not happen by itself. It removes the
    files of cut() too where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set; else they stay until the shared folder is cleared.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    release(spark)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that Spark's cleaner removes what no DataFrame refers to."""
    gc.collect()
    spark._jvm.System.gc()


#: What operators remember in a worker from task to task, by operator.
_REMEMBERED: dict[str, dict] = {}


def remembered(operator: str) -> dict:
    """A worker's memory of one operator: what it puts there stays for its next task, until another operator's task clears it."""
    return _REMEMBERED.setdefault(operator, {})


def forget_others(operator: str = "") -> None:
    """Called where a task begins: drops what other operators remember, so that workers hold one operator's memory at a time."""
    held = [m for name, m in _REMEMBERED.items() if name != operator and m]
    for m in held:
        m.clear()
    if held:
        gc.collect()
        give_back()


def give_back() -> None:
    """Returns freed memory to the system, for a worker that may stand idle after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # the C library may not offer it; then freed memory goes back later
        ctypes.CDLL(None).malloc_trim(0)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def parts_for(spark: SparkSession, rows: int, rows_per_part: int) -> int:
    """Partitions for a keyed shuffle: by rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / rows_per_part))


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a slice of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = seeded(11, 256)
_WORD[SPACE] = 0
_PLACE = {"powers": powers(0x9E3779B97F4A7C15 | 1, 1024)}


def hashed_words(data: np.ndarray, starts: np.ndarray, segments: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at starts; a segment is a word and the white space up to the next."""
    longest = int(segments.max())
    if longest > len(_PLACE["powers"]):
        _PLACE["powers"] = powers(0x9E3779B97F4A7C15 | 1, 2 * longest)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, segments)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_WORD[data[starts[0] :]] * _PLACE["powers"][place], starts - starts[0])
        return mix64(sums + lengths.astype(np.uint64) * M2)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, and each text's first word.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    in_word = ~SPACE[data]
    before = np.empty_like(in_word)
    before[0] = False
    before[1:] = in_word[:-1]
    starts = np.flatnonzero(in_word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    stops = np.flatnonzero(before & ~in_word)
    sizes = np.diff(np.append(starts, len(data)))
    words = hashed_words(data, starts, sizes, stops - starts)
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    return words, first.astype(np.int64)


_STEP = seeded(12, 16) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and each text's first shingle.

    A text of fewer than k words has its whole sequence as its one shingle; a
    text without words has none.
    """
    n = np.diff(first)
    with np.errstate(over="ignore"):
        total = len(words)
        rolled = np.zeros(max(total - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            rolled += words[j : total - k + 1 + j] * _STEP[j] if total >= k else rolled
        rolled = mix64(rolled)
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        out = np.empty(int(counts.sum()), dtype=np.uint64)
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        full = np.flatnonzero(n >= k)
        if len(full):
            sizes = counts[full]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            out[np.repeat(at[full], sizes) + inside] = rolled[np.repeat(first[full], sizes) + inside]
        for d in np.flatnonzero((n > 0) & (n < k)):
            w = words[first[d] : first[d + 1]]
            out[at[d]] = mix64(np.array([(w * _STEP[: len(w)]).sum() + np.uint64(len(w)) * M1], dtype=np.uint64))[0]
    return out, at


def distinct_sorted(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct values, ascending."""
    return [np.unique(values[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def row_id(*columns: str):
    """A long that is equal for equal values of the columns (nulls included)."""
    return F.xxhash64(*[F.struct(c) for c in columns])
