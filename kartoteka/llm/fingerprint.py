"""I-Match fingerprints over an inverse-document-frequency band.

The lexicon holds the terms whose share of documents lies in a band: neither
everywhere nor next to nowhere. Random subsets of it are fixed by seeds, each in
several densities, from a quarter of the lexicon to a four-thousandth. A fingerprint
holds, for every subset, a hash of the document's distinct sorted terms that lie
in it, 0 where there are none. A dense subset tells short texts apart, a sparse
one survives edits of long texts: likeness compares two fingerprints at the
sparsest density that still meets the texts often enough, and is the share of
equal hashes there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import as_long, mix64, parts_for, seeded, slices, text_bytes, word_hashes

#: Band of the share of documents that hold a term, and terms below which a document's own terms are used.
LOW, HIGH, FEWEST = 0.0005, 0.2, 3
#: Random subsets of each density; density d holds each term with probability 4 ** -(d + 1).
SUBSETS, DENSITIES = 64, 6
#: Subsets that must meet either of two texts before a density tells their likeness.
TELLING = 16
#: Terms of the largest lexicon that is sent to the workers, eight bytes each; a larger one is an error.
#: By its band a lexicon has at most (mean distinct terms of a document) / LOW terms, however many documents there are.
LEXICON = 4_000_000
#: Rows of a bucket of neighbouring documents and buckets at most; larger tables get larger buckets, which are streamed.
BUCKET_ROWS, BUCKETS = 20_000, 50_000
_SEEDS = seeded(51, 256)


def _distinct_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct terms (lower-case words, as hashes) and its first one."""
    words, first = word_hashes([t.lower() for t in texts])
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((words, doc))
    words, doc = words[order], doc[order]
    new = np.ones(len(words), dtype=bool)
    new[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
    words, doc = words[new], doc[new]
    return words, np.searchsorted(doc, np.arange(len(texts) + 1))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many rows each term occurs; counted per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
            terms, where = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
            return terms, np.bincount(where, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        held, size = [], 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in slices(texts):
                terms, n = np.unique(_distinct_terms(texts[a:b])[0], return_counts=True)
                held.append((terms, n))
                size += len(terms)
                if size > 3_000_000:
                    held = [merged(held)]
                    size = 0
                    if len(held[0][0]) > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(as_long(held[0][0])), pa.array(held[0][1])], ["term", "n"])
                        held = []
        if held:
            terms, n = merged(held)
            for a in range(0, len(terms), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(as_long(terms[a : a + 100_000])), pa.array(n[a : a + 100_000])], ["term", "n"])

    counted = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias("df"))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH, most: int = LEXICON) -> np.ndarray:
    """The sorted terms of the band. Its size is checked before any of it leaves the executors.

    The band is the same at every size of the table. More than `most` terms are
    an error, never a smaller lexicon; raise `most` or `low` on purpose then.
    """
    rows = docs.count()
    band = document_frequencies(docs, text_col).filter((F.col("df") >= low * rows) & (F.col("df") <= max(high * rows, 1))).select("term").persist()
    size = band.count()
    if size > most:
        band.unpersist()
        raise ValueError(f"the lexicon has {size} terms, more than the {most} that workers may hold: documents have over {int(most * low)} distinct terms on average")
    terms = band.toArrow().column(0).to_numpy()
    band.unpersist()
    return np.sort(terms.astype(np.int64).view(np.uint64))


def fingerprints(texts: list[bytes], terms: np.ndarray, subsets: int = SUBSETS, densities: int = DENSITIES) -> np.ndarray:
    """texts x subsets x densities: 12-bit hashes of each text's terms in each subset, 0 where it has none."""
    words, first = _distinct_terms(texts)
    at = np.searchsorted(terms, words)
    known = np.zeros(len(words), dtype=bool)
    inside = at < len(terms)
    known[inside] = terms[at[inside]] == words[inside]
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    enough = np.bincount(doc[known], minlength=len(texts)) >= FEWEST
    use = known | ~enough[doc]
    words, doc = words[use], doc[use]
    out = np.zeros((len(texts), subsets, densities), dtype=np.uint16)
    with np.errstate(over="ignore"):
        for k in range(subsets):
            place = mix64(words ^ _SEEDS[k])
            own, held = np.flatnonzero(place < np.uint64(1 << 62)), doc
            for d in range(densities):
                own = own[place[own] >> np.uint64(62 - 2 * d) == 0]
                if not len(own):
                    break
                held = doc[own]
                begin = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
                # terms are distinct and sorted; a sum of mixed hashes is that of their set
                total = mix64(np.add.reduceat(mix64(place[own] + _SEEDS[k + 128]), begin))
                out[held[begin], k, d] = 1 + (total >> np.uint64(40)) % np.uint64(4095)
    return out


_HEX = np.array([f"{i:03x}" for i in range(4096)], dtype="S3")


def as_text(row: np.ndarray) -> str:
    return _HEX[row.reshape(-1)].tobytes().decode()


def from_text(fingerprint: str, subsets: int = SUBSETS, densities: int = DENSITIES) -> np.ndarray:
    return np.array([int(fingerprint[i : i + 3], 16) for i in range(0, len(fingerprint), 3)], dtype=np.uint16).reshape(subsets, densities)


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: np.ndarray | None = None) -> DataFrame:
    """id and fingerprint (three hex digits per subset and density) of every row.

    Null and empty texts have the fingerprint of zeros; repeated rows and ids
    give repeated rows, a null id stays null, an empty table gives none. Texts
    are read whole, a slice of rows or one longer text at a time.
    """
    words = lexicon(docs, text_col) if terms is None else terms
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([as_text(r) for r in fingerprints(texts[a:b], held.value)], pa.string())], [id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} long, fingerprint string")


def likeness(a: np.ndarray, b: np.ndarray, telling: int = TELLING) -> np.ndarray:
    """Share of equal hashes of two rows of fingerprints, at the sparsest density where `telling` subsets meet either text.

    Two fingerprints without a term are alike.
    """
    met = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    density = np.maximum((met >= telling).sum(axis=1) - 1, 0)  # met falls from density to density
    row = np.arange(len(met))
    return np.where(met[row, density] > 0, same[row, density] / np.maximum(met[row, density], 1), 1.0)


def _bounds(rows: DataFrame, n: int) -> np.ndarray:
    """The least (place, h) of each of about n ranges of the rows, ascending: at most BUCKETS pairs of longs."""
    ranges = rows.select("place", "h").repartitionByRange(n, "place", "h").groupBy(F.spark_partition_id().alias("range"))
    least = ranges.agg(F.min(F.struct("place", "h")).alias("least")).select("least.place", "least.h").toArrow()
    pairs = np.stack([least.column(c).to_numpy() for c in (0, 1)], axis=1).astype(np.int64)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def _bucket_of(bounds: np.ndarray, place: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bucket, the last whose bound is not above it, and whether the row equals that bound."""
    low, high = (np.searchsorted(bounds[:, 0], place, side=s) for s in ("left", "right"))
    bucket = high - 1
    for u in np.unique(place[high > low]):  # places that several bounds may share are told apart by h
        own, a, b = np.flatnonzero(place == u), np.searchsorted(bounds[:, 0], u), np.searchsorted(bounds[:, 0], u, side="right")
        bucket[own] = a - 1 + np.searchsorted(bounds[a:b, 1], h[own], side="right")
    return bucket, (bounds[bucket, 0] == place) & (bounds[bucket, 1] == h)


def _with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows in buckets of neighbouring descending ids, each followed by the first row of the next bucket.

    Buckets are ranges of (id, text hash), so rows that share an id spread. The
    first row of a bucket is its bound and is dealt to the bucket before it too.
    """
    spark = docs.sparkSession
    place = -F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**62)))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), place.alias("place"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = min(parts_for(spark, rows.count(), BUCKET_ROWS), BUCKETS)
    found = _bounds(rows, n)
    if not len(found):
        return rows.withColumns({"bucket": F.lit(0), "guest": F.lit(False)})
    bounds, most = spark.sparkContext.broadcast(found), len(found)

    @F.pandas_udf("long")
    def placed(place: pd.Series, h: pd.Series) -> pd.Series:
        bucket, first = _bucket_of(bounds.value, place.to_numpy(), h.to_numpy())
        return pd.Series(2 * bucket + first)

    own = F.struct(F.floor(F.col("code") / 2).cast("int").alias("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(F.floor(F.col("code") / 2) - 1, F.lit(most)).cast("int").alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("code", placed("place", "h")).withColumn("to", F.explode(F.when(F.col("code") % 2 == 1, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("id", "text", "to.bucket", "to.guest", "place", "h").repartitionById(most, "bucket")
    return dealt.sortWithinPartitions("bucket", "guest", "place", "h", "text")


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many of the next row by descending id (nulls last, equal ids by
    text hash and text; after the last row the first one). Null texts are empty
    and like each other. Texts are read whole, a million code points or one
    longer text at a time. Every row gives one row, repeated ones too; an empty
    table gives none, other columns of any name are not looked at.
    """
    held = docs.sparkSession.sparkContext.broadcast(lexicon(docs, text_col))

    def finish(rows: list[tuple], following: tuple) -> pa.RecordBatch:
        texts = [r[1] for r in rows]
        nexts = [*texts[1:], following[1]]
        edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts)]
        own = fingerprints([t.encode() for t in (*texts, following[1])], held.value)
        other = fingerprints([t.encode() for t in edited], held.value)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([as_text(r) for r in own[:-1]], pa.string()),
                pa.array([as_text(r) for r in other], pa.string()),
                pa.array(likeness(own[:-1], other)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for i, t, bucket, guest in zip(*(batch.column(c).to_pylist() for c in range(4))):
                row = (i, t or "", bucket)
                if rows and (guest or rows[-1][2] != bucket or size > 1_000_000):
                    if guest or rows[-1][2] == bucket:
                        yield finish(rows, row)
                    rows, size = [], 0
                if not guest:
                    rows.append(row)
                    size += len(row[1])

    schema = f"{id_col} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, id_col, text_col).select("id", "text", "bucket", "guest").mapInArrow(run, schema)
