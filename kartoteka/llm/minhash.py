"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

One permutation scatters the shingles over 2**32 places, a second one, shifted
circularly by 0, 1, 2, ..., gives every coordinate of the signature. Documents
with equal shingle sets are one node. Nodes that share a band of the signature
are joined into candidate clusters; inside a cluster the pairs that share a band
and are not yet known to be connected are compared on their full sets. A cluster
of several blocks is compared block by block, each pair of blocks a task of its
own, so no task holds more than two blocks. Where that would copy a set more
often than it has bands, as in clusters that chance bands have chained together,
the cluster falls apart into its bands, and these are compared instead: the same
pairs, but work that follows how many sets share a band, not the cluster's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import as_long, cut, discard, distinct_sorted, forget_others, is_empty, mix64, new_path, seeded, shingle_hashes, slices, text_bytes, word_hashes, written
from kartoteka.llm.components import Forest, connected_components

#: Rows to a band and bands: a pair at similarity 0.85 shares no band with probability 2e-7.
ROWS, BANDS = 8, 48
#: Shingles that a block of a candidate cluster may hold, and the shift between coordinates.
BLOCK_SHINGLES, SHIFT = 500_000, 1
_A, _B, _C = (np.uint32(x) for x in (0x7FEB352D, 0x846CA68B, 0x9E3779B1))


def signatures(values: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """coordinates x sets: least place of each set under the circularly shifted second permutation."""
    out = np.empty((coordinates, len(at) - 1), dtype=np.uint32)
    with np.errstate(over="ignore"):
        place = (values >> np.uint64(32)).astype(np.uint32) * _C
        for k in range(coordinates):
            y = place + np.uint32((k * SHIFT * int(_C)) & 0xFFFFFFFF)
            y ^= y >> np.uint32(16)
            y *= _A
            y ^= y >> np.uint32(15)
            y *= _B
            out[k] = np.minimum.reduceat(y, at[:-1])
    return out


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """sets x bands: a 64-bit key of each band (its number included)."""
    coordinates, n = sig.shape
    step = seeded(21, rows) | np.uint64(1)
    keys = np.empty((n, coordinates // rows), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b in range(coordinates // rows):
            total = np.full(n, np.uint64(b + 1) * step[0])
            for j in range(rows):
                total = mix64(total + sig[b * rows + j].astype(np.uint64) * step[j])
            keys[:, b] = total
    return keys


def _packed(x: np.ndarray) -> bytes:
    """The upper 48 bits of each value, six bytes each."""
    return (x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view(np.uint64)


def sketched(docs: DataFrame, id_col: str, text_col: str, k: int, rows: int, bands: int) -> DataFrame:
    """id, n_shingles, node (hash of the whole set), bands and the packed set of every row."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        for batch in batches:
            texts = [t.lower() for t in text_bytes(batch.column(1))]
            for start, stop in slices(texts, 400_000):
                words, first = word_hashes(texts[start:stop])
                sets = distinct_sorted(*shingle_hashes(words, first, k))
                sizes = np.array([len(x) for x in sets])
                node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], dtype=np.uint64)
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                full = np.flatnonzero(sizes)
                if len(full):
                    at = np.concatenate([[0], np.cumsum(sizes[full])])
                    keys[full] = _bands(signatures(np.concatenate([sets[i] for i in full]), at, rows * bands), rows)
                offsets = np.arange(0, len(sets) * bands + 1, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(sizes, pa.int64()),
                        pa.array(as_long(node)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(as_long(keys.reshape(-1)))),
                        pa.array([_packed(x) for x in sets], pa.binary()),
                    ],
                    ["id", "n_shingles", "node", "bands", "shingles"],
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(sketch, "id long, n_shingles long, node long, bands array<long>, shingles binary")


def _links(sets: list[np.ndarray], bands: np.ndarray, left: int, percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect the sets with 100 * intersection >= percent * union, fewest that do.

    left: 0 compares all sets with each other, else the first `left` with the
    others. Only pairs that share a band are compared; those already connected
    are passed over.
    """
    sizes = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    forest = Forest(len(sets))
    for i in range(left or len(sets)):
        lo = left or i + 1
        if lo >= len(sets):
            break
        fits = (100 * np.minimum(sizes[lo:], sizes[i]) >= percent * np.maximum(sizes[lo:], sizes[i])) & (forest.roots()[lo:] != forest.find(i))
        near = np.flatnonzero(fits) + lo
        near = near[(bands[near] == bands[i]).any(axis=1)]
        if not len(near):
            continue
        own = sizes[near]
        mark[ids[at[i] : at[i + 1]]] = 1
        if 4 * len(near) > len(sets) - lo:  # reading all sets in a row is faster than picking many of them
            both = np.add.reduceat(mark[ids[at[lo] :]], at[lo:-1] - at[lo])[near - lo]
        else:
            place = np.repeat(at[near] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            both = np.add.reduceat(mark[ids[place]], np.cumsum(own) - own)
        mark[ids[at[i] : at[i + 1]]] = 0
        for j in near[100 * both >= percent * (sizes[i] + own - both)].tolist():
            if forest.join(i, j):
                yield i, j


def _compare(percent: int):
    def compare(key: tuple, batch: pa.Table) -> pa.Table:
        nodes, side = batch.column("node").to_numpy(), batch.column("block").to_numpy()
        low, high = key[1].as_py(), key[2].as_py()
        order = np.lexsort((nodes, side))
        left = 0 if low == high else int((side == low).sum())
        found: list[tuple[int, int]] = []
        if len(order) > 1 and (low == high or 0 < left < len(order)):
            packed = batch.column("shingles").to_pylist()
            bands = batch.column("bands").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            found = list(_links([_unpacked(packed[i]) for i in order], bands[order], left, percent))
        pick = nodes[order]
        return pa.table({"a": pa.array([pick[i] for i, _ in found], pa.int64()), "b": pa.array([pick[j] for _, j in found], pa.int64())})

    return compare


def _in_blocks(sets: DataFrame, weights: DataFrame) -> DataFrame:
    """sets (component, node, shingles, bands) dealt to each pair of blocks of their component (low <= high)."""
    dealt = sets.join(weights, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "shingles", "bands")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, k: int = 5, rows: int = ROWS, bands: int = BANDS, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept.

    Links hold between documents whose k-word shingle sets have 100 *
    intersection >= percent * union, confirmed on the full sets (48 bits of
    each shingle's hash). component_id is the smallest id reachable by links,
    kept whether it is the row's own. Null and empty texts, and those without a
    word, have n_shingles 0 and are linked with nothing; long texts are read
    whole, an empty table gives an empty result. A null id stays null,
    is never a component's id, and is kept only where its component has no
    other id. Repeated rows keep their number; copies with one id are all kept.
    """
    spark = docs.sparkSession
    path = new_path(spark)
    sketches = written(sketched(docs, id_col, text_col, k, rows, bands), path)
    all_rows = cut(sketches.select("id", "n_shingles", "node"))
    filled = sketches.filter("n_shingles > 0")
    nodes = all_rows.filter("n_shingles > 0").groupBy("node").agg(F.min("id").alias("least"))
    keys = filled.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("band"))
    leaders = keys.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    near = keys.join(leaders, "band").filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    clusters = cut(connected_components(near))
    chosen = nodes.select(F.col("node").alias("c_node"), "least").join(clusters.withColumnRenamed("node", "c_node"), "c_node")
    one_row = (F.col("node") == F.col("c_node")) & F.col("id").eqNullSafe(F.col("least"))  # copies differ in id, so they spread
    short = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("bands")  # half of each key tells bands apart well enough: more pairs, not fewer
    sets = filled.select("id", "node", "shingles", "n_shingles", short).join(chosen, one_row).groupBy("node", "component")
    sets = cut(sets.agg(F.first("shingles").alias("shingles"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")))
    discard(spark, path)  # only all_rows and the candidates' sets are read from here on
    blocks_of = lambda df: df.groupBy("component").agg(F.ceil(F.sum("size") / F.lit(block_shingles)).cast("int").alias("blocks"), F.count("*").alias("n"))
    weights = blocks_of(sets)
    pairs = _in_blocks(sets, weights.filter(F.col("blocks") <= bands).drop("n"))
    chained = sets.join(weights.filter(F.col("blocks") > bands).select("component"), "component", "left_semi")
    if not is_empty(chained):
        banded = chained.select(F.explode(F.transform("bands", lambda b: b.cast("long"))).alias("component"), "node", "shingles", "size", "bands")
        pairs = pairs.unionByName(_in_blocks(banded, blocks_of(banded).filter("n > 1").drop("n")))
    links = pairs.groupBy("component", "low", "high").applyInArrow(_compare(percent), "a long, b long")
    classes = connected_components(links)
    least = nodes.select("node", "least").join(classes, "node", "left").select("node", "least", F.coalesce("component", "node").alias("class"))
    least = least.join(least.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("node", "component_id")
    joined = all_rows.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(least, "node", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
