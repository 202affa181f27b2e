"""k-means of integer vectors: Lloyd's rounds, exact, with Drake's adaptive bounds.

A vector remembers, from round to round, its nearest centroids with a bound on
the distance to each (an upper one to the first, which it is assigned to, lower
ones to the others) and one lower bound, the remainder, for all other centroids.
When centroids have moved, bounds give way by as much. If the upper bound stays
under all others, the assignment stands without a distance. Else distances are
computed to as many of the remembered centroids as can be nearer, and where even
the remainder cannot be excluded, to all. Bounds only decide what is computed:
what they cannot certify with a margin for rounding is compared in exact
integers, ties going to the smaller number. The count of remembered centroids
starts at half of all and shrinks to what the last round made use of.

Vectors lie in blocks, written once into buckets; what they remember is a second,
small table of the same buckets, written anew each round. So a round reads both
side by side, without a shuffle, and a lost task is read again from the shared
folder. A round's sums are added up in the blocks, then by Spark; the driver
sees clusters times components numbers.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import discard, forget_others, new_path, parts_for, written

#: Vectors in a block, and blocks in a bucket on average.
BLOCK, BLOCKS_IN_BUCKET = 4096, 64
#: Components must be smaller, so that squared distances of 64 components fit a long.
LARGEST = 1 << 27
#: Up to this size, sums of products of floats are exact.
_FLOAT_EXACT = 1 << 22
#: Share of an upper bound by which it must lie under a lower one.
_MARGIN = 1e-9

_BLOCKS = "block long, ids array<long>, x binary"
_STATE = "block long, near binary, bounds binary, totals array<long>"
_LAST = "block long, cluster array<int>, distance array<long>, totals array<long>"
_LONGS = pa.list_(pa.int64())
_ARROW = {
    _STATE: pa.schema([("block", pa.int64()), ("near", pa.binary()), ("bounds", pa.binary()), ("totals", _LONGS)]),
    _LAST: pa.schema([("block", pa.int64()), ("cluster", pa.list_(pa.int32())), ("distance", _LONGS), ("totals", _LONGS)]),
}


def integer_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): the vectors of `dims` finite components, each floor(scale * component) as a long."""
    v = F.col(f"`{vector_col}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter((F.size(v) == dims) & finite)
    return kept.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash lowest; null ids after all others, ties by components."""
    order = [F.col("id").isNull(), F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "x"]
    return [list(r.x) for r in vectors.orderBy(*order).limit(clusters).collect()]


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("clustering")
        task, made, ids, parts = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            x = np.concatenate(parts).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), pa.array([list(ids)], _LONGS), pa.array([x.tobytes()], pa.binary())], ["block", "ids", "x"])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if len(x) and max(x.max(), -x.min()) >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more: distances would exceed a long")
            for start in range(0, len(x), size):
                ids += batch.column(0)[start : start + size].to_pylist()
                parts.append(x[start : start + size])
                if len(ids) >= size:
                    yield block()
                    made, ids, parts = made + 1, [], []
        if ids:
            yield block()

    return run


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < _FLOAT_EXACT:
        x, c = x.astype(float), c.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _ranked(d: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and centroids of each row by distance, then number."""
    order = np.lexsort((ids, d), axis=1)
    return np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def scan(x: np.ndarray, c: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The `kept` nearest centroids of each row, and their distances with that to the nearest of the others."""
    k = len(c)
    d, ids = _ranked(squares(x, c), np.broadcast_to(np.arange(k), (len(x), k)))
    bounds = np.full((len(x), kept + 1), np.inf)
    bounds[:, : min(kept + 1, k)] = np.sqrt(d[:, : kept + 1])
    return ids[:, :kept].astype(np.int32), bounds


def reassign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, near: np.ndarray, bounds: np.ndarray, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """near and bounds after centroids have moved to c, cut to `kept`; and how many remembered centroids each row had to look at (kept + 1: all there are)."""
    if near.shape[1] > kept:
        bounds = np.column_stack([bounds[:, :kept], bounds[:, kept:].min(1)])
        near = near[:, :kept].copy()
    bounds[:, :kept] -= moved[near]
    bounds[:, 0] += 2 * moved[near[:, 0]]
    bounds[:, kept] -= moved.max()
    above = np.minimum.accumulate(bounds[:, :0:-1], axis=1)[:, ::-1]  # least bound of the second and later, third and later, ..., of the rest
    certain = bounds[:, :1] * (1 + _MARGIN) + _MARGIN < above
    need = np.where(certain.any(1), certain.argmax(1) + 1, kept + 1)
    for j in range(2, kept + 1):
        rows = np.flatnonzero(need == j)
        if len(rows):
            to = near[rows, :j]
            d, to = _ranked(((x[rows, None, :].astype(np.int64) - c[to]) ** 2).sum(2), to)
            near[rows, :j], bounds[rows, :j] = to, np.sqrt(d)
    rows = np.flatnonzero(need > kept)
    if len(rows):
        near[rows], bounds[rows] = scan(x[rows], c, kept)
    return near, bounds, need


def _pass(centroids: np.ndarray, moved: np.ndarray | None, kept: int, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assigns the vectors of each block; gives what they remember, or at last their clusters and distances."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["x"], np.int32).reshape(-1, dims).astype(np.int64)
                if moved is None:
                    (near, bounds), need = scan(x, centroids, kept), np.full(len(x), kept)
                else:
                    near = np.frombuffer(row["near"], np.int32).reshape(len(x), -1).copy()
                    near, bounds, need = reassign(x, centroids, moved, near, np.frombuffer(row["bounds"]).reshape(len(x), -1).copy(), kept)
                mine = near[:, 0]
                if last:
                    d = ((x - centroids[mine]) ** 2).sum(1)
                    totals = np.zeros(k, np.int64)
                    np.add.at(totals, mine, d)
                    out = {"block": row["block"], "cluster": mine.tolist(), "distance": d.tolist(), "totals": totals.tolist()}
                else:
                    totals = np.zeros((k, dims + 1), np.int64)
                    np.add.at(totals, mine, np.column_stack([np.ones(len(x), np.int64), x]))
                    looked = np.bincount(need, minlength=kept + 2)
                    out = {"block": row["block"], "near": near.tobytes(), "bounds": bounds.tobytes(), "totals": np.append(totals, looked).tolist()}
                yield pa.RecordBatch.from_pylist([out], _ARROW[_LAST if last else _STATE])

    return run


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """df in buckets by block, in the shared folder, and its path; the catalog keeps no name of it."""
    spark, path, name = df.sparkSession, new_path(df.sparkSession), f"blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return kept, path


def _added(state: DataFrame) -> list[int]:
    """The blocks' totals, added up place by place."""
    placed = state.select(F.posexplode("totals")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
    return [int(r.total) for r in placed.orderBy("pos").collect()]


def cluster_vectors(vectors: DataFrame, clusters: int = 8, dims: int = 64, rounds: int = 10, scale: int = 1024, seed: int = 3, kept: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid (its components) for every kept vector.

    Kept are vectors of exactly `dims` components, none null or non-finite; each
    component becomes floor(scale * component). Centroids start as the vectors
    whose ids hash lowest under `seed`: null ids after all others, rows of one id
    in the order of their components. Each of `rounds` rounds assigns every
    vector to the nearest centroid (squared Euclidean distance, ties to the
    smaller number) and moves every centroid that has vectors to the floor of
    their mean; then vectors are assigned once more. With fewer vectors than
    clusters, there are as many centroids as vectors. Repeated rows are vectors
    of their own. Without a kept vector, as in an empty table, the result is
    empty. A component of 2**27 or more after scaling is an error. ids are cast
    to long; extra columns may have any names and are not looked at. kept: the
    nearest centroids a vector remembers at first.
    """
    spark = vectors.sparkSession
    whole = integer_vectors(vectors, dims, scale, id_col, vector_col)
    start = first_centroids(whole, clusters, seed)
    schema = f"`{id_col}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array(start, dtype=np.int64)
    k = len(centroids)
    kept, least = min(kept or max(math.ceil(k / 2), 2), k), min(max(math.ceil(k / 8), 2), k)

    laid = new_path(spark)
    found = written(whole.mapInArrow(_blocks(block), _BLOCKS), laid)
    n = found.count()
    buckets = min(n, parts_for(spark, n, BLOCKS_IN_BUCKET))
    blocks, _ = _bucketed(found.repartition(buckets, "block"), buckets)
    discard(spark, laid)

    state, path, moved = None, None, None
    for _ in range(rounds):
        state, path, before = *_bucketed(_assigned(blocks, state, _pass(centroids, moved, kept, last=False), _STATE), buckets), path
        if before:
            discard(spark, before)
        totals = _added(state)
        totals, looked = np.array(totals[: k * (dims + 1)], dtype=object).reshape(k, dims + 1), totals[k * (dims + 1) :]
        after = np.array([[int(s) // int(t[0]) for s in t[1:]] if t[0] else list(c) for t, c in zip(totals, centroids.tolist(), strict=True)], dtype=np.int64)
        moved = np.sqrt(((after - centroids) ** 2).sum(1).astype(float)) * (1 + _MARGIN)
        kept, centroids = min(kept, max([least, *(j for j in range(kept + 1) if looked[j])])), after
        if not moved.any():
            break
    final, _ = _bucketed(_assigned(blocks, state, _pass(centroids, moved, kept, last=True), _LAST), buckets)
    if path:
        discard(spark, path)
    spent = _added(final.select("totals"))
    rows = [(i, spent[i], sum(spent), c) for i, c in enumerate(centroids.tolist())]
    of_clusters = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))  # one row a cluster
    placed = blocks.select("block", "ids").join(final.select("block", "cluster", "distance"), "block").select(F.explode(F.arrays_zip(F.col("ids"), F.col("cluster"), F.col("distance"))).alias("v"))
    return placed.select(F.col("v.ids").alias(id_col), "v.cluster", "v.distance").join(of_clusters, "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def _assigned(blocks: DataFrame, state: DataFrame | None, assign: Callable, schema: str) -> DataFrame:
    both = blocks.select("block", "x") if state is None else blocks.select("block", "x").join(state.select("block", "near", "bounds"), "block")
    return both.mapInArrow(assign, schema)


def cluster_report(vectors: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """cluster_vectors() with its defaults, the centroid as the hash of its components."""
    name: Column = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return cluster_vectors(vectors, id_col=id_col).select(id_col, "cluster", "distance", "cluster_inertia", "inertia", name.alias("centroid_sha256"))
