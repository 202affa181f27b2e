"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are scaled to unit length and rotated to their principal axes, leading
axis first; the rotation leaves cosines as they are. Tiles of vectors that
could hold a link are compared a few dimensions at a time: the product so far
plus the product of the norms of what is left bounds the cosine, and a pair is
dropped once that bound cannot reach the threshold. Tiles are cut by label and
by cells along the two leading axes; cells further apart than the longest chord
of a link hold none. Equal vectors are one node with a weight.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import cut
from kartoteka.llm.components import Forest, connected_components

#: Vectors of a tile, rows compared at once, dimensions added at a time, and what rounding may shift a cosine by.
TILE, STRIP, STEP, ROUNDING = 2048, 256, 8, 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def principal_axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes (columns) by descending share of the second moment over all nodes."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, vectors in _by_length(batch.column(0)):
                x = _unit(vectors)
                sums[length] = sums.get(length, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d)), pa.array(m.reshape(-1))], ["d", "cell", "value"])

    cells = nodes.select("embedding").mapInArrow(moments, "d int, cell long, value double").groupBy("d", "cell").agg(F.sum("value").alias("value")).toPandas()
    out = {}
    for d, own in cells.groupby("d"):
        moment = own.sort_values("cell")["value"].to_numpy().reshape(d, d)
        out[int(d)] = np.linalg.eigh(moment)[1][:, ::-1].copy()
    return out


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    rows = column.to_pylist()
    lengths = np.array([len(r) for r in rows])
    for d in np.unique(lengths):
        yield int(d), np.array([r for r in rows if len(r) == d], dtype=np.float64)


def _celled(axes: dict[int, np.ndarray], width: float):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(r) for r in batch.column(2).to_pylist()])
            for d in np.unique(lengths):
                own = batch.filter(pa.array(lengths == d))
                x = _matrix(own.column(2))
                z = _unit(x) @ axes[int(d)][:, :2]
                cells = np.floor(z / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(3), pa.array(np.full(len(x), d, np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, min(1, cells.shape[1] - 1)]), pa.array([r.tobytes() for r in x], pa.binary())],
                    ["node", "label", "weight", "d", "c1", "c2", "vector"],
                )

    return place


def _tile(key: tuple, t: pa.Table) -> pa.Table:
    column = lambda c: np.array(t.column(c).to_pylist(), dtype=np.int64).tobytes()
    keys = dict(zip(("label", "d", "c1", "c2", "part"), (k.as_py() for k in key)))
    types = {"label": pa.string(), "d": pa.int32(), "c1": pa.int32(), "c2": pa.int32(), "part": pa.int64()}
    out = {c: pa.array([v], types[c]) for c, v in keys.items()}
    return pa.table(out | {"nodes": pa.array([column("node")], pa.binary()), "weights": pa.array([column("weight")], pa.binary()), "vectors": pa.array([b"".join(t.column("vector").to_pylist())], pa.binary())})


class _Rotated:
    def __init__(self, vectors: bytes, axes: np.ndarray) -> None:
        self.x = _unit(np.frombuffer(vectors).reshape(-1, len(axes)))
        self.z = self.x @ axes
        self.left = np.sqrt(np.maximum(np.cumsum((self.z**2)[:, ::-1], axis=1)[:, ::-1], 0))
        self.left = np.hstack([self.left, np.zeros((len(self.z), 1))])


def _linked(a: _Rotated, b: _Rotated, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) with cosine >= threshold, for the given rows of a."""
    d = a.z.shape[1]
    product = np.zeros((len(range(*rows.indices(len(a.z)))), len(b.z)))
    for at in range(0, d, STEP):
        end = min(at + STEP, d)
        product += a.z[rows, at:end] @ b.z[:, at:end].T
        alive = product + np.outer(a.left[rows, end], b.left[:, end]) >= threshold - ROUNDING
        n = int(alive.sum())
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if end < d and n <= alive.size // (4 * d):
            i, j = np.nonzero(alive)
            cosine = product[i, j] + np.einsum("nd,nd->n", a.z[rows][i, end:], b.z[j, end:])
            break
    else:
        i, j = np.nonzero(alive)
        cosine = product[i, j]
    i = i + rows.start
    close = np.abs(cosine - threshold) <= ROUNDING
    cosine[close] = np.einsum("nd,nd->n", a.x[i[close]], b.x[j[close]])
    hit = cosine >= threshold
    return i[hit], j[hit]


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
                a = _Rotated(row["vectors_a"], axes[row["d"]])
                same = row["a"] == row["b"]
                b = a if same else _Rotated(row["vectors_b"], axes[row["d"]])
                nodes_a, weights_a = np.frombuffer(row["nodes_a"], np.int64), np.frombuffer(row["weights_a"], np.int64)
                nodes_b, weights_b = np.frombuffer(row["nodes_b"], np.int64), np.frombuffer(row["weights_b"], np.int64)
                links_a, links_b, edges = np.zeros(len(nodes_a), np.int64), np.zeros(len(nodes_b), np.int64), []
                shift = 0 if same else len(nodes_a)
                forest = Forest(shift + len(nodes_b))
                for start in range(0, len(nodes_a), STRIP):
                    i, j = _linked(a, b, slice(start, min(start + STRIP, len(nodes_a))), threshold)
                    if same:
                        i, j = i[i != j], j[i != j]
                    np.add.at(links_a, i, weights_b[j])
                    if not same:
                        np.add.at(links_b, j, weights_a[i])
                    for x in np.unique(i).tolist():
                        roots = forest.roots()
                        others = j[i == x] + shift
                        first = others[np.unique(roots[others], return_index=True)[1]]
                        edges += [(nodes_a[x], nodes_b[y - shift]) for y in first.tolist() if forest.join(x, y)]
                counted = [(nodes_a, links_a)] if same else [(nodes_a, links_a), (nodes_b, links_b)]
                node = np.concatenate([n[c > 0] for n, c in counted] + [np.array([e[0] for e in edges], np.int64)])
                links = np.concatenate([c[c > 0] for _, c in counted] + [np.zeros(len(edges), np.int64)])
                other = [None] * (len(node) - len(edges)) + [int(e[1]) for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(links, pa.int64())], ["node", "other", "links"])

    return compare


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id, kept.

    Rows are linked when labels (of any type that has a text, by that text) are
    equal and not null, vectors have the same length, and their cosine in double precision reaches the threshold. Null,
    empty and zero vectors and those with a null or non-finite component link
    with nothing; they, and rows of null label, are their own component. Copies
    link with each other. component_id is the smallest id reachable; a null id
    stays null and is never chosen while there is another. An empty table gives
    an empty result.
    """
    values = F.col(vector_col).cast("array<double>")
    sound = F.coalesce(F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0) & F.col(label_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(sound, F.col(label_col).cast("string")).alias("label"), F.when(sound, values).alias("embedding"))
    filled = rows.filter("label is not null")
    nodes = cut(filled.groupBy("label", "embedding").agg(F.min("id").alias("least"), F.count("*").alias("weight"))).withColumn("node", F.monotonically_increasing_id())
    axes = principal_axes(nodes)
    placed = nodes.select("node", "label", "embedding", "weight").mapInArrow(_celled(axes, math.sqrt(2 - 2 * threshold) * (1 + 1e-6)), "node long, label string, weight long, d int, c1 int, c2 int, vector binary")
    cell = ["label", "d", "c1", "c2"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / tile).alias("parts"))
    tiles = placed.join(sizes, cell).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).groupBy(*cell, "part")
    tiles = cut(tiles.applyInArrow(_tile, "label string, d int, c1 int, c2 int, part long, nodes binary, weights binary, vectors binary")).withColumn("tile", F.monotonically_increasing_id())
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    left = tiles.select("label", "d", around("c1"), "c2", F.col("tile").alias("a")).select("label", "d", "c1", around("c2"), "a")
    pairs = left.join(tiles.select(*cell, F.col("tile").alias("b")), cell).filter("a <= b").select("a", "b", "d")
    held = lambda s: tiles.select(F.col("tile").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("nodes", "weights", "vectors")])
    found = cut(pairs.join(held("a"), "a").join(held("b"), "b").mapInArrow(_compare(axes, threshold), "node long, other long, links long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(links, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    known = known.join(known.groupBy("class").agg(F.min("least").alias("component_id")), "class")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    component = F.coalesce("component_id", "id")
    return rows.join(known, ["label", "embedding"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))
