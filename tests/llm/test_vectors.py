import math

import numpy as np

from kartoteka.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def data():
    rng = np.random.default_rng(4)
    rows = [(1, None, 1), (2, [0.0] * 6, 1), (3, [float("nan")] + [1.0] * 5, 1), (4, [None] + [1.0] * 5, 1), (5, [], 1), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [float("inf")] * 6, 1)]
    i = 10
    for label in (1, 1, 2, None):
        for _ in range(6):
            base = rng.normal(size=6)
            for _ in range(int(rng.integers(1, 14))):
                v = base + rng.normal(size=6) * rng.choice([0, 0.1, 0.3])
                rows.append((int(i * 7919 % 1009), [float(np.float32(x)) for x in v], label))
                i += 1
    rows.append((None, rows[-1][1], 1))
    rows += [rows[12], (900, [1e-30 * x for x in rows[14][1]], rows[14][2])]
    return rows


def brute(rows, threshold):
    ok = [x is not None and len(x) and all(v is not None and math.isfinite(v) for v in x) and any(x) and y is not None for _, x, y in rows]
    n = len(rows)
    linked = [[False] * n for _ in rows]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.float32(r[1]), dtype=float) for r in (rows[a], rows[b]))
                x, y = x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max(), y / np.linalg.norm(y / np.abs(y).max()) / np.abs(y).max()
                linked[a][b] = linked[b][a] = float(x @ y) >= threshold
    label = list(range(n))
    for _ in range(n):
        new = [min([label[a]] + [label[b] for b in range(n) if linked[a][b]]) for a in range(n)]
        if new == label:
            break
        label = new
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if label[b] == label[a] and rows[b][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[a][0], sum(linked[a]), c, rows[a][0] == c))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    for tile in (2048, 5):
        got = sorted([tuple(r) for r in near_vectors(df, tile=tile).collect()], key=str)
        assert got == brute(rows, 0.93)


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_labels_are_compared_as_they_are(spark):
    rows = [(1, 1.2, [1.0, 0.0]), (2, 1.7, [1.0, 0.0]), (3, 1.2, [1.0, 0.01])]
    for kind, name in (("double", float), ("string", str)):
        df = spark.createDataFrame([(i, name(x), v) for i, x, v in rows], f"vec_id long, label {kind}, embedding array<double>")
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect()) == [(1, 1, 1), (2, 0, 2), (3, 1, 1)]
