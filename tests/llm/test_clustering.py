"""Clusters against Lloyd's rounds in plain integers."""

import hashlib
import math

import numpy as np
import pytest

from kartoteka.llm.clustering import cluster_report, cluster_vectors, reassign, scan, squares
from tests.llm import clashing

SCHEMA = "vec_id long, embedding array<float>, label int"


def data(dims, n=160, spread=1.0):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(5, dims))
    rows = [(int(i * 7919 % 10_007), [float(np.float32(v)) for v in base[i % 5] + spread * rng.normal(size=dims) * rng.choice([0, 0.2, 1])], i % 3) for i in range(n)]
    rows += [rows[4], rows[4], (None, rows[7][1], 1), (None, rows[8][1], 1)]
    ones = [1.0] * dims
    rows += [(20_001, ones[1:], 1), (20_002, [*ones, 1.0], 1), (20_003, [None, *ones[1:]], 1), (20_004, [math.nan, *ones[1:]], 1), (20_005, [math.inf, *ones[1:]], 1), (20_006, None, 1), (20_007, [], None), (20_008, [-v for v in ones], None)]
    return rows


def brute(rows, clusters, dims, rounds, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * v) for v in e]) for i, e, _ in rows if e is not None and len(e) == dims and all(v is not None and math.isfinite(v) for v in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cs = [list(x) for _, x in first[:clusters]]
    d = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for r in range(rounds + 1):
        at = [min(range(len(cs)), key=lambda c: (d(x, cs[c]), c)) for _, x in kept]
        if r < rounds:
            for c in range(len(cs)):
                own = [x for (_, x), a in zip(kept, at, strict=True) if a == c]
                if own:
                    cs[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    far = [d(x, cs[a]) for (_, x), a in zip(kept, at, strict=True)]
    inertia = [sum(f for f, a in zip(far, at, strict=True) if a == c) for c in range(len(cs))]
    return sorted([(i, a, f, inertia[a], sum(far), cs[a]) for (i, _), a, f in zip(kept, at, far, strict=True)], key=str)


@pytest.mark.parametrize("clusters,rounds,kept,block", [(8, 10, None, 4096), (8, 4, 2, 7), (20, 6, 3, 50), (1, 2, None, 9), (400, 2, 5, 64)])
def test_matches_plain_rounds(spark, clusters, rounds, kept, block):
    rows = data(6)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted([tuple(r) for r in cluster_vectors(df, clusters, 6, rounds, kept=kept, block=block).collect()], key=str)
    assert got == brute(rows, clusters, 6, rounds)


def test_bounds_give_what_a_scan_gives_round_after_round():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, size=(3000, 5))
    c = x[:12].copy()
    near, bounds = scan(x, c, 6)
    looked = []
    for step in range(15):
        kept = max(2, 6 - step // 3)
        after = c + rng.integers(-20, 20, size=c.shape) // (1 + step)
        moved = np.sqrt(((after - c) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        c = after
        near, bounds, need = reassign(x, c, moved, near, bounds, kept)
        d = squares(x, c)
        assert (near[:, 0] == d.argmin(1)).all()
        own = np.sqrt(np.take_along_axis(d, near.astype(int), 1))
        assert (bounds[:, 0] >= own[:, 0] - 1e-6).all() and (bounds[:, 1:kept] <= own[:, 1:] + 1e-6).all()
        rest = d.astype(float)
        np.put_along_axis(rest, near.astype(int), np.inf, 1)
        assert (bounds[:, kept] <= np.sqrt(rest.min(1)) + 1e-6).all()
        looked.append((need == 1).mean())
    assert looked[-1] > 0.8  # most rows stand without a distance once centroids rest


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-(1 << 26), 1 << 26, size=(40, 64)), rng.integers(-(1 << 26), 1 << 26, size=(3, 64))
    assert squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for s in c] for r in x]


def test_report_other_columns_ties_and_empty_tables(spark):
    rows = data(64, 40)
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted([(*r[:5], hashlib.sha256(",".join(map(str, r[5])).encode()).hexdigest()) for r in brute(rows, 8, 64, 10)], key=str)
    for d in (df, clashing(df)):
        assert sorted([tuple(r) for r in cluster_report(d).collect()], key=str) == want
    same = spark.createDataFrame([(i, [1.0] * 64, 1) for i in range(12)], SCHEMA)
    assert {tuple(r)[1:5] for r in cluster_report(same).collect()} == {(0, 0, 0, 0)}
    assert cluster_report(df.limit(0)).collect() == [] and cluster_report(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).collect() == []
    huge = spark.createDataFrame([(1, [1e30] * 64, 1)], SCHEMA)
    with pytest.raises(Exception, match="would exceed a long"):
        cluster_report(huge)
