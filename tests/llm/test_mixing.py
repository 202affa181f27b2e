import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from kartoteka.llm.mixing import apportion, mix, targets


def highest_quotients(weights, seats):
    got = dict.fromkeys(weights, 0)
    for _ in range(seats):
        best = max(weights, key=lambda k: (Fraction(weights[k]) / (2 * got[k] + 1), [-ord(c) for c in k]))
        got[best] += 1
    return got


@pytest.mark.parametrize("seats", [0, 1, 7, 250])
def test_apportion_is_sainte_lague(spark, seats):
    rng = random.Random(seats)
    weights = {f"k{i:02}": rng.choice([0, 1, 3, 50, 1000]) for i in range(20)}
    df = spark.createDataFrame([("p", k, float(w), seats) for k, w in weights.items()], "p string, k string, w double, seats long")
    got = {r.k: r.got for r in apportion(df, ["p"], "k", "w", "seats", "got").collect()}
    assert got == highest_quotients(weights, seats)


def test_targets_share_the_excess(spark):
    sizes = {"a": 1, "b": 100, "c": 2, "d": 1000, None: 0}
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        level = left / sum(weights[s] for s in weights if s not in capped)
        over = {s for s in weights if s not in capped and level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s in sizes:
        assert got[s] == pytest.approx(3 * sizes[s] if s in capped else level * weights[s])


def rows(n=600):
    rng = random.Random(2)
    out = [(None, None, None), (1, "", "a"), (1, "x", "a"), (1, "x", "a"), (2, "w " * 40_000, "big")]
    for i in range(n):
        out.append((100 + i, " \n\t"[i % 3].join(["w"] * rng.randint(0, 900)), rng.choice(["a", "b", "big", "big", "big", None])))
    return out


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, s, 3, 4) for i, t, s in data], "doc_id long, text string, source string, size int, shard int")
    got = mix(df).collect()
    assert sorted(str((r.doc_id, r.size, r.source)) for r in got) == sorted(str((i, len((t or "").split()), s)) for i, t, s in data)
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    for s in taken:
        assert abs(taken[s] - target[s]) <= 128
    assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = mix(df.repartition(7, F.rand(3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing_to_take(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).collect() == []
    got = mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2
