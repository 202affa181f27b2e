import random
import re

from pyspark.sql import functions as F

from kartoteka.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string, node string, component string"


def brute(rows, percent, k=5):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        c = min(ids) if ids else None
        out.append((i, len(sets[a]), c, i == c))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows, i = [(-5, None), (-4, ""), (-3, " \t\n"), (-2, "one Two"), (-1, "ONE two"), (0, "one two"), (0, "one two")], 1
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(4, 150))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i * 7 % 1009, rng.choice([" ", "\n", "  "]).join(t)))
            i += 1
    rows.append((None, rows[-1][1]))
    rows.append((None, "a text of its own"))
    return rows


def run(spark, data, **kw):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA)
    got = near_duplicates(df, **kw)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    assert run(spark, rows, percent=85) == brute(rows, 85)


def test_blocks_of_a_large_cluster_give_the_same(spark):
    rows = corpus()
    assert run(spark, rows, percent=80, block_shingles=300) == brute(rows, 80)


def test_chained_clusters_fall_apart_into_bands(spark):
    """Few bands and tiny blocks: clusters of more blocks than bands give what larger blocks give."""
    rows = corpus()
    want = run(spark, rows, percent=85, rows=2, bands=12)
    assert run(spark, rows, percent=85, rows=2, bands=12, block_shingles=15) == want == brute(rows, 85)


def test_empty_table(spark):
    assert run(spark, [], percent=85) == []


def test_very_long_text(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 300_000)]
    assert run(spark, rows, percent=85) == brute(rows, 85)
