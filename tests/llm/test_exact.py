"""Exact duplicates against a grouping in plain Python."""

import hashlib
import random
import string

import pytest
from pyspark.sql import functions as F

from kartoteka.llm.exact import KEY, exact_duplicates, merge_runs
from tests.llm import clashing

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        kept = False
        for i in ids:
            mine = i == keep and not kept
            kept |= mine
            out.append((i, keep, len(ids), mine, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def data():
    rng = random.Random(3)
    rows = [(i, rng.choice(["Ab", "aB", "ab ", "Ärger", "ärger", "ÄRGER", "ÄRGEr", "İ", "i", "K", "k", "", None])) for i in range(200)]
    rows += [(5, "Ab"), (5, "ab"), (None, "ab"), (None, "only"), (None, "ONLY"), (-3, "ab"), (900, "long " * 60_000), (901, "LONG " * 60_000)]
    return rows


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("ways,rounds", [(16, 2), (2, 3), (3, 1)])
def test_matches_a_plain_grouping(spark, largest, ways, rounds):
    rows = data()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted([tuple(r) for r in exact_duplicates(df, largest=largest, ways=ways, rounds=rounds).collect()], key=str)
    assert got == brute(rows, largest)


def test_a_digest_with_another_check_is_another_text(spark):
    runs = spark.createDataFrame([(0, b"d", 1, 5, 10, 1), (3, b"d", 1, 5, 4, 2), (9, b"d", 2, 5, 1, 1), (9, b"d", 1, 6, 0, 1)], "run long, digest binary, check long, bytes int, best long, size long")
    got = sorted(tuple(r)[1:] for r in merge_runs(runs).select(*KEY, "best", "size").collect())
    assert got == [(1, 5, 4, 3), (1, 6, 0, 1), (2, 5, 1, 1)]


def test_no_round_leaves_more_records_of_a_text_than_runs(spark):
    rows = spark.range(0, 60_000, 1, 40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_duplicates(rows, largest=True)
    assert got.filter("group_size > 1").agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first() == (20_000, 59_997, 59_997, 1)
    assert got.filter("kept").count() == 40_001


def test_other_columns_empty_tables_and_other_ids(spark):
    rows = spark.createDataFrame(data(), "doc_id long, text string")
    assert sorted(exact_duplicates(clashing(rows)).collect(), key=str) == sorted(exact_duplicates(rows).collect(), key=str)
    assert exact_duplicates(rows.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "X"), ("a", "x"), (None, "x")], "row string, digest string")
    assert sorted(tuple(r)[:4] for r in exact_duplicates(named, id_col="row", text_col="digest").filter("row is not null").collect()) == [("a", "a", 3, True), ("b", "a", 3, False)]
