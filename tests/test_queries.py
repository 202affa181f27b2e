"""Every registered query of the catalog engine against its SQL in DuckDB."""

import math

import duckdb
import pytest

from kartoteka import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_likely_keys_come_through_the_fuzzy_step(spark):
    assert {"exact", "words", "blacklist", "fuzzy", "unmapped"} >= (how := {r.how for r in plans.QUERIES["likely_keys"](spark, SF).collect()}) >= {"exact", "fuzzy"}, how
