"""The corpus queries on the smallest tables: against SQL where there is one, else their shape and totals."""

import duckdb
import pytest

from kartoteka.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, TABLES, plain


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    con = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_one_row_per_document(spark, duck, name):
    ids = [r.doc_id for r in QUERIES[name](spark, SF).collect()]
    want = [r[0] for r in duck.execute("SELECT doc_id FROM documents").fetchall()]
    assert sorted(set(ids)) == sorted(set(want))
    if name != "op7_packing":
        assert len(ids) == len(want)
