"""Queries over trees and states: spellings that contain each other, each with SQL that closes the relation itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.operators import audit, canons, coverage, identity
from kartoteka.plans.catalog import _table, query


@query("""
WITH RECURSIVE w AS (SELECT p_brand, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL AND p_brand IS NOT NULL),
v AS (SELECT p_brand, array_to_string(w[1:n], ' ') AS value FROM w, (VALUES (1), (2), (3)) t(n) WHERE len(w) >= n),
c AS (SELECT p_brand, value, count(*) AS n, replace(value, ' ', '') AS stem FROM v GROUP BY p_brand, value),
s AS (SELECT DISTINCT p_brand, stem FROM c),
roots AS (SELECT a.p_brand, b.stem, min(length(a.stem)) AS n FROM s a JOIN s b ON a.p_brand = b.p_brand AND length(a.stem) >= 6 AND length(b.stem) > length(a.stem) AND starts_with(b.stem, a.stem) GROUP BY ALL),
tokens AS (SELECT c.p_brand, c.stem, arg_max(t.stem, (k, value)) AS word FROM (SELECT p_brand, stem, value, unnest(string_split(value, ' ')) AS token, unnest(range(len(string_split(value, ' ')))) AS k FROM c) c JOIN s t ON t.p_brand = c.p_brand AND t.stem = token AND length(token) >= 6 AND token <> c.stem GROUP BY ALL),
up AS (SELECT p_brand, stem, coalesce(word, substr(stem, 1, roots.n), stem) AS parent FROM s LEFT JOIN roots USING (p_brand, stem) LEFT JOIN tokens USING (p_brand, stem)),
walk AS (SELECT p_brand, stem, parent AS here, 1 AS k FROM up UNION ALL SELECT w.p_brand, w.stem, u.parent, k + 1 FROM walk w JOIN up u ON u.p_brand = w.p_brand AND u.stem = w.here WHERE u.parent <> w.here AND k < 50),
root AS (SELECT p_brand, stem, arg_max(here, k) AS root FROM walk GROUP BY ALL),
best AS (SELECT p_brand, root, arg_min(value, (-n, length(value), value)) AS canon FROM c JOIN root USING (p_brand, stem) GROUP BY ALL)
SELECT p_brand, value, canon FROM c JOIN root USING (p_brand, stem) JOIN best USING (p_brand, root)
""")
def one_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of part names, of one to three words, spelled alike within a brand where one contains another."""
    words = _table(spark, sf_dir, "part").filter("p_name is not null and p_brand is not null").select("p_brand", F.split("p_name", " ").alias("w"))
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size("w"), F.lit(3))), lambda n: F.array_join(F.slice("w", F.lit(1), n), " "))
    return canons.unified_spellings(words.select("p_brand", F.explode(starts).alias("value")), "p_brand", "value")


@query(r"""
WITH m AS (SELECT p_partkey, p_brand, CASE WHEN coalesce(p_size, 0) % 2 = 0 THEN 50 ELSE 60 END AS width FROM part),
t AS (SELECT o_orderkey, o_custkey AS k, 'Купить ' || CASE WHEN o_custkey % 3 = 0 THEN 'rx' ELSE 'RX-' END || o_custkey || CASE WHEN length(o_orderpriority) % 2 = 0 THEN ' 50' ELSE '_60' END || ', ' || coalesce(b.p_brand, '') || '; RX7' || o_custkey AS said FROM orders LEFT JOIN part b ON b.p_partkey = o_custkey + (o_orderkey % 2))
SELECT p_partkey AS product_id, o_orderkey AS page_id FROM t JOIN m ON p_partkey = k
WHERE regexp_matches(lower(said), '(^|[^a-z0-9])rx[\s\-_/]*' || p_partkey || '[\s\-_/]*' || width || '([^a-z0-9]|$)') AND (coalesce(p_brand, '') = '' OR contains(said, p_brand || ';'))
  AND NOT (p_partkey IN (40, 45, 50, 55, 60, 70, 80, 90) AND p_partkey <> width AND width = 50) -- reads as another width of RX, unless an underscore goes on
UNION SELECT p_partkey, o_orderkey FROM t JOIN m ON '7' || k = p_partkey || width::VARCHAR WHERE coalesce(p_brand, '') = '' OR contains(said, p_brand || ';') -- the last word, run together
""")
def identified_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, one an order, that name a part's model in one spelling or another, its width and its brand."""
    parts = _table(spark, sf_dir, "part")
    model = F.concat(F.lit("RX "), F.col("p_partkey").cast("string"), F.when(F.coalesce("p_size", F.lit(0)) % 2 == 0, "-50").otherwise("-60"))
    products = parts.select(F.col("p_partkey").alias("product_id"), F.lit(None).cast("string").alias("name"), F.col("p_brand").alias("brand"), model.alias("model"), F.lit(None).cast("array<string>").alias("brand_names"))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("p_partkey"))
    key = F.col("o_custkey").cast("string")
    said = F.concat(F.lit("Купить "), F.when(F.col("o_custkey") % 3 == 0, "rx").otherwise("RX-"), key, F.when(F.length("o_orderpriority") % 2 == 0, " 50").otherwise("_60"), F.lit(", "), F.coalesce("p_brand", F.lit("")), F.lit("; RX7"), key)
    pages = orders.join(parts.select("p_partkey", "p_brand"), "p_partkey", "left").select(F.col("o_orderkey").alias("page_id"), said.alias("text"))
    return identity.product_pages(pages, products)


#: Strata of parts: overlapping conditions and how many of each are wanted.
_STRATA = [("small", "p_size < 15", 8), ("steel", "contains(p_type, 'STEEL')", 6), ("dear", "p_retailprice > 1000", 5), ("first", "p_partkey < 40", 10)]


def _pick_sql() -> str:
    """One step a stratum: open rows by the count of their brand among those taken, then by hash."""
    steps = ["rows AS MATERIALIZED (SELECT p_partkey AS k, p_brand AS b, list_reduce([2166136261::BIGINT] || list_transform(string_split(p_partkey::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h, " + ", ".join(f"coalesce({c}, false) AS {n}" for n, c, _ in _STRATA) + " FROM part)", "taken0 AS MATERIALIZED (SELECT k, b FROM rows WHERE false)"]
    for i, (name, _, quota) in enumerate([*_STRATA, (None, None, None)]):
        want = str(quota) if name else f"greatest(0, 40 - (SELECT count(*) FROM taken{i}))"
        steps.append(f"taken{i + 1} AS MATERIALIZED (SELECT k, b FROM taken{i} UNION ALL (SELECT k, b FROM rows r WHERE {name or 'true'} AND k NOT IN (SELECT k FROM taken{i}) ORDER BY (SELECT count(*) FROM taken{i} t WHERE t.b IS NOT DISTINCT FROM r.b), h, k LIMIT ({want})))")
    told = "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n, _, _ in _STRATA) + "], lambda x: x IS NOT NULL)"
    return f"WITH {', '.join(steps)} SELECT k AS p_partkey, CASE WHEN len({told}) = 0 THEN 'plain' ELSE array_to_string({told}, ',') END AS strata FROM rows WHERE k IN (SELECT k FROM taken{len(_STRATA) + 1})"


@query(_pick_sql())
def picked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts to label: quotas of overlapping strata, brands in balance, topped up from all."""
    strata = [(name, F.coalesce(F.expr(condition), F.lit(False)), quota) for name, condition, quota in _STRATA]
    picked = audit.stratified_pick(_table(spark, sf_dir, "part"), "p_partkey", "p_brand", strata, 40)
    return picked.select("p_partkey", F.array_join("strata", ",").alias("strata"))


@query("""
WITH p AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS kind, c_acctbal < 0 AS mismatch, c_nationkey, CASE WHEN c_acctbal < 0 AND c_nationkey < 20 THEN c_nationkey + 1 END AS moved FROM customer),
f AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS code FROM orders WHERE o_orderstatus <> 'P'), own AS (SELECT id FROM p WHERE NOT mismatch), names AS (SELECT DISTINCT o_orderpriority AS code FROM orders WHERE o_orderpriority <> '5-LOW' UNION SELECT 'unused')
SELECT 'kind' AS section, coalesce(kind, CASE WHEN mismatch THEN 'mismatch' ELSE 'other' END) AS name, count(*)::BIGINT AS n, NULL::BIGINT AS share, NULL AS status FROM p GROUP BY 2
UNION ALL SELECT 'move', c_nationkey || '>' || moved, count(*), NULL, NULL FROM p WHERE moved IS NOT NULL GROUP BY 2
UNION ALL SELECT 'filter', code, n, s, CASE WHEN s >= 70 THEN 'ok' ELSE 'below_threshold' END FROM (SELECT code, count(f.id) AS n, floor(count(f.id) * 100 / greatest(1, (SELECT count(*) FROM own)) + 0.5)::BIGINT AS s FROM names LEFT JOIN (SELECT f.* FROM f JOIN own USING (id)) f USING (code) GROUP BY code)
UNION ALL SELECT 'total', 'products', count(*), (SELECT count(*) FROM own), NULL FROM p
""")
def filter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as products, their orders as filters: kinds, moves, how full filters are, and totals, by grouping sets over one pass."""
    wrong = F.col("c_acctbal") < 0
    products = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("kind"), wrong.alias("mismatch"), F.col("c_nationkey").alias("category"), F.when(wrong & (F.col("c_nationkey") < 20), F.col("c_nationkey") + 1).alias("suggested"))
    orders = _table(spark, sf_dir, "orders")
    filters = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"))
    names = orders.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderpriority").alias("code")).distinct().unionByName(spark.range(1).select(F.lit("unused").alias("code")))
    return coverage.filter_report(products, filters, names)
