"""Queries that run the coverage and cost reports on the star-schema tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions.values import same_box
from kartoteka.operators import coverage, normalise, reports, shape
from kartoteka.plans.catalog import _table, query
from kartoteka.sources import products

_LEVEL_SQL = "CASE event_type WHEN 'purchase' THEN 'S1' WHEN 'signup' THEN 'S2' WHEN 'view' THEN 'S3' ELSE 'model' END"


def _level():
    kind = F.col("event_type")
    return F.when(kind == "purchase", "S1").when(kind == "signup", "S2").when(kind == "view", "S3").otherwise("model")


@query(f"WITH e AS (SELECT user_id, {_LEVEL_SQL} AS l FROM events) SELECT count(*) FILTER (l = 'S1') AS from_annotation, count(*) FILTER (l = 'S2') AS from_description, count(*) FILTER (l = 'S3') AS from_external, count(DISTINCT user_id) FILTER (l = 'S3') AS products_with_external FROM e")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.source_stats(_table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), _level().alias("level")))


def _cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_mktsegment") == "MACHINERY").alias("mismatch"))
    filters = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("code"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("label"))
    return own, filters


_CARDS_SQL = "own AS (SELECT c_custkey AS id FROM customer WHERE c_mktsegment <> 'MACHINERY'), f AS (SELECT DISTINCT o_custkey AS id, o_orderpriority AS code FROM orders WHERE o_orderstatus <> 'P')"


@query(f"""
WITH {_CARDS_SQL}, n AS (SELECT DISTINCT o_orderpriority AS code FROM orders UNION SELECT 'none'), c AS (SELECT code, count(*) AS filled FROM f JOIN own USING (id) GROUP BY 1), t AS (SELECT count(*) AS eligible FROM own)
SELECT code, coalesce(filled, 0)::BIGINT AS filled, eligible, floor(coalesce(filled, 0) * 100 / greatest(eligible, 1)::DOUBLE + 0.5)::BIGINT AS coverage, CASE WHEN floor(coalesce(filled, 0) * 100 / greatest(eligible, 1)::DOUBLE + 0.5) >= 70 THEN 'ok' ELSE 'below_threshold' END AS status FROM n LEFT JOIN c USING (code), t
""")
def filter_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, filters = _cards(spark, sf_dir)
    names = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("code")).distinct().unionByName(spark.createDataFrame([("none",)], "code string"))
    return coverage.filter_coverage(own, filters, names)


@query(f"""
WITH {_CARDS_SQL}, c AS (SELECT id, count(*) AS n, count(*) FILTER (code IN ('1-URGENT', '5-LOW')) AS r FROM f GROUP BY id)
SELECT id, coalesce(n, 0)::BIGINT AS n_filters, coalesce(r, 0)::BIGINT AS n_required, coalesce(n, 0) <= 5 AS few, coalesce(r, 0) < 2 AS missing_required FROM own LEFT JOIN c USING (id) WHERE coalesce(n, 0) <= 5 OR coalesce(r, 0) < 2
""")
def thin_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, filters = _cards(spark, sf_dir)
    return coverage.thin_products(own, filters, spark.createDataFrame([("1-URGENT",), ("5-LOW",)], "code string"))


@query(f"""
WITH {_CARDS_SQL}, c AS (SELECT id, count(*) AS n, count(*) FILTER (code <> '5-LOW') AS r FROM f WHERE code IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY id)
SELECT c_custkey AS id, 3::BIGINT AS total, coalesce(n, 0)::BIGINT AS filled, floor(coalesce(n, 0) * 100 / 3.0 + 0.5)::BIGINT AS coverage, coalesce(r, 0) = 2 AS ok FROM customer LEFT JOIN c ON id = c_custkey
""")
def card_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, filters = _cards(spark, sf_dir)
    return coverage.card_coverage(own, filters, spark.createDataFrame([("1-URGENT", False), ("2-HIGH", False), ("5-LOW", True)], "code string, optional boolean"))


@query("SELECT o_custkey AS dict, count(*) FILTER (o_orderstatus <> 'O') AS problems, count(*) FILTER (o_orderstatus = 'F') AS errors, count(*) AS checked FROM orders GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    issues = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("dict"), F.when(s == "F", "error").when(s == "P", "warn").otherwise("info").alias("severity"))
    return coverage.severity_counts(issues, ["dict"])


@query("""
WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'extra' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'missing' ELSE 'issues' END END AS status FROM orders)
SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'extra') AS extra, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'issues') AS issues, floor(count(*) FILTER (status = 'ok') * 1000 / count(*)::DOUBLE + 0.5) / 10 AS ok_share FROM s
""")
def pack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return coverage.pack_summary(_table(spark, sf_dir, "orders").select(F.when(s == "F", "ok").when(s == "P", "extra").when(F.col("o_orderkey") % 2 == 0, "missing").otherwise("issues").alias("status")))


@query("SELECT user_id, count(*) AS items, count(*) FILTER (event_type IN ('purchase', 'signup')) AS described, count(*) FILTER (event_type = 'error') AS errors, sum(round(value * 100)::BIGINT)::BIGINT AS bytes, count(*) FILTER (event_type NOT IN ('purchase', 'signup', 'error')) AS pending FROM events GROUP BY 1")
def album_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "described").when(kind == "signup", "ready").when(kind == "error", "error").otherwise("new")
    return coverage.album_stats(_table(spark, sf_dir, "events").select("user_id", status.alias("status"), F.round(F.col("value") * 100).cast("long").alias("bytes")), "user_id")


@query("""
WITH l AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS s FROM events WHERE event_type = 'purchase' GROUP BY 1), p AS (SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS s FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, coalesce(l.s, 0)::BIGINT AS ledger, coalesce(p.s, 0)::BIGINT AS photos, greatest(coalesce(l.s, 0), coalesce(p.s, 0))::BIGINT AS spent FROM l FULL JOIN p USING (user_id)
""")
def money_spent(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return coverage.spent(events.filter("event_type = 'purchase'"), events.filter("event_type = 'view'"), "user_id", "cents")


@query("""
WITH t AS (SELECT count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'view') AS skipped, sum(round(value * 100)::BIGINT) FILTER (event_type = 'purchase')::BIGINT AS cost FROM events), b AS (SELECT *, floor(5000 * ok / (ok + skipped)::DOUBLE + 0.5)::BIGINT AS billable FROM t)
SELECT ok, skipped, round(cost / ok::DOUBLE, 6) AS each, billable, round(cost / ok::DOUBLE * billable, 3) AS forecast FROM b
""")
def cost_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    runs = _table(spark, sf_dir, "events").select(F.when(kind == "purchase", "ok").when(kind == "view", "skipped").otherwise("error").alias("status"), F.round(F.col("value") * 100).cast("long").alias("cost"))
    return coverage.cost_forecast(runs, F.lit(5000)).select("ok", "skipped", F.round("each", 6).alias("each"), "billable", F.round("forecast", 3).alias("forecast"))


@query("""
WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS key, coalesce(p_brand, '') AS value, lower(p_name) AS folded FROM part)
SELECT arg_min(key, id) AS key, count(*) AS cnt, arg_min(CASE WHEN value <> '' THEN value END, CASE WHEN value <> '' THEN id END) AS sample FROM k GROUP BY folded ORDER BY cnt DESC, key LIMIT 25
""")
def key_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("seq"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("key"), F.coalesce("p_brand", F.lit("")).alias("value"))
    return coverage.key_samples(pairs, 25)


@query("WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 50) SELECT count(*) AS scanned, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 500) AS dear, count(*) FILTER (event_type = 'error') + count(*) FILTER (value > 500) = 0 AS ok FROM l")
def last_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.last_cards(_table(spark, sf_dir, "events"), "event_id", 50, {"failed": F.col("event_type") == "error", "dear": F.col("value") > 500})


@query("""
WITH f AS (SELECT o_custkey AS id, o_orderstatus AS code, min(o_orderpriority) AS value, count(DISTINCT o_orderpriority) AS n, bool_or(o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1, 2), g AS (SELECT c_custkey AS id, code FROM customer, (VALUES ('F'), ('O')) t(code))
SELECT id, code, value, CASE WHEN value IS NOT NULL THEN 'S1' END AS level, CASE WHEN n > 1 AND urgent THEN 'CONFLICT' WHEN n > 1 THEN 'RESOLVED' WHEN value IS NOT NULL THEN 'OK' ELSE 'empty' END AS status FROM g LEFT JOIN f USING (id, code)
""")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("p"))
    per = orders.groupBy("id", "code").agg(F.min("p").alias("value"), F.countDistinct("p").alias("n"), F.bool_or(F.col("p") == "1-URGENT").alias("needs_review"))
    attributes = spark.createDataFrame([("F", "A"), ("O", None), ("P", "X")], "code string, tier string")
    return coverage.attribution(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), attributes, per.select("id", "code", "value", F.lit("S1").alias("level")), per.filter("n > 1"))


@query("""
WITH s AS (SELECT o_custkey AS id, o_orderstatus AS code, min(o_orderpriority) AS value FROM orders GROUP BY 1, 2)
SELECT id, code, CASE WHEN code = 'P' OR id % 3 = 0 THEN value END AS value, NOT (code = 'P' OR id % 3 = 0) AS stripped FROM s
""")
def unsupported_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code")).agg(F.min("o_orderpriority").alias("value"))
    third = (F.col("id") % 3 == 0) & (F.col("code") != "P")
    told = F.when(F.col("code") == "F", F.lit("до 5")).otherwise("7")
    facts = coverage.attribute_facts(specs.filter(third).select("id", "code", told.alias("text")))
    return coverage.unsupported_specs(specs, facts, spark.createDataFrame([("F",), ("O",)], "code string"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS exact, CASE WHEN p_partkey % 3 = 0 THEN p_size + 2.0 WHEN p_partkey % 3 = 1 THEN p_size + 0.5 END AS claimed, CASE WHEN p_partkey % 2 = 0 THEN '10-30' ELSE '20+' END AS label, CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 20 END AS lo, CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 1e9 END AS hi FROM part WHERE p_size IS NOT NULL)
SELECT id, 'size' AS code, 'bucket' AS kind, exact AS number, label FROM p WHERE exact < lo OR exact > hi
UNION ALL SELECT id, 'size', 'cross_field', claimed, label FROM p WHERE claimed IS NOT NULL AND (abs(claimed - exact) > 0.6 OR claimed < lo OR claimed > hi)
""")
def bucket_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, size = _table(spark, sf_dir, "part").filter("p_size is not null"), F.col("p_size").cast("double")
    filters = part.select(F.col("p_partkey").alias("id"), F.lit("size").alias("code"), F.when(F.col("p_partkey") % 2 == 0, "10-30").otherwise("20+").alias("label"))
    told = part.select(F.col("p_partkey").alias("id"), F.lit("size").alias("code"), size.alias("exact"), F.when(F.col("p_partkey") % 3 == 0, size + 2).when(F.col("p_partkey") % 3 == 1, size + 0.5).alias("claimed"))
    return coverage.bucket_faults(filters, told)


@query("SELECT o_custkey AS id, count(*) AS issues FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY issues DESC, id LIMIT 40")
def worst_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.first_cards_with_issues(_table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")))


@query("""
WITH r AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS code, o_orderpriority AS label, CASE WHEN o_orderkey % 3 = 0 THEN '5-10' ELSE o_orderstatus END AS value, CASE WHEN o_orderkey % 5 = 0 THEN 'x' WHEN o_orderkey % 3 = 0 THEN '5-10' ELSE o_orderstatus END AS expected FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY id, lower(label) ORDER BY seq) AS k FROM r)
SELECT id, code, 'annotation_duplicate' AS kind, label AS detail FROM n WHERE k > 1 UNION ALL SELECT id, code, 'annotation_bucketed', value FROM n WHERE value = '5-10' UNION ALL SELECT id, code, 'annotation_mismatch', value || ' / ' || expected FROM n WHERE value <> expected
""")
def annotation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 3 == 0, "5-10").otherwise(F.col("o_orderstatus"))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), k.alias("seq"), F.col("o_orderstatus").alias("code"), F.col("o_orderpriority").alias("label"), value.alias("value"), F.when(k % 5 == 0, "x").otherwise(value).alias("expected"))
    return coverage.annotation_faults(rows)


@query("""
WITH n AS (SELECT l_suppkey AS id, l_returnflag AS name FROM lineitem UNION SELECT l_suppkey, l_linestatus FROM lineitem), d AS (SELECT * FROM (VALUES (1, 'r', 1.0), (1, 'f', 1.0), (1, 'o', 0.4), (2, 'a', 1.0), (2, 'n', 1.0), (2, 'o', 0.4)) t(category, name, points)),
s AS (SELECT id, category, round(sum(points), 6) AS score FROM n JOIN d ON lower(n.name) = d.name GROUP BY 1, 2 HAVING round(sum(points), 6) >= 2)
SELECT id, category, score::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, category) = 1
""")
def guessed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    names = lines.select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("name")).unionByName(lines.select(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("name")))
    dictionaries = spark.createDataFrame([(1, "R", True), (1, "F", True), (1, "O", False), (2, "A", True), (2, "N", True), (2, "O", False)], "category int, name string, enabled boolean")
    return products.guess_category(names, dictionaries, 2.0)


@query("SELECT p_partkey, p_partkey % 3 <> 1 AS same FROM part WHERE p_size IS NOT NULL")
def same_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    box = lambda w, h, d: F.struct(w.alias("width"), h.alias("height"), d.alias("depth"))
    k = F.col("p_partkey") % 3
    other = F.when(k == 0, box(size + 20, size, size + 10)).when(k == 1, box(size, size + 11, size + 20)).otherwise(box(size + 0.5, size + 10, size + 20.5))
    return _table(spark, sf_dir, "part").filter("p_size is not null").select("p_partkey", same_box(box(size, size + 10, size + 20), other).alias("same"))


@query("""
SELECT p_partkey AS id, 'Вес' AS key, CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE (p_size / 10)::DOUBLE::VARCHAR END AS value, 'S3' AS level FROM part WHERE p_size IS NOT NULL
UNION ALL SELECT p_partkey, 'Цвет', p_name, 'S3' FROM part WHERE p_size IS NOT NULL
""")
def specs_as_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _table(spark, sf_dir, "part").filter("p_size is not null").select(F.col("p_partkey").alias("id"), F.explode(F.create_map(F.lit("weight"), F.col("p_size").cast("string"), F.lit("colour"), F.col("p_name"))).alias("code", "value"))
    names = spark.createDataFrame([("weight", "Вес", "вес_г", 10.0), ("colour", "Цвет", "цвет", None)], "code string, name string, spec string, mul double")
    specs = shape.spec_map(facts.withColumn("value", F.when(F.col("code") == "weight", F.col("value")).otherwise(F.col("value"))), names.withColumn("mul", F.lit(None).cast("double")))
    return normalise.specs_as_pairs(specs, names).select("id", "key", "value", "level")


@query("""
SELECT (SELECT count(*) FROM (SELECT * FROM nation EXCEPT ALL SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 3 THEN n_regionkey + 1 ELSE n_regionkey END FROM nation)) = 0 AS changed, (SELECT count(*) FROM (SELECT * FROM nation EXCEPT ALL SELECT * FROM nation ORDER BY n_name)) = 0 AS reordered
""")
def equal_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation")
    changed = nation.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")))
    both = reports.same_tables(nation, changed).select(F.col("same").alias("changed"))
    return both.crossJoin(reports.same_tables(nation, nation.orderBy("n_name")).select(F.col("same").alias("reordered")))
