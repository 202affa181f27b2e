"""Queries that run the catalog operators on the star-schema tables, each with SQL for its result.

Every query works on whole tables. Sums are of whole cents so that their order
does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import buckets, text, values
from kartoteka.operators import facets, match, pairs, reports, resolve, shape

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Registers a query under its function's name with the SQL that gives the same rows."""

    def register(function):
        QUERIES[function.__name__] = function
        ORACLE_SQL[function.__name__] = sql
        return function

    return register


#: How SQL writes number_label of an expression.
def _label_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace(format('{{:.3f}}', ({x})::DOUBLE), '(\.\d*?)0+$', '\1'), '\.$', '')"


def _magnitude_sql(x: str) -> str:
    return f"pow(10.0, floor(log10({x})))"


def _nice_step_sql(span: str) -> str:
    rough = f"(({span}) / 8.0)"
    steps = " ".join(f"WHEN {rough} <= {n} * {_magnitude_sql(rough)} * 1.000001 THEN {n} * {_magnitude_sql(rough)}" for n in (1.0, 2.0, 2.5, 5.0, 10.0))
    return f"CASE WHEN coalesce({span}, 0) <= 0 THEN 1.0 {steps} ELSE 10 * {_magnitude_sql(rough)} END"


@query(f"""
WITH p AS (SELECT p_brand, CASE WHEN p_retailprice > 0 THEN p_retailprice END AS price FROM part),
s AS (SELECT count(*) FILTER (p_brand IS NULL) AS nb, count(*) FILTER (price IS NULL) AS np, min(price) AS mn, max(price) AS mx FROM p)
SELECT 'brand' AS facet, p_brand AS value, count(*) AS cnt, NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS step FROM p WHERE p_brand IS NOT NULL GROUP BY p_brand
UNION ALL SELECT 'brand', 'without_value', nb, NULL, NULL, NULL FROM s
UNION ALL SELECT 'price', 'without_price', np, mn, mx,
    CASE WHEN mx - mn > 0 THEN greatest(10.0, floor((mx - mn) / 100 / {_magnitude_sql("(mx - mn) / 100")} + 0.5) * {_magnitude_sql("(mx - mn) / 100")}) END FROM s
""")
def shop_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.shop_facets(_table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


def _data_buckets_sql(table: str, key: str, value: str) -> str:
    low = "floor(v / step) * step"
    return f"""
WITH s AS (SELECT {key} AS k, {value} AS v, count(*) AS n FROM {table} WHERE {value} IS NOT NULL GROUP BY 1, 2),
g AS (SELECT k, count(*) AS different, min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS whole FROM s GROUP BY k),
w AS (SELECT k, different, whole, {_nice_step_sql("hi - lo")} AS step FROM g)
SELECT k AS {key}, CASE WHEN different <= 6 OR (step <= 1 AND whole) THEN {_label_sql("v")} ELSE {_label_sql(low)} || '-' || {_label_sql(low + " + step")} END AS label, sum(n)::BIGINT AS cnt
FROM s JOIN w USING (k) GROUP BY 1, 2
"""


@query(_data_buckets_sql("lineitem", "l_returnflag", "l_quantity"))
def quantity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.data_buckets(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


@query(_data_buckets_sql("part", "p_brand", "p_retailprice"))
def price_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.data_buckets(_table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


_GRID = [("0-10", 0.0, 10.0), ("10-25", 10.0, 25.0), ("20-40", 20.0, 40.0), ("45+", 45.0, None)]


def _grid() -> Column:
    return F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).cast("double").alias("min"), F.lit(c).cast("double").alias("max")) for a, b, c in _GRID])


@query("""
SELECT l_linestatus, CASE WHEN l_quantity >= 45 THEN '45+' WHEN l_quantity >= 20 AND l_quantity < 40 THEN '20-40'
    WHEN l_quantity >= 10 AND l_quantity < 25 THEN '10-25' WHEN l_quantity >= 0 AND l_quantity < 10 THEN '0-10' END AS label, count(*) AS cnt
FROM lineitem GROUP BY ALL
""")
def explicit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = buckets.match_bucket(F.col("l_quantity"), _grid())
    return _table(spark, sf_dir, "lineitem").groupBy("l_linestatus", label.alias("label")).agg(F.count("*").alias("cnt"))


@query("""
SELECT p_type, CASE WHEN p_size IN (1, 5, 10, 20, 40) THEN p_size::VARCHAR WHEN p_size <= 3 THEN '1' WHEN p_size <= 7 THEN '5' WHEN p_size <= 15 THEN '10'
    WHEN p_size <= 30 THEN '20' ELSE '40' END AS label, count(*) AS cnt
FROM part WHERE p_size IS NOT NULL GROUP BY ALL
""")
def size_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = buckets.snap_int_enum(F.col("p_size"), F.array(*[F.lit(x) for x in (1, 5, 10, 20, 40)]))
    return _table(spark, sf_dir, "part").filter("p_size is not null").groupBy("p_type", label.alias("label")).agg(F.count("*").alias("cnt"))


def _part_facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part")
    facts = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.lit("size").alias("code"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit("price").alias("code"), F.col("p_retailprice").cast("string").alias("value")), F.struct(F.lit("type").alias("code"), F.col("p_type").alias("value")))).alias("f")).select("id", "f.*").filter("value is not null")
    none = F.array().cast(buckets.BUCKET_TYPE)
    row = lambda code, kind, step, grid: F.struct(F.lit(code).alias("code"), F.lit(kind).alias("kind"), F.lit(step).cast("double").alias("step"), F.lit(0.0).alias("origin"), grid.alias("buckets"), F.array().cast("array<int>").alias("int_values"))
    attributes = spark.range(1).select(F.explode(F.array(row("size", "range", None, _grid()), row("price", "range", 250.0, none), row("type", "enum", None, none))).alias("a")).select("a.*")
    return facts, attributes


@query(f"""
WITH l AS (
    SELECT 'size' AS code, CASE WHEN p_size >= 45 THEN '45+' WHEN p_size >= 20 AND p_size < 40 THEN '20-40' WHEN p_size >= 10 AND p_size < 25 THEN '10-25' WHEN p_size >= 0 AND p_size < 10 THEN '0-10' END AS label FROM part
    UNION ALL SELECT 'price', {_label_sql("floor(p_retailprice / 250) * 250")} || '-' || {_label_sql("floor(p_retailprice / 250) * 250 + 250")} FROM part
    UNION ALL SELECT 'type', p_type FROM part
), c AS (SELECT code, label, count(*) AS cnt FROM l WHERE label IS NOT NULL GROUP BY ALL),
k AS (SELECT * FROM (VALUES ('size', '0-10'), ('size', '10-25'), ('size', '20-40'), ('size', '45+'), ('type', 'ANTIQUE'), ('price', '0-250')) t(code, label))
SELECT code, label, coalesce(cnt, 0)::BIGINT AS cnt FROM k FULL JOIN c USING (code, label)
""")
def facets_with_zero_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, attributes = _part_facts(spark, sf_dir)
    known = [("size", "0-10"), ("size", "10-25"), ("size", "20-40"), ("size", "45+"), ("type", "ANTIQUE"), ("price", "0-250")]
    catalog = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(x).alias("label")) for c, x in known])).alias("k")).select("k.*")
    return facets.dictionary_facets(facts, attributes, catalog)


@query(f"""
WITH l AS (
    SELECT p_partkey AS id, 'size' AS code, p_size::VARCHAR AS value, CASE WHEN p_size >= 45 THEN '45+' WHEN p_size >= 20 AND p_size < 40 THEN '20-40' WHEN p_size >= 10 AND p_size < 25 THEN '10-25' WHEN p_size >= 0 AND p_size < 10 THEN '0-10' END AS label FROM part
    UNION ALL SELECT p_partkey, 'type', p_type, p_type FROM part
)
SELECT id, max(label) FILTER (code = 'size') AS size, max(label) FILTER (code = 'type') AS type, count(*) FILTER (label IS NULL) AS gaps FROM l WHERE value IS NOT NULL GROUP BY id
""")
def assigned_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, attributes = _part_facts(spark, sf_dir)
    out = facets.assign_filters(facts.filter("code <> 'price'"), attributes)
    pick = lambda c: F.get(F.element_at("filters", F.lit(c)), F.lit(0)).alias(c)
    return out.select("id", pick("size"), pick("type"), F.size("gaps").cast("long").alias("gaps"))


@query("""
WITH c AS (
    SELECT 'status' AS code, o_orderstatus AS label, count(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'urgent', 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'
), t AS (SELECT count(*) AS total FROM orders),
s AS (SELECT code, sum(cnt)::DOUBLE / any_value(total) AS coverage, max(cnt)::DOUBLE / any_value(total) AS top_share, count(*) AS labels FROM c, t WHERE cnt > 0 GROUP BY code)
SELECT *, concat_ws(',', CASE WHEN coverage < 0.7 THEN 'coverage' END, CASE WHEN top_share > 0.95 THEN 'dominant' END, CASE WHEN labels > 8 THEN 'buckets' END) AS warning FROM s
""")
def facet_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    facts = F.array(*[F.struct(F.lit(c).alias("code"), x.alias("label")) for c, x in (("status", F.col("o_orderstatus")), ("priority", F.col("o_orderpriority")), ("year", F.year("o_orderdate").cast("string")), ("urgent", F.when(F.col("o_orderpriority") == "1-URGENT", "urgent")))])
    counts = orders.select(F.explode(facts).alias("f")).select("f.*").filter("label is not null").groupBy("code", "label").agg(F.count("*").alias("cnt"))
    return facets.facet_warnings(counts, orders.agg(F.count("*").alias("total")))


_SPELLED_SQL = "CASE c_custkey % 4 WHEN 0 THEN upper(c_mktsegment) WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN replace(c_mktsegment, 'E', 'Ё') ELSE c_mktsegment || ' -' END"


@query(f"""
WITH l AS (SELECT {_SPELLED_SQL} AS label FROM customer),
c AS (SELECT regexp_replace(replace(lower(label), 'ё', 'е'), '[\\s\\x{{00A0}}\\x{{FEFF}}]|[-–—.,;:"''«»()]', '', 'g') AS folded, label, count(*) AS n FROM l GROUP BY ALL)
SELECT folded, first(label ORDER BY n DESC, length(label), label) AS label, sum(n)::BIGINT AS cnt, count(*) AS variants FROM c WHERE label IS NOT NULL GROUP BY folded
""")
def unified_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.unify_labels(_table(spark, sf_dir, "customer").select(F.expr(_SPELLED_SQL.replace("'Ё'", "'Ё'")).alias("label")), "label")


_LEVELS = {"purchase": "manufacturer", "signup": "S1", "view": "S2", "click": "S3", "error": "model"}
_RANK_SQL = "CASE event_type WHEN 'purchase' THEN 50 WHEN 'signup' THEN 35 WHEN 'view' THEN 20 WHEN 'click' THEN 10 WHEN 'error' THEN 5 ELSE 0 END"


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.create_map(*[F.lit(x) for p in _LEVELS.items() for x in p]), F.col("event_type"))
    events = _table(spark, sf_dir, "events").withColumn("level", level).withColumn("rank", resolve.source_rank(F.col("level")))
    return events.select("user_id", F.col("event_id").alias("seq"), "level", "rank", F.floor("value").cast("long").alias("value"))


@query(f"""
WITH e AS (SELECT *, {_RANK_SQL} AS rank FROM events)
SELECT user_id, event_id AS seq, rank, floor(value)::BIGINT AS value, CASE WHEN rank >= 45 THEN 1.0 WHEN rank >= 30 THEN 0.9 WHEN rank >= 15 THEN 0.7 WHEN rank >= 5 THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence
FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, event_id) = 1
""")
def resolved_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = resolve.resolve_facts(_ranked_events(spark, sf_dir), ["user_id"], "rank", "seq")
    return best.select("user_id", "seq", F.col("rank").cast("int").alias("rank"), "value", resolve.confidence(F.col("rank")).alias("confidence"))


@query(f"""
WITH e AS (SELECT user_id, event_id AS seq, {_RANK_SQL} AS rank, floor(value)::BIGINT AS value FROM events),
w AS (SELECT *, max({{'r': rank, 's': -seq, 'v': value}}) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e)
SELECT user_id, seq, st.v AS standing, value AS incoming, CASE WHEN rank > st.r THEN value ELSE st.v END AS selected, rank = st.r AS needs_review FROM w WHERE st IS NOT NULL AND st.v <> value
""")
def conflict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.conflict_log(_ranked_events(spark, sf_dir), ["user_id"], "rank", "seq", "value")


@query("SELECT event_id, ts, user_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 UNION ALL SELECT event_id, ts, user_id, event_type, value FROM events WHERE user_id IS NULL")
def ledger_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return resolve.last_wins(rows, "user_id", ["ts", "event_id"])


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus IN ('F', 'P'))")
def todo_after_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    ledger = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(status == "F", "yes").alias("enriched"), F.when(status == "P", "short").alias("skipped"))
    return reports.todo(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ledger, "c_custkey")


@query(r"""
WITH u AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^(?:https?)://([^/:?#]+)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|gclid|yclid|fbclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '') AS url FROM pages)
SELECT host, page_id, url FROM u WHERE host <> '' QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1
""")
def one_url_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select(text.url_host(F.col("url")).alias("host"), "page_id", text.canonical_url(F.col("url")).alias("url"))
    return resolve.first_per(pages.filter("host <> ''"), ["host"], ["page_id"])


_TAGS = ("ul", "li", "p", "b", "h1", "table", "tr", "td")


@query("SELECT page_id, concat_ws(',', " + ", ".join(f"CASE WHEN len(regexp_extract_all(lower(html), '<{t}[\\s>]')) <> len(regexp_extract_all(lower(html), '</{t}>')) THEN '{t}' END" for t in _TAGS) + ") AS unbalanced FROM pages")
def html_tag_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.concat_ws(",", pairs.tag_balance(F.col("html"), _TAGS)).alias("unbalanced"))


def _strip_sql(x: str) -> str:
    for name, stands_for in text.ENTITIES.items():
        x = f"regexp_replace({x}, '(?i)&{name};?', '{stands_for}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '[\s\x{{00A0}}\x{{FEFF}}]+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, length({_strip_sql('html')})::INT AS chars, md5({_strip_sql('html')}) AS digest FROM pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t")).select("page_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query(f"""
WITH c AS (SELECT page_id, unnest(CASE WHEN regexp_matches(html, '(?i)<li[\\s>/]') THEN regexp_extract_all(html, '(?is)<li(?:\\s[^>]*)?>(.*?)</li>', 1) ELSE string_split_regex(html, '(?i)<br\\s*/?>') END) AS x FROM pages)
SELECT page_id, count(*)::INT AS items, string_agg({_strip_sql('x')}, '|' ORDER BY {_strip_sql('x')}) AS texts FROM c WHERE {_strip_sql('x')} <> '' GROUP BY page_id
""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "pages").select("page_id", text.html_chunks(F.col("html")).alias("c"))
    return chunks.filter(F.size("c") > 0).select("page_id", F.size("c").alias("items"), F.array_join(F.array_sort("c"), "|").alias("texts"))


@query(f"""
SELECT CASE WHEN regexp_matches(coalesce(html, ''), '(?i)<li[\\s>/]') THEN 'LI' WHEN regexp_matches(coalesce(html, ''), '(?i)<br[\\s>/]') THEN 'BR' WHEN {_strip_sql("coalesce(html, '')")} <> '' THEN 'OTHER' ELSE 'EMPTY' END AS format, count(*) AS cnt FROM pages GROUP BY 1
""")
def annotation_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.format_counts(_table(spark, sf_dir, "pages"), "html")


_GRAMS_SQL = "list_distinct(list_transform(range(1, length(t) + 2), lambda i: substr(' ' || t || ' ', i, 2)))"


@query(f"""
WITH k AS (SELECT n_name AS key, lower(n_name) AS t FROM nation), s AS (SELECT r_name AS synonym, r_regionkey AS code, lower(r_name) AS t FROM region
    UNION ALL SELECT n_name || ' ' || n_name, n_nationkey, lower(n_name || ' ' || n_name) FROM nation),
kg AS (SELECT key, length(t) AS len, {_GRAMS_SQL} AS g FROM k), sg AS (SELECT synonym, code, length(t) AS len, {_GRAMS_SQL} AS g FROM s)
SELECT key, synonym, code, 2 * len(list_intersect(kg.g, sg.g)) / (len(kg.g) + len(sg.g))::DOUBLE AS likeness FROM kg, sg
WHERE abs(kg.len - sg.len) <= 12 AND 2 * len(list_intersect(kg.g, sg.g)) / (len(kg.g) + len(sg.g))::DOUBLE >= 0.5 AND len(list_intersect(kg.g, sg.g)) > 0
""")
def key_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    double = F.concat_ws(" ", "n_name", "n_name")
    synonyms = region.select(F.col("r_name").alias("synonym"), F.col("r_regionkey").alias("code")).unionByName(nation.select(double.alias("synonym"), F.col("n_nationkey").alias("code")))
    return match.pair_likeness(nation.select(F.col("n_name").alias("key")), synonyms.withColumn("order", F.lit(0)), 0.5).drop("order")


@query(f"""
WITH k AS (SELECT DISTINCT p_name AS key FROM part), w AS (SELECT key, list_sort(list_distinct(string_split(key, ' '))) AS bag FROM k),
s AS (SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS synonym, p_name AS code FROM part WHERE p_size >= 40 UNION SELECT p_name, p_name FROM part WHERE p_size < 5),
e AS (SELECT key, 'exact' AS how FROM k WHERE key IN (SELECT synonym FROM s)),
b AS (SELECT key, 'words' AS how FROM w WHERE key NOT IN (SELECT key FROM e) AND bag IN (SELECT list_sort(list_distinct(string_split(synonym, ' '))) FROM s)),
l AS (SELECT key, 'blacklist' AS how FROM k WHERE key NOT IN (SELECT key FROM e UNION ALL SELECT key FROM b) AND (key LIKE '% bolt' OR key = 'bolt' OR key LIKE 'bolt %')),
r AS (SELECT key, length(t) AS len, {_GRAMS_SQL} AS g FROM (SELECT key, lower(key) AS t FROM k) WHERE key NOT IN (SELECT key FROM e UNION ALL SELECT key FROM b UNION ALL SELECT key FROM l)),
sg AS (SELECT code, length(t) AS len, {_GRAMS_SQL} AS g FROM (SELECT *, lower(synonym) AS t FROM s)),
p AS (SELECT key, code, 2 * len(list_intersect(r.g, sg.g)) / (len(r.g) + len(sg.g))::DOUBLE AS likeness FROM r, sg WHERE abs(r.len - sg.len) <= 12),
f AS (SELECT key, 'fuzzy' AS how FROM p WHERE likeness >= 0.9 GROUP BY key)
SELECT key, coalesce(how, 'unmapped') AS how FROM k LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM l UNION ALL SELECT * FROM f) USING (key)
""")
def matched_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    synonyms = part.filter("p_size >= 40").select(turned.alias("synonym"), F.col("p_name").alias("code")).unionByName(part.filter("p_size < 5").select(F.col("p_name").alias("synonym"), F.col("p_name").alias("code"))).distinct()
    barred = spark.range(1).select(F.lit("bolt").alias("phrase"))
    return match.match_keys(part.select(F.col("p_name").alias("key")), synonyms.withColumn("order", F.lit(0)), barred).select("key", "how")


@query(f"""
WITH k AS (SELECT DISTINCT p_name AS key FROM part),
s AS (SELECT left(p_name, length(p_name) - 1) AS synonym, p_name AS code, 3 * min(p_partkey) AS o FROM part GROUP BY p_name UNION ALL SELECT p_name, p_name, 3 * min(p_partkey) + 1 FROM part WHERE p_size < 5 GROUP BY p_name
    UNION ALL SELECT split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1), p_name, 3 * min(p_partkey) + 2 FROM part WHERE p_size < 8 GROUP BY p_name),
e AS (SELECT key, arg_min(code, o) AS code, 'exact' AS how FROM k JOIN s ON key = synonym GROUP BY key),
b AS (SELECT key, arg_min(code, o) AS code, 'words' AS how FROM k JOIN s ON list_sort(list_distinct(string_split(key, ' '))) = list_sort(list_distinct(string_split(synonym, ' '))) WHERE key NOT IN (SELECT key FROM e) GROUP BY key),
l AS (SELECT key, NULL AS code, 'blacklist' AS how FROM k WHERE key NOT IN (SELECT key FROM e UNION ALL SELECT key FROM b) AND (key LIKE '% bolt' OR key = 'bolt' OR key LIKE 'bolt %')),
r AS (SELECT key, length(t) AS len, {_GRAMS_SQL} AS g FROM (SELECT key, lower(key) AS t FROM k) WHERE key NOT IN (SELECT key FROM e UNION ALL SELECT key FROM b UNION ALL SELECT key FROM l)),
sg AS (SELECT code, o, length(t) AS len, {_GRAMS_SQL} AS g FROM (SELECT *, lower(synonym) AS t FROM s)),
p AS (SELECT key, code, o, 2 * len(list_intersect(r.g, sg.g)) / (len(r.g) + len(sg.g))::DOUBLE AS likeness FROM r, sg WHERE abs(r.len - sg.len) <= 12),
f AS (SELECT key, code, 'fuzzy' AS how FROM p WHERE likeness >= 0.82 QUALIFY row_number() OVER (PARTITION BY key ORDER BY likeness DESC, o) = 1)
SELECT key, code, coalesce(how, 'unmapped') AS how FROM k LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM l UNION ALL SELECT * FROM f) USING (key)
""")
def likely_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    turned = F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))
    kinds = [(part, F.expr("left(p_name, length(p_name) - 1)")), (part.filter("p_size < 5"), F.col("p_name")), (part.filter("p_size < 8"), turned)]
    synonyms = [rows.groupBy("p_name").agg((3 * F.min("p_partkey") + i).alias("order")).select(name.alias("synonym"), F.col("p_name").alias("code"), "order") for i, (rows, name) in enumerate(kinds)]
    barred = spark.range(1).select(F.lit("bolt").alias("phrase"))
    return match.match_keys(part.select(F.col("p_name").alias("key")), synonyms[0].unionByName(synonyms[1]).unionByName(synonyms[2]), barred, least=0.82)


@query("""
WITH b AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS brand FROM part UNION SELECT DISTINCT p_name FROM part WHERE p_size < 10)
SELECT p_partkey, p_name, (SELECT max_by(brand, length(brand)) FROM b WHERE b.brand = p_name OR b.brand = split_part(p_name, ' ', 1) OR b.brand = split_part(p_name, ' ', 2)) AS brand FROM part
""")
def brand_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    brands = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).unionByName(part.filter("p_size < 10").select(F.col("p_name").alias("b"))).distinct()
    return match.brand_in_name(part.select("p_partkey", "p_name"), "p_name", brands, "b")


@query("""
WITH f AS (SELECT doc_id AS id, 'quality' AS code, quality::VARCHAR AS value FROM labels UNION ALL SELECT doc_id, 'toxic', nullif(toxic, 0)::VARCHAR FROM labels UNION ALL SELECT doc_id, 'lang', lang FROM documents),
a AS (SELECT * FROM (VALUES ('quality'), ('toxic'), ('lang'), ('colour')) t(code)), t AS (SELECT count(*) AS total FROM documents)
SELECT code, count(DISTINCT id) AS mapped, count(DISTINCT CASE WHEN value IS NOT NULL THEN id END) AS filled, any_value(total) AS total,
    floor(count(DISTINCT CASE WHEN value IS NOT NULL THEN id END) * 1000 / any_value(total)::DOUBLE + 0.5) / 10 AS coverage
FROM a LEFT JOIN f USING (code), t GROUP BY code
""")
def attribute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fact = lambda df, code, value: df.select(F.col("doc_id").alias("id"), F.lit(code).alias("code"), value.cast("string").alias("value"))
    facts = fact(labels, "quality", F.col("quality")).unionByName(fact(labels, "toxic", F.nullif("toxic", F.lit(0)))).unionByName(fact(docs, "lang", F.col("lang")))
    attributes = spark.range(1).select(F.explode(F.array(*map(F.lit, ("quality", "toxic", "lang", "colour")))).alias("code"))
    return reports.coverage(facts, attributes, docs.agg(F.count("*").alias("total")))


@query("SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE w NOT IN (SELECT DISTINCT p_type FROM part) GROUP BY w ORDER BY cnt DESC, w LIMIT 40")
def unmapped_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word"))
    return reports.top_values(reports.filters_missing(words, part.select(F.col("p_type").alias("word")).distinct(), ["word"]), "word", 40)


@query("SELECT p_type, p_brand, count(*) AS cnt, row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_brand) AS place FROM part WHERE p_brand IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 3")
def value_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_inventory(_table(spark, sf_dir, "part"), "p_type", "p_brand", 3)


@query("""
WITH r AS (SELECT lang, toxic AS g, CASE WHEN n_chars % 5 = 0 THEN NULL ELSE (n_chars % 2)::INT END AS p FROM documents LEFT JOIN labels USING (doc_id)),
s AS (SELECT lang, count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS checkable, count(*) FILTER (g = p) AS agreed, count(*) FILTER (g = 0 AND p = 1) AS invented, count(*) FILTER (g = 1 AND coalesce(p, 0) = 0) AS missed, count(*) FILTER (g = 1 AND p = 1) AS hit FROM r GROUP BY lang)
SELECT lang, checkable, agreed, invented, missed, floor(hit * 1000 / nullif(hit + invented, 0)::DOUBLE + 0.5) / 10 AS precision, floor(hit * 1000 / nullif(hit + missed, 0)::DOUBLE + 0.5) / 10 AS recall FROM s
""")
def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    guess = F.when(F.col("n_chars") % 5 != 0, (F.col("n_chars") % 2).cast("int"))
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left").select("lang", F.col("toxic").alias("g"), guess.alias("p"))
    return reports.label_quality(rows, "lang", "g", "p")


@query("""
WITH f AS (SELECT l_orderkey AS o_orderkey, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE AS fact FROM lineitem GROUP BY 1), s AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT::DOUBLE AS spec FROM orders)
SELECT o_orderkey, CASE WHEN fact IS NULL OR spec IS NULL THEN coalesce(spec, fact) WHEN abs(spec - fact) <= greatest(100000.0, abs(fact) * 0.5) THEN spec ELSE fact END AS checked,
    CASE WHEN fact IS NULL OR spec IS NULL THEN 'unchecked' WHEN abs(spec - fact) <= greatest(100000.0, abs(fact) * 0.5) THEN 'ok' ELSE 'mismatch' END AS outcome FROM s LEFT JOIN f USING (o_orderkey)
""")
def cross_checked_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    facts = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).cast("double").alias("fact"))
    specs = _table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").cast("double").alias("spec"))
    return resolve.cross_check(specs, facts, ["o_orderkey"], "spec", "fact", 100000.0, 0.5)


@query("""
WITH a AS (SELECT o_custkey AS k, count(*)::DOUBLE AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*)::DOUBLE AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT k AS o_custkey, CASE WHEN a IS NULL OR b IS NULL OR abs(a - b) <= greatest(1.0, abs(b) * 0.02) THEN coalesce(b, a) END AS n,
    CASE WHEN a IS NOT NULL AND b IS NOT NULL AND abs(a - b) > greatest(1.0, abs(b) * 0.02) THEN 'conflict' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'text' ELSE 'attributes' END AS origin
FROM a FULL JOIN b USING (k)
""")
def merged_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    side = lambda s: orders.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"))
    return resolve.merge_facts(side("F"), side("O"), ["o_custkey"], "n", 1.0, 0.02)


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type IN ('purchase', 'signup')) AS ok, count(*) FILTER (event_type IN ('view', 'click')) AS skipped, count(*) FILTER (event_type = 'error') AS failed, sum(round(value * 100)::BIGINT)::BIGINT AS cost_cents FROM events GROUP BY user_id")
def run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "signup"), "ok").when(kind.isin("view", "click"), "skipped").when(kind == "error", "error")
    rows = _table(spark, sf_dir, "events").select("user_id", status.alias("status"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return reports.usage(rows, ["user_id"], "status", "cents")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sliding_count(_table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", 3600).drop("ts")


@query("""
WITH o AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'P') AS extra, count(*) FILTER (o_orderpriority = '1-URGENT') AS issues FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN extra > 2 THEN 'extra' WHEN extra IS NULL THEN 'missing' WHEN issues > 0 THEN 'issues' ELSE 'ok' END AS status FROM customer LEFT JOIN o ON o_custkey = c_custkey
""")
def card_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("issues"))
    cards = _table(spark, sf_dir, "customer").select("c_custkey").join(per, "c_custkey", "left").withColumn("extra", F.col("p") - 2).withColumn("missing", F.col("p").isNull().cast("int"))
    return reports.card_status(cards, "extra", "missing", "issues").select("c_custkey", "status")


@query("""
WITH c AS (SELECT event_type, user_id, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS p FROM events GROUP BY 1, 2)
SELECT event_type, sum(n)::BIGINT AS events, count(*) AS products, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) FILTER (p <= 8) AS samples FROM c GROUP BY 1
""")
def issue_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.issue_groups(_table(spark, sf_dir, "events"), "event_type", "user_id")


@query("""SELECT c_custkey, to_json({'id': c_custkey, 'card': {'title': c_name, 'tags': [c_mktsegment, 'nation ' || c_nationkey]}})::VARCHAR AS card FROM customer""")
def template_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = {"id": "{{c_custkey}}", "card": {"title": "{{c_name}}", "tags": ["{{c_mktsegment}}", "nation {{ c_nationkey }}"]}}
    return _table(spark, sf_dir, "customer").select("c_custkey", shape.from_template(template).cast("string").alias("card"))


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("last_purchase"))
    return reports.forward_fill(rows, "last_purchase", "event_id", ["user_id"])


@query(f"WITH e AS (SELECT *, {_RANK_SQL} AS rank FROM events) SELECT user_id, CASE min(rank) WHEN 50 THEN 'manufacturer' WHEN 35 THEN 'S1' WHEN 20 THEN 'S2' WHEN 10 THEN 'S3' ELSE 'model' END AS level FROM e GROUP BY user_id")
def weakest_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.weakest_level(_ranked_events(spark, sf_dir), ["user_id"], "level")


@query("SELECT 'n' || n_nationkey AS id, r_name || ' / ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def category_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    tree = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    tree = tree.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")))
    return shape.category_paths(tree)


@query("SELECT coalesce(c_custkey, k) AS c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer FULL JOIN (SELECT o_custkey + 1 AS k, max(o_orderpriority) AS p FROM orders GROUP BY 1) ON k = c_custkey")
def merged_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    overlay = _table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") + 1).alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"))
    return shape.merge_tables(base, overlay, "c_custkey")


@query("SELECT (SELECT count(*) FROM (SELECT * FROM region EXCEPT ALL SELECT * FROM region WHERE r_regionkey >= 0)) = 0 AS same")
def same_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region")
    return reports.same_tables(region, region.filter("r_regionkey >= 0"))


@query("SELECT p_partkey, (p_size + 40)::DOUBLE / CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1 END AS width, (p_size * 3 + 1)::DOUBLE / CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1 END AS height, 60::DOUBLE / CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 1 END AS depth FROM part WHERE p_size IS NOT NULL")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 2 == 0, " мм").otherwise(" см")
    line = F.concat(F.col("p_size") * 3 + 1, F.lit(" x "), F.col("p_size") + 40, F.lit("х60"), unit)
    parsed = values.parse_dimensions(line, F.lit("Размеры (ВхШхГ)"))
    rounded = [F.round(F.col(f"d.{c}"), 6).alias(c) for c in ("width", "height", "depth")]
    return _table(spark, sf_dir, "part").filter("p_size is not null").select("p_partkey", parsed.alias("d")).select("p_partkey", *rounded)


@query("""
WITH s AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus <> 'O') AS confirmed, count(*) FILTER (o_orderpriority = '1-URGENT') AS faults FROM orders GROUP BY 1)
SELECT o_custkey, round(greatest(0.0, least(1.0, confirmed / total::DOUBLE - faults * 0.05)), 6) AS score FROM s
""")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "O").alias("confirmed"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("faults"))
    return s.select("o_custkey", F.round(reports.quality_score(F.col("confirmed"), F.col("total"), [(F.col("faults"), 0.05)]), 6).alias("score"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN NULL WHEN 2 THEN 'true' WHEN 3 THEN 'A++' ELSE NULL END AS value,
    CASE p_partkey % 5 WHEN 1 THEN 'out_of_range' WHEN 4 THEN 'not_number' END AS reason FROM part WHERE p_size IS NOT NULL
""")
def normalised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    kind = F.when(k == 2, "boolean").when(k == 3, "class_scale").when(k == 0, "integer").otherwise("number")
    raw = F.when(k == 0, F.concat_ws(" ", "p_size", F.lit("кг"))).when(k == 1, "5 000 кг").when(k == 2, "Да, есть").when(k == 3, "класс А++").otherwise("нет данных")
    out = values.normalize_value(kind, raw, F.lit(0.0), F.lit(1000.0))
    return _table(spark, sf_dir, "part").filter("p_size is not null").select("p_partkey", out.alias("v")).select("p_partkey", "v.value", "v.reason")


FLAGSHIP = "shop_facets"
