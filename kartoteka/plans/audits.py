"""Queries that run the audit, derivation and web operators on the star-schema tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.operators import audit, derive, facets, match
from kartoteka.plans.catalog import _part_facts, _strip_sql, _table, query
from kartoteka.sources import web


@query("""
WITH t AS (SELECT *, md5('0:' || event_id) AS h FROM events), u AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY h, event_id) AS turn FROM t)
SELECT event_id, event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY turn, h, event_id) AS place FROM u QUALIFY place <= 5
""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return audit.stratified_sample(rows, "event_type", "user_id", "event_id", 5).withColumn("place", F.col("place").cast("long"))


@query("""
WITH f AS (SELECT o_custkey AS id, 'priority' AS code, min(o_orderpriority) AS value FROM orders GROUP BY 1), p AS (SELECT c_custkey AS id, code, d FROM customer, (VALUES ('priority', '3-MEDIUM'), ('segment', 'OTHER')) t(code, d))
SELECT id, code, coalesce(value, d) AS value, CASE WHEN value IS NOT NULL THEN 'fact' ELSE 'default' END AS origin FROM f FULL JOIN p USING (id, code)
""")
def default_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("value")).withColumn("code", F.lit("priority"))
    products = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    typical = spark.createDataFrame([("priority", "3-MEDIUM"), ("segment", "OTHER")], "code string, value string")
    return derive.fill_defaults(facts, products, typical)


_SIZE_SQL = "CASE WHEN p_size >= 45 THEN '45+' WHEN p_size >= 20 AND p_size < 40 THEN '20-40' WHEN p_size >= 10 AND p_size < 25 THEN '10-25' WHEN p_size >= 0 AND p_size < 10 THEN '0-10' END"


@query(f"""
WITH e AS (SELECT p_partkey AS id, {_SIZE_SQL} AS expected FROM part), a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN '0-10' ELSE {_SIZE_SQL} END AS assigned FROM part)
SELECT coalesce(a.id, e.id) AS id, 'size' AS code, assigned, expected FROM (SELECT * FROM a WHERE assigned IS NOT NULL) a FULL JOIN (SELECT * FROM e WHERE expected IS NOT NULL) e ON a.id = e.id AND assigned = expected WHERE assigned IS NULL OR expected IS NULL
""")
def wrong_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, attributes = _part_facts(spark, sf_dir)
    sizes = facts.filter("code = 'size'")
    assigned = facets.facet_labels(sizes, attributes).select("id", "code", F.when(F.col("id") % 7 == 0, "0-10").otherwise(F.col("label")).alias("label")).filter("label is not null")
    return audit.wrong_labels(assigned, sizes, attributes)


def _told_sizes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part").filter("p_size is not null")
    told = part.select(F.col("p_partkey").alias("id"), F.format_string("weighs %d kg, %d.5 cm wide, %d cm high", "p_size", "p_size", F.col("p_size") + F.col("p_partkey") % 3).alias("text"))
    facts = part.select(F.col("p_partkey").alias("id"), F.explode(F.array(F.struct(F.col("p_size").cast("double").alias("number"), F.lit("kg").alias("unit")), F.struct(F.col("p_size").cast("double").alias("number"), F.lit("cm").alias("unit")))).alias("f")).select("id", "f.*")
    return told, facts


@query("""
SELECT p_partkey AS id, p_size + 0.5::DOUBLE AS number, 'cm' AS unit FROM part WHERE p_size IS NOT NULL
UNION ALL SELECT p_partkey, (p_size + p_partkey % 3)::DOUBLE, 'cm' FROM part WHERE p_size IS NOT NULL AND p_partkey % 3 <> 0
""")
def unverified_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, facts = _told_sizes(spark, sf_dir)
    return audit.unverified_measures(told, "id", "text", facts)


@query("""
WITH m AS (SELECT p_partkey AS id, 'cm' AS unit, p_size + 0.5::DOUBLE AS number, p_size::DOUBLE AS fact FROM part UNION ALL SELECT p_partkey, 'cm', (p_size + p_partkey % 3)::DOUBLE, p_size::DOUBLE FROM part)
SELECT * FROM m WHERE abs(number - fact) > greatest(0.05, abs(fact) * 0.01)
""")
def measure_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    told, facts = _told_sizes(spark, sf_dir)
    return audit.measure_mismatches(told, "id", "text", facts)


@query("""
WITH v AS (SELECT DISTINCT p_type AS k, p_name AS v FROM part UNION SELECT DISTINCT p_type, split_part(p_name, ' ', 1 + p_partkey % 2) FROM part WHERE p_size < 10 UNION SELECT DISTINCT p_type, upper(p_name) FROM part WHERE p_size = 1),
f AS (SELECT k, v, replace(lower(v), ' ', '') AS f, lower(v) AS n FROM v)
SELECT a.k AS p_type, a.v AS a, b.v AS b, 'same' AS how FROM f a JOIN f b ON a.k = b.k AND a.f = b.f AND a.v < b.v
UNION ALL SELECT a.k, a.v, b.v, 'inside' FROM f a JOIN f b ON a.k = b.k AND a.v <> b.v AND (' ' || b.n || ' ') LIKE ('% ' || a.n || ' %') AND length(b.n) > length(a.n)
""")
def likely_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    part_of = F.when(F.col("p_partkey") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    rows = part.select("p_type", "p_name").unionByName(part.filter("p_size < 10").select("p_type", part_of.alias("p_name"))).unionByName(part.filter("p_size = 1").select("p_type", F.upper("p_name").alias("p_name")))
    return audit.likely_repeats(rows, "p_type", "p_name")


@query("""
WITH v AS (SELECT DISTINCT p_type, p_name AS v FROM part UNION SELECT DISTINCT p_type, upper(p_name) FROM part WHERE p_size < 5 UNION SELECT DISTINCT p_type, replace(p_name, ' ', '-') FROM part WHERE p_size < 3)
SELECT p_type, min(v) AS representative, count(*) AS spellings, string_agg(v, '|' ORDER BY v) AS members FROM v GROUP BY p_type, regexp_replace(lower(v), '[ -]', '', 'g') HAVING count(*) > 1
""")
def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    rows = part.select("p_type", "p_name").unionByName(part.filter("p_size < 5").select("p_type", F.upper("p_name").alias("p_name"))).unionByName(part.filter("p_size < 3").select("p_type", F.replace("p_name", F.lit(" "), F.lit("-")).alias("p_name")))
    groups = audit.repeat_groups(rows, "p_type", "p_name")
    return groups.groupBy("p_type", "representative").agg(F.count("*").alias("spellings"), F.array_join(F.array_sort(F.collect_list("member")), "|").alias("members"))


@query("""
SELECT c_custkey AS id, 'in_debt' AS error FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'odd_segment' FROM customer WHERE c_mktsegment IN ('FURNITURE', 'MACHINERY')
UNION ALL SELECT c_custkey, 'no_name' FROM customer WHERE coalesce(trim(c_name), '') = ''
""")
def rule_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"in_debt": F.col("c_acctbal") < 0, "odd_segment": F.col("c_mktsegment").isin("FURNITURE", "MACHINERY"), "no_name": F.trim(F.coalesce("c_name", F.lit(""))) == ""}
    return audit.rule_errors(_table(spark, sf_dir, "customer"), "c_custkey", rules)


@query("""
WITH t AS (SELECT * FROM (VALUES ('F', 'A'), ('O', 'B'), ('P', 'B')) x(code, tier)), h AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) FILTER (tier = 'A') AS a, count(DISTINCT o_orderstatus) FILTER (tier = 'B') AS b FROM orders JOIN t ON code = o_orderstatus GROUP BY 1)
SELECT c_custkey AS id, 1 - coalesce(a, 0) AS missing_a, 2 - coalesce(b, 0) AS missing_b, (2 - coalesce(b, 0)) * 1000 + 1 - coalesce(a, 0) AS priority FROM customer LEFT JOIN h ON id = c_custkey
""")
def enrichment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code"), F.lit("x").alias("value"))
    tiers = spark.createDataFrame([("F", "A"), ("O", "B"), ("P", "B")], "code string, tier string")
    return audit.enrichment_order(facts, _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), tiers)


@query(r"""
WITH u AS (SELECT page_id % 5 AS query, page_id AS place,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|gclid|yclid|fbclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '') AS url FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^(?:https?)://([^/:?#]+)', 1)), '^www\.', '') AS host FROM u)
SELECT query, host, place, url FROM h WHERE regexp_matches(url, '^https?://[^/]+/.+') AND host <> '' QUALIFY row_number() OVER (PARTITION BY query, host ORDER BY place) = 1
""")
def accepted_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query"), F.col("page_id").alias("place"), "url")
    return web.accepted_sources(links, "query").select("query", "host", "place", "url")


@query(r"""
WITH u AS (SELECT page_id % 5 AS query, page_id AS place,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '(?i)([?&])(?:utm_[a-z]+|gclid|yclid|fbclid)=[^&]*', '\1', 'g'), '[?&]+$', ''), '/$', '') AS url FROM pages),
h AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^(?:https?)://([^/:?#]+)', 1)), '^www\.', '') AS host FROM u)
SELECT query, host, place, url FROM h WHERE regexp_matches(url, '^https?://[^/]+/.+') AND host <> '' QUALIFY row_number() OVER (PARTITION BY query, host ORDER BY place) = 1
""")
def accepted_sources_of_all_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _table(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("query"), F.col("page_id").alias("place"), "url")
    return web.accepted_sources(links, "query").select("query", "host", "place", "url")


@query(f"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS t FROM pages)
SELECT page_id, url, {_strip_sql('t')} AS title, count(*) AS cnt FROM l GROUP BY ALL
""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = web.page_links(_table(spark, sf_dir, "pages").select("page_id", "html"), "html")
    return links.groupBy("page_id", "url", "title").agg(F.count("*").alias("cnt"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 30 THEN 'large' WHEN p_type = 'PROMO' THEN 'offer' END AS grade, CASE WHEN p_size >= 30 THEN 'pallet' WHEN p_retailprice > 1000 THEN 'insured' END AS shipping FROM part
""")
def derived_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        ("grade", F.col("p_size") >= 30, F.lit("large")),
        ("grade", F.col("p_type") == "PROMO", F.lit("offer")),
        ("shipping", F.col("grade") == "large", F.lit("pallet")),
        ("shipping", F.col("p_retailprice") > 1000, F.lit("insured")),
    ]
    return derive.apply_rules(_table(spark, sf_dir, "part"), rules).select("p_partkey", "grade", "shipping")


@query("""
SELECT p_partkey, p_size::DOUBLE AS width, abs(p_size - (p_size + p_partkey % 4)) > 0.05 * greatest(p_size, p_size + p_partkey % 4) AS mismatch FROM part WHERE p_size IS NOT NULL
""")
def reconciled_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    compound = (F.col("p_size") + F.col("p_partkey") % 4).cast("double")
    both = derive.reconcile_size(F.col("p_size").cast("double"), compound)
    return _table(spark, sf_dir, "part").filter("p_size is not null").select("p_partkey", both.alias("s")).select("p_partkey", F.col("s.value").alias("width"), "s.mismatch")


@query("""
WITH t AS (SELECT p_partkey AS id, p_name, p_partkey % 3 = 0 AS denied FROM part)
SELECT id, 'finish' AS code, split_part(p_name, ' ', 1) AS canon FROM t WHERE NOT denied
UNION ALL SELECT id, 'kind', 'fastener' FROM t WHERE split_part(p_name, ' ', 2) IN ('bolt', 'screw', 'nut')
""")
def value_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    texts = part.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "not ").otherwise("A "), "p_name", F.lit(", boxed.")).alias("text"))
    finishes = part.select(F.lit("finish").alias("code"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("alias")).distinct().withColumn("canon", F.col("alias"))
    kinds = spark.createDataFrame([("kind", a, "fastener") for a in ("bolt", "screw", "nut")], "code string, alias string, canon string")
    return audit.value_claims(texts, "id", "text", finishes.unionByName(kinds))


@query("""
SELECT p_partkey, 'ga-b' || p_partkey || 'x99' AS model, 'ART-' || p_partkey AS article, CASE WHEN p_partkey % 2 = 0 THEN 'pro' ELSE '' END AS variant FROM part
""")
def product_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Fridge "), "p_name", F.lit(" GА-B"), "p_partkey", F.lit("x99 "), F.when(F.col("p_partkey") % 2 == 0, "Pro ").otherwise(""), F.lit("(ART-"), "p_partkey", F.lit(")"))
    found = derive.identity(F.regexp_replace(name, "\\(ART", "(ART"), F.lit("LG"))
    return _table(spark, sf_dir, "part").select("p_partkey", found.alias("i")).select("p_partkey", F.col("i.model").alias("model"), F.col("i.article").alias("article"), F.array_join("i.variant", ",").alias("variant"))


@query("""
WITH c AS (SELECT p_type, p_name || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 's' ELSE ',' END AS v FROM part), n AS (SELECT p_type, v, regexp_replace(v, '[s,]$', '') AS stem, count(*) AS n FROM c GROUP BY ALL)
SELECT p_type, v, first_value(v) OVER (PARTITION BY p_type, stem ORDER BY n DESC, length(v), v) AS canon FROM n
""")
def unified_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = _table(spark, sf_dir, "part").select("p_type", F.concat("p_name", F.when(k == 0, "").when(k == 1, "s").otherwise(",")).alias("v"))
    return match.unify_values(rows, "p_type", "v")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Встраиваемая' WHEN 3 THEN NULL ELSE 'Отдельностоящая' END AS install, CASE p_partkey % 4 WHEN 0 THEN 'Вертикальная' WHEN 2 THEN 'Фронтальная' END AS load_type, CASE p_partkey % 4 WHEN 0 THEN 'Полуавтоматическая' WHEN 2 THEN 'Автоматическая' END AS washer_type,
    CASE p_partkey % 4 WHEN 1 THEN 'Снизу' END AS freezer_pos, CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size > 25 THEN '2' ELSE '3' END END AS chambers, CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size > 25 THEN 'Двухкамерный' ELSE 'given' END END AS fridge_type,
    CASE p_partkey % 4 WHEN 1 THEN CASE WHEN p_size > 25 THEN '2' END END AS doors FROM part WHERE p_size IS NOT NULL
""")
def derived_appliances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, large = F.col("p_partkey") % 4, F.col("p_size") > 25
    said = F.when(k == 0, "Стиральная машина, полуавтомат. Загрузка вертикальная. Установка: встраиваемая").when(k == 1, F.concat(F.when(large, "Двухкамерный").otherwise("Трёхкамерный"), F.lit(" холодильник, морозильная камера снизу "), "p_name")).when(k == 2, F.concat(F.lit("Стиральная машина "), "p_name")).otherwise("Переходник")
    kind = F.when(k == 1, "fridge").when(k == 3, "accessory").otherwise("washer")
    cards = _table(spark, sf_dir, "part").filter("p_size is not null").select("p_partkey", said.alias("text"), kind.alias("kind"), F.when((k == 1) & ~large, "given").alias("fridge_type"))
    return derive.derive_appliance(cards, "text", "kind").drop("text", "kind")
