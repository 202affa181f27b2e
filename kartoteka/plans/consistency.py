"""Queries that run the consistency and dictionary operators on the star-schema tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions.values import pick_enum
from kartoteka.operators import cards, consistency, coverage
from kartoteka.plans.cards import _case, _dictionary, _name, _of, _parts, _size, _SIZE_SQL
from kartoteka.plans.catalog import _table, query


@query("""
WITH e AS (SELECT user_id AS id, event_id, CASE event_type WHEN 'purchase' THEN 'S1' WHEN 'signup' THEN 'model' WHEN 'view' THEN 'S3' END AS level FROM events WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, event_id, NULL FROM events WHERE user_id % 3 = 0), t AS (SELECT id, bool_or(level IS NOT NULL) AS traced FROM e GROUP BY id)
SELECT event_id, id, level FROM e JOIN t USING (id) WHERE NOT traced OR level IN ('S1', 'S3')
""")
def usable_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    level = F.when(F.col("user_id") % 3 != 0, F.when(kind == "purchase", "S1").when(kind == "signup", "model").when(kind == "view", "S3"))
    facts = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"), level.alias("level"))
    return consistency.usable_facts(facts).select("event_id", "id", "level")


@query("SELECT o_orderstatus AS code, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS labels, count(DISTINCT o_custkey) AS products FROM orders GROUP BY 1")
def facets_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), "o_orderstatus").agg(F.collect_set("o_orderpriority").alias("l"))
    rows = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "l"))).alias("filters"))
    return consistency.facets_of_rows(rows, "filters").withColumn("labels", F.array_join("labels", "|"))


@query("""
WITH o AS (SELECT o_custkey AS id, o_orderstatus AS code, o_orderpriority AS value, CASE o_orderkey % 4 WHEN 0 THEN 'description' WHEN 1 THEN 'annotation' WHEN 2 THEN 'fact' ELSE 'filter' END AS surface, o_orderkey % 8 = 2 AS strong FROM orders),
p AS (SELECT *, CASE WHEN surface = 'fact' AND strong THEN 0 WHEN surface = 'annotation' THEN 1 WHEN surface = 'fact' THEN 2 WHEN surface = 'filter' THEN 3 ELSE 4 END AS place FROM o), n AS (SELECT id, code, count(DISTINCT value) = 1 AS agreed FROM p GROUP BY 1, 2)
SELECT id, code, value, surface, agreed FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id, code ORDER BY place, surface, value) = 1) JOIN n USING (id, code)
""")
def surface_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    surface = F.when(k == 0, "description").when(k == 1, "annotation").when(k == 2, "fact").otherwise("filter")
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code"), surface.alias("surface"), F.col("o_orderpriority").alias("value"), F.when(F.col("o_orderkey") % 8 == 2, "S1").otherwise("S3").alias("level"))
    return consistency.surface_truth(rows)


_TOPICS = {"bolt": "bolt|rod", "cold": "cold", "none": "никогда"}


def _topic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    noted = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" - нет; "), F.split_part("p_name", F.lit(" "), F.lit(1)))).otherwise("plain")
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("description"), noted.alias("annotation"))


@query("""
WITH c AS (SELECT p_name AS d, CASE p_partkey % 3 WHEN 2 THEN 'plain' ELSE p_name END AS a FROM part), t AS (SELECT * FROM (VALUES ('bolt', 'bolt|rod'), ('cold', 'cold'), ('none', 'никогда')) x(topic, p)),
n AS (SELECT topic, count(*) FILTER (regexp_matches(d, p)) AS mentions, count(*) FILTER (regexp_matches(d, p) AND regexp_matches(a, p)) AS ok FROM t, c GROUP BY topic)
SELECT topic, mentions, ok, coalesce(floor((mentions - ok) * 100 / nullif(mentions, 0)::DOUBLE + 0.5), 0)::BIGINT AS problem FROM n
""")
def topic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.topic_report(_topic_cards(spark, sf_dir), _TOPICS, "id", "description", "annotation")


@query("""
WITH c AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 3 AS k FROM part)
SELECT id, 'bolt' AS topic, CASE WHEN k = 1 THEN 'contradiction' ELSE 'fabrication' END AS kind FROM c WHERE b IN ('bolt', 'rod') AND k > 0 UNION ALL SELECT id, 'cold', 'fabrication' FROM c WHERE a = 'cold' AND k = 2
""")
def topic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.topic_issues(_topic_cards(spark, sf_dir), _TOPICS, "id", "description", "annotation")


@query(f"SELECT p_partkey, {_case("'praise'", "'negative_without_source'", "''", "'praise,negative_without_source'", "''", "''")} AS kinds FROM part")
def claim_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(F.concat(_name(), F.lit(" не имеет аналогов")), F.concat(F.lit("Wi-Fi здесь нет, "), _name()), _name(), F.concat(F.lit("Лучшая в мире "), _name(), F.lit(". Не поддерживает wifi")), "Wi-Fi есть", F.lit(None))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(consistency.claim_issues(raw), ",").alias("kinds"))


@query("SELECT p_partkey AS id, 'install_width' AS code, 'width' AS other, p_type AS raw FROM part WHERE p_partkey % 4 = 0")
def shared_raw_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    side = lambda code, raw: part.select(F.col("p_partkey").alias("id"), F.lit(code).alias("code"), raw.alias("raw"))
    facts = side("width", F.col("p_type")).unionByName(side("install_width", F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).otherwise(F.col("p_name")))).unionByName(side("depth", F.col("p_type")))
    return consistency.shared_raw(facts, [("install_width", "width")])


@query("""
WITH f AS (SELECT o_custkey AS id, o_orderstatus AS code, bool_or(o_orderkey % 2 = 0) AS good, count(DISTINCT o_orderpriority) > 4 AS open FROM orders GROUP BY 1, 2)
SELECT id, count(*) FILTER (good AND NOT open) AS confirmed, count(*) AS total, round(count(*) FILTER (good AND NOT open) / count(*)::DOUBLE, 4) AS share FROM f GROUP BY id
""")
def confirmed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code")).agg(F.bool_or(F.col("o_orderkey") % 2 == 0).alias("good"), (F.countDistinct("o_orderpriority") > 4).alias("needs_review"))
    return consistency.confirmed(per.select("id", "code", F.when(F.col("good"), "S1").otherwise("model").alias("level")), per.select("id", "code", "needs_review"))


@query("""
WITH i AS (SELECT o_custkey AS id, o_orderstatus AS code, min(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 6 END) AS place FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), f AS (SELECT o_custkey AS id, o_orderstatus AS code, min(o_orderpriority) AS value FROM orders GROUP BY 1, 2)
SELECT id, code, CASE place WHEN 0 THEN NULL WHEN 2 THEN 'new' ELSE value END AS value, CASE place WHEN 0 THEN 'strip' WHEN 2 THEN 'map' WHEN 3 THEN 'recompute' WHEN 6 THEN 'review' ELSE 'keep' END AS decision FROM f LEFT JOIN i USING (id, code)
""")
def mended_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    kind = F.when(k == 0, "fabrication").when(k == 1, "not_in_aliases").when(k == 2, "bucket").otherwise("other")
    issues = orders.filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code"), kind.alias("kind"), F.lit("new").alias("new_value"))
    facts = orders.groupBy(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code")).agg(F.min("o_orderpriority").alias("value"))
    return consistency.applied(facts, consistency.decided(issues))


@query("""
SELECT 'formats' AS section, o_orderstatus AS name, count(*)::DOUBLE AS value FROM orders GROUP BY 2 UNION ALL SELECT 'totals', 'orders', count(*)::DOUBLE FROM orders UNION ALL SELECT 'sources', event_type, count(*)::DOUBLE FROM events GROUP BY 2
""")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "events")
    count = lambda df, by: df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("value"))
    return consistency.report_sections({"formats": count(orders, "o_orderstatus"), "totals": orders.agg(F.lit("orders").alias("name"), F.count("*").alias("value")), "sources": count(events, "event_type")})


@query("""
WITH s AS (SELECT page_id, 'Sentence number ' || page_id || ' that tells something of the product. Купить можно в нашем магазине на этой странице сегодня. Short.' AS t FROM pages)
SELECT page_id, 'Sentence number ' || page_id || ' that tells something of the product.' AS prose FROM s
""")
def page_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<html><script>var a = 'a sentence of a script that is long enough to be seen. ';</script><p>Sentence <b>number</b> "), F.col("page_id"), F.lit(" that tells something of the product. Купить можно в нашем магазине на этой странице сегодня.</p><div>Short.</div></html>"))
    return _table(spark, sf_dir, "pages").select("page_id", consistency.page_prose(html).alias("prose"))


@query("""
WITH p AS (SELECT DISTINCT p_name, split_part(p_name, ' ', 2) AS noun FROM part), t AS (SELECT DISTINCT noun FROM p)
SELECT 'x' AS code, noun AS alias, 'any ' || noun AS canon FROM t UNION ALL SELECT 'x', 'any ' || noun, 'any ' || noun FROM t UNION ALL SELECT 'x', p_name, 'any ' || noun FROM p
""")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    own = part.select(F.lit("x").alias("code"), F.col("p_name").alias("alias"), noun.alias("canon"))
    wide = part.select(F.lit("x").alias("code"), noun.alias("alias"), F.concat(F.lit("any "), noun).alias("canon"))
    return consistency.merged_aliases(own.unionByName(wide).distinct())


@query(f"SELECT p_partkey, {_case("'Инверторный'", "'Светодиодное'", "NULL", "NULL", "p_name", "NULL")} AS implied, {_case("true", "true", "false", "true", "false", "true")} AS same, {_case("'left'", "NULL", "'right'", "NULL", "NULL", "NULL")} AS side FROM part")
def implied_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _of("Инверторный двигатель", "LED освещение", "Тип двигателя", "тип (да)", F.concat(_name(), F.lit(" мотор (12 В)")), F.lit(None))
    a = _of("R600a, 58 г", "LED", "белый", _name(), _name(), "Белый")
    b = _of("r-600A", "Светодиодная", "серый", F.upper(_name()), F.concat(_name(), F.lit("s")), "белый.")
    side = pick_enum(_of(F.concat(F.lit("слева "), _name()), "слева или справа", "Справа", _name(), "", F.lit(None)), {"left": "слева", "right": "справа"})
    return _parts(spark, sf_dir).select("p_partkey", consistency.implied_value(key, F.lit("Тип двигателя")).alias("implied"), consistency.same_value(a, b).alias("same"), side.alias("side"))


@query("""
WITH f AS (SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'free' ELSE 'finish' END AS code, p_name, p_size FROM part), a AS (SELECT DISTINCT p_name FROM part WHERE p_size < 25)
SELECT id, code, CASE WHEN split_part(p_name, ' ', 1) = 'cold' THEN NULL WHEN code = 'free' OR p_name IN (SELECT p_name FROM a) THEN p_name END AS value, split_part(p_name, ' ', 1) <> 'cold' AND code = 'finish' AND p_name NOT IN (SELECT p_name FROM a) AS pending FROM f
""")
def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    facts = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "free").otherwise("finish").alias("code"), F.col("p_name").alias("value"))
    aliases = part.filter("p_size < 25").select(F.lit("finish").alias("code"), F.col("p_name").alias("alias"), F.col("p_name").alias("canon")).distinct()
    skipped = facts.filter("value like 'cold %'").select("code", F.upper("value").alias("value"))
    return consistency.mapped_values(facts, aliases, skipped)


@query(f"""
SELECT DISTINCT line, key, value, code, how FROM (SELECT p_partkey % 3 AS k, CASE p_partkey % 3 WHEN 0 THEN 'Вес — ' || {_SIZE_SQL} || ' кг' WHEN 1 THEN 'Количество полоки: ' || {_SIZE_SQL} ELSE p_name END AS line, CASE p_partkey % 3 WHEN 0 THEN 'Вес' WHEN 1 THEN 'Количество полоки' ELSE p_name END AS key,
    CASE p_partkey % 3 WHEN 0 THEN {_SIZE_SQL} || ' кг' WHEN 1 THEN {_SIZE_SQL} ELSE '' END AS value, CASE p_partkey % 3 WHEN 0 THEN 'weight' WHEN 1 THEN 'shelves' END AS code, CASE p_partkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' ELSE 'unmapped' END AS how FROM part)
""")
def suggested_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms, _, blacklist = _dictionary(spark)
    k = F.col("p_partkey") % 3
    lines = _parts(spark, sf_dir).select(F.when(k == 0, F.concat(F.lit("Вес — "), _size(), F.lit(" кг"))).when(k == 1, F.concat(F.lit("Количество полоки: "), _size())).otherwise(_name()).alias("line"))
    return consistency.suggested_attributes(lines.distinct(), synonyms, blacklist)


@query(f"""
WITH s AS (SELECT p_partkey, coalesce(p_size, 0) AS n FROM part)
SELECT p_partkey, {_case("n + 10", "(n + 500) / 10.0", "n + 10", "NULL", "n + 10", "n + 30")}::DOUBLE AS width, {_case("n + 20", "(n + 700) / 10.0", "n + 20", "NULL", "n + 30", "n + 20")}::DOUBLE AS height, {_case("n + 30", "(n + 600) / 10.0", "n + 30", "NULL", "n + 20", "n + 10")}::DOUBLE AS depth FROM s
""")
def best_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.coalesce("p_size", F.lit(0))
    of = lambda *a: F.concat_ws(" x ", *[(n + x).cast("string") for x in a])
    raw = _of(
        F.concat(F.lit("Габариты в упаковке (ШхВхГ): "), of(50, 60, 70), F.lit(" см; размеры (ШхВхГ) "), of(10, 20, 30), F.lit(" см")),
        F.concat(F.lit("Размеры "), of(500, 600, 700), F.lit(" мм")),
        F.concat(F.lit("Размеры "), of(40, 50, 60), F.lit(" см, габариты (ШхВхГ): "), of(10, 20, 30), F.lit(" см")),
        F.lit("без размеров"),
        F.concat(F.lit("размеры "), of(10, 20, 30), F.lit(" см (упаковка без размеров)")),
        F.concat(F.lit("Габариты: "), of(10, 20, 30), F.lit(" см (ГхВхШ)")),
    )
    return _parts(spark, sf_dir).select("p_partkey", consistency.best_size(raw).alias("s")).select("p_partkey", *[F.round(f"s.{a}", 6).alias(a) for a in ("width", "height", "depth")])


@query(f"""
SELECT p_partkey, '<ul><li>Вес: ' || {_SIZE_SQL} || '</li><li>' || p_name || '</li></ul>' AS html, '<ul><li>' || p_name || '</li></ul>' AS compact, p_name || ', ' || lower(p_type) AS keywords FROM part
""")
def rendered_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.concat(F.lit("Вес: "), _size()), F.lit(None), _name(), F.upper(_name()), F.lit(""))
    loose = F.concat(F.lit(" <ul>\n  <li> "), _name(), F.lit(" </li>\n</ul> "))
    words = F.array(_name(), F.lower("p_type"), F.concat(F.lit(" "), F.upper(_name())), F.lit(" "))
    return _parts(spark, sf_dir).select("p_partkey", consistency.annotation_html(lines).alias("html"), consistency.compact_html(loose).alias("compact"), consistency.meta_keywords(words).alias("keywords"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'given' WHEN p_name LIKE '%bolt' THEN 'fastener' WHEN p_name LIKE '%rod' THEN 'bar' END AS kind, CASE WHEN p_name LIKE 'cold%' THEN 'blue' END AS colour FROM part
""")
def filled_from_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 4 == 0, "given").when(F.col("p_partkey") % 4 == 1, "").alias("kind"))
    return consistency.filled_from_text(rows, {"kind": {"fastener": "bolt", "bar": "rod"}, "colour": {"blue": "^cold"}}, "p_name").drop("p_name")


@query("SELECT c_custkey AS id, c_name AS description_html, 'no_dictionary' AS review FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0")
def cards_without_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.alias("id"), F.when((k % 3 != 0) | (k % 2 == 0), F.col("c_name")).alias("description_html"), F.lit("").alias("annotation_html"))
    return cards.without_dictionary(rows).select("id", "description_html", "review")


@query("SELECT p_partkey AS id, 'size' AS code, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE END AS value, CASE WHEN p_partkey % 3 = 1 THEN 0.0 WHEN p_partkey % 3 = 2 THEN p_size::DOUBLE END AS lo, CASE WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE WHEN p_partkey % 3 = 2 THEN 'Infinity'::DOUBLE END AS hi FROM part WHERE p_size IS NOT NULL")
def attribute_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.col("p_size"), F.lit(" см"))).when(k == 1, F.concat(F.lit("до "), F.col("p_size"))).otherwise(F.concat(F.lit("от "), F.col("p_size"), F.lit(" см")))
    return coverage.attribute_facts(_table(spark, sf_dir, "part").filter("p_size is not null").select(F.col("p_partkey").alias("id"), F.lit("size").alias("code"), text.alias("text")))
