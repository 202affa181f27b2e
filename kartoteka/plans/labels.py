"""Queries that run the label, card and cost questions on the star-schema tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import labels
from kartoteka.plans.cards import _case, _name, _of, _parts
from kartoteka.plans.catalog import _table, query


@query(f"""
SELECT p_partkey, p_brand IS NOT NULL AS filled, coalesce(p_brand || ', ' || p_type, '') AS shown, p_partkey % 6 IN (0, 3) AS price, p_partkey % 6 IN (1, 2) AS strict, p_partkey % 6 IN (2, 3) AS unit,
    {_case("'стиральная машина'", "'холодильник'", "'вытяжка'", "NULL", "p_name", "'последняя модел'")} AS kind FROM part
""")
def label_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.when(F.col("p_brand").isNotNull(), F.array(F.col("p_brand"), F.lit(""), F.col("p_type")))
    name = _of("Цена", F.concat(F.lit("цена "), _name()), F.concat(_name(), F.lit(", кг")), " PRICE , ₽", "", F.lit(None))
    aliases = _of(F.create_map(), F.create_map(F.lit("a"), F.lit("b")), F.create_map(), F.create_map(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("b")), F.lit(None))
    flag = _of(F.lit(None).cast("boolean"), F.lit(None), F.lit(True), F.lit(False), F.lit(True), F.lit(None))
    section = _of("Стиральные машины", "Холодильники", "Вытяжка", "  ", _name(), "Последние модели")
    return _parts(spark, sf_dir).select(
        "p_partkey", labels.has_value(values).alias("filled"), labels.shown_labels(values).alias("shown"), labels.is_price_key(name).alias("price"), labels.is_strict(_of("enum", "enum", "text", "enum", "number", "enum"), flag, aliases).alias("strict"),
        labels.label_has_unit(name).alias("unit"), labels.singular_type(section).alias("kind"),
    )


@query(f"""
SELECT p_partkey, p_partkey % 6 = 5 AS empty, p_partkey % 6 = 1 AS refused, {_case("'a <strong>' || p_name || '</strong> b'", "'captcha'", "'captcha result-link'", "'<strong>x</strong>, y'", "p_name", "''")} AS html, CASE p_partkey % 6 WHEN 0 THEN 2 ELSE 0 END AS glued,
    {_case("'Класс A++'", "p_name", "p_name", "p_name", "p_name", "''")} AS plain, replace(p_brand, '#', '&amp;#') AS brand FROM part
""")
def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = _of(F.concat(F.lit("a<strong>"), _name(), F.lit("</strong>b")), "captcha", "captcha result-link", "<strong>x</strong>, y", _name(), F.lit(None))
    praise = _of("Класс A++, что говорит о низком расходе", _name(), _name(), _name(), _name(), F.lit(None))
    return _parts(spark, sf_dir).select(
        "p_partkey", labels.texts_empty(html, F.lit(" ")).alias("empty"), labels.refused_search(html).alias("refused"), labels.spaced_strong(html).alias("html"), labels.glued_strong(html).alias("glued"), labels.without_class_opinion(praise).alias("plain"),
        labels.xml_escaped(F.replace("p_brand", F.lit("#"), F.lit("&#"))).alias("brand"),
    )


@query("SELECT p_partkey, p_brand AS brand, p_name AS name, CASE WHEN p_brand IS NULL THEN 1 ELSE 2 END AS n FROM part")
def annotation_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<ul><li>Имя: old</li><li>без ключа</li>"), F.coalesce(F.concat(F.lit("<li>Бренд - "), "p_brand", F.lit("</li>")), F.lit("")), F.lit("<li>Имя:  "), "p_name", F.lit("</li></ul>"))
    found = _table(spark, sf_dir, "part").select("p_partkey", labels.annotation_map(html).alias("m"))
    return found.select("p_partkey", F.element_at("m", F.lit("Бренд")).alias("brand"), F.element_at("m", F.lit("Имя")).alias("name"), F.size("m").alias("n"))


@query("""
SELECT event_id, CASE event_id % 3 WHEN 0 THEN floor(value * 90.5 * 10000 + 0.5) / 10000 WHEN 1 THEN floor(value * 10000 + 0.5) / 10000 END AS cost, concat_ws('+', 'model', CASE WHEN event_type = 'view' THEN 'parser' END, CASE WHEN event_id % 2 = 0 THEN 'corrected' END) AS label FROM events
""")
def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    cost = labels.cost_in(F.col("value"), F.when(k == 0, "usd").when(k == 1, "RUB").otherwise("xxx"), {"USD": 90.5, "RUB": 1.0})
    return _table(spark, sf_dir, "events").select("event_id", cost.alias("cost"), labels.done_label(F.col("event_type") == "view", F.col("event_id") % 2 == 0).alias("label"))
