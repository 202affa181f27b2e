"""Queries that run the card, normalisation and facet-catalog operators on the star-schema tables, with SQL for each.

Cards are written out of the tables' own columns, so every row has its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import display, values
from kartoteka.functions.text import value_stem
from kartoteka.operators import cards, facet_catalog, normalise
from kartoteka.plans.catalog import _strip_sql, _table, query


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey") % 6)


def _of(*texts: Column | str) -> Column:
    """The text for each row's k = 0, 1, 2 ..."""
    out = None
    for i, t in enumerate(texts):
        t = F.lit(t) if isinstance(t, str) else t
        out = F.when(F.col("k") == i, t) if out is None else out.when(F.col("k") == i, t)
    return out


def _case(*texts: str) -> str:
    return "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


def _name() -> Column:
    return F.col("p_name")


def _size() -> Column:
    return F.coalesce("p_size", F.lit(0)).cast("string")


_SIZE_SQL = "coalesce(p_size, 0)::VARCHAR"


@query(f"""
SELECT p_partkey, {_case("p_name || ' (LED)'", "'Белый'", "'Нержавеющая сталь ' || p_name", "''", "'Сталь no. ' || " + _SIZE_SQL, "p_brand")} AS shown FROM part
""")
def displayed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(F.concat(_name(), F.lit("  (LED).")), "цвет БЕЛЫЙ (основной);", F.concat(F.lit("НЕРЖ. СТАЛЬ "), _name()), "Корпуса", F.concat(F.lit("cТАЛЬ no. "), _size(), F.lit(" цвет")), F.col("p_brand"))
    return _parts(spark, sf_dir).select("p_partkey", display.display_value(raw).alias("shown"))


@query(f"""
SELECT p_partkey, {_case("p_name || '|' || p_type", "p_name || '|' || p_type || '|' || " + _SIZE_SQL, "p_name", "''", "p_name || '|' || p_type", "p_type || '|' || p_name")} AS listed FROM part
""")
def listed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_type")
    raw = _of(F.concat(_name(), F.lit(" , "), kind), F.concat(_name(), F.lit(";"), kind, F.lit(" / "), _size()), F.concat(F.lit(" "), _name(), F.lit(",,")), " ; ", F.concat(_name(), F.lit(" и "), kind, F.lit(", "), F.upper(_name())), F.concat(kind, F.lit("|"), _name()))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(display.distinct_folded(display.split_values(raw)), "|").alias("listed"))


@query(f"""
SELECT p_partkey, {_case(_SIZE_SQL + " || ' кг'", "'Есть'", "'A++'", "upper(substr(p_name, 1, 1)) || substr(p_name, 2)", "''", _SIZE_SQL)} AS line FROM (SELECT * REPLACE (p_name AS p_name) FROM part)
WHERE p_partkey % 6 <> 3 UNION ALL SELECT p_partkey, 'Сталь ' || p_name FROM part WHERE p_partkey % 6 = 3
""")
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _of("number", "boolean", "class_scale", "enum", "boolean", "integer")
    raw = _of(F.concat(_size(), F.lit(".0")), "true", "A++", F.concat(F.lit("СТАЛЬ "), _name()), F.lit(None), _size())
    return _parts(spark, sf_dir).select("p_partkey", display.shown_value(kind, raw, F.when(F.col("k") == 0, "кг")).alias("line"))


@query(f"""
SELECT p_partkey, {_case("'Объём: ' || " + _SIZE_SQL + " || ' л'", "'Сушка: есть'", "'Класс: A++'", "'Цвет: белый ' || p_name", "NULL", "'Система: No Frost'")} AS line FROM part
""")
def annotation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, kind = _of("Объём", "Сушка", "Класс", "Цвет", "Шум", "Система"), _of("integer", "boolean", "class_scale", "enum", "number", "enum")
    raw = _of(_size(), "true", "A++", F.concat(F.lit("БЕЛЫЙ "), _name()), F.lit(None), "No Frost")
    return _parts(spark, sf_dir).select("p_partkey", display.annotation_line(name, kind, raw, F.when(F.col("k") == 0, "л")).alias("line"))


@query(f"""
SELECT p_partkey, {_case("p_name || ' Россия'", "''", "p_name", "p_brand || '; ' || " + _SIZE_SQL, "p_name", "p_type")} AS kept FROM part
""")
def legal_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(
        F.concat(_name(), F.lit(" Россия. Производитель на своё усмотрение меняет ")),
        F.concat(F.lit("* Внешний вид товара может отличаться "), _name()),
        F.concat(_name(), F.lit(" ; *производитель вправе менять")),
        F.concat(F.col("p_brand"), F.lit(";  "), _size()),
        F.concat(_name(), F.lit(" Характеристики могут быть изменены")),
        F.col("p_type"),
    )
    return _parts(spark, sf_dir).select("p_partkey", display.without_legal_tail(raw).alias("kept"))


@query(f"SELECT page_id, (list_count(regexp_extract_all(html, '(?i)<li[\\s>/]')) > 0) OR len(regexp_extract_all({_strip_sql('html')}, '\\s[-–—]\\s')) >= 8 OR len(list_filter(regexp_split_to_array(html, '(?i)<br\\s*/?>'), lambda x: {_strip_sql('x')} <> '')) >= 5 AS dumped FROM pages")
def dumped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", display.looks_dumped(F.col("html")).alias("dumped"))


@query(f"""
SELECT p_partkey, {_case("'Капельная'", "'No Frost'", "NULL", "'Ручное'", "'Капельная'", "'No Frost'")} AS fridge, {_case("'Ручное'", "'No Frost'", "NULL", "'Ручное'", "'Ручное'", "'No Frost'")} AS freezer, p_partkey % 6 IN (0, 4) AS drip,
    {_case("NULL", "'R600a'", "NULL", "'R134a'", "NULL", "NULL")} AS gas FROM part
""")
def cooling_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(F.concat(F.lit("Капельная система "), _name()), "Full No Frost, R-600a (изобутан)", _name(), F.concat(F.lit("статическая r134a,"), _size()), "без No Frost", F.concat(_name(), F.lit(" ноу-фрост")))
    return _parts(spark, sf_dir).select("p_partkey", values.defrost_kind(raw, "fridge").alias("fridge"), values.defrost_kind(raw, "freezer").alias("freezer"), values.is_drip_cooling(raw).alias("drip"), values.refrigerant(raw).alias("gas"))


@query(f"""
SELECT p_partkey, {_case("'qty_in_enum'", "'slug'", "'bool_in_enum'", "'enum_dump'", "'list_not_number'", "'number_not_primary'")} AS reason, NULL::VARCHAR AS value FROM part
UNION ALL SELECT p_partkey + 1000000000, NULL, p_name FROM part
UNION ALL SELECT p_partkey + 2000000000, CASE WHEN {_SIZE_SQL}::INT * 10 > 400 THEN 'out_of_range' END, CASE WHEN {_SIZE_SQL}::INT * 10 <= 400 THEN ({_SIZE_SQL}::INT * 10)::VARCHAR END FROM part
""")
def refused_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    raw = _of(F.concat(F.lit("вес "), _size(), F.lit(" кг")), F.concat(F.lit("item_"), _size()), "Да", F.concat(_name(), F.lit(" широкий - нет")), F.concat(_size(), F.lit(", 2, 3 режима")), F.concat(F.lit("отжим, полоскание и замачивание с отсрочкой до утра — "), _size(), F.lit(" ч")))
    kind = F.when(F.col("k") < 4, "enum").otherwise("number")
    none = F.lit(None).cast("double")
    odd = rows.select("p_partkey", values.normalize_value(kind, raw, none, none).alias("v"))
    plain = rows.select((F.col("p_partkey") + 1000000000).alias("p_partkey"), values.normalize_value(F.lit("enum"), F.concat(_name(), F.lit(" .")), none, none).alias("v"))
    scaled = rows.select((F.col("p_partkey") + 2000000000).alias("p_partkey"), values.normalize_value(F.lit("integer"), F.concat(_size(), F.lit(" см")), F.lit(0.0), F.lit(400.0), F.lit("mm")).alias("v"))
    return odd.unionByName(plain).unionByName(scaled).select("p_partkey", "v.reason", "v.value")


@query(f"""
SELECT p_partkey, {_case("NULL", _SIZE_SQL + "::DOUBLE", "NULL", "NULL", "NULL", _SIZE_SQL + "::DOUBLE")} AS value, {_case(_SIZE_SQL + "::DOUBLE", "NULL", "0.0", "(" + _SIZE_SQL + "::DOUBLE + 1)", "NULL", "NULL")} AS lo,
    {_case(_SIZE_SQL + "::DOUBLE + 5", "NULL", _SIZE_SQL + "::DOUBLE", "'Infinity'::DOUBLE", "NULL", "NULL")} AS hi, {_case("NULL", "NULL", "NULL", "12", "NULL", "36")}::BIGINT AS months,
    CASE p_partkey % 6 WHEN 4 THEN p_partkey + 3.5 END::DOUBLE AS noise FROM part
""")
def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = (F.coalesce("p_size", F.lit(0)) + 5).cast("string")
    raw = _of(F.concat(F.lit("от "), _size(), F.lit(" до "), more), F.concat(_size(), F.lit(" л")), F.concat(F.lit("до "), _size(), F.lit(" л")), F.concat(F.lit("от "), (F.coalesce("p_size", F.lit(0)) + 1).cast("string"), F.lit(" л")), F.concat(_size(), F.lit(" и "), more), _size())
    about = _of(F.concat(F.lit("гарантия: 5 лет на двигатель "), _name()), _name(), "гарантия 3", "Гарантийный срок — 12 мес.", F.concat(F.lit("Уровень шума (дБА) - "), F.col("p_partkey"), F.lit(",5 дБ")), "гарантия производителя 3 года")
    b = values.bounds_of(raw)
    rows = _parts(spark, sf_dir).select("p_partkey", b.alias("b"), values.warranty_months(about).alias("months"), values.labelled_number(about, "уровень шума", 0, 1e9).alias("noise"))
    return rows.select("p_partkey", "b.value", "b.lo", "b.hi", "months", (F.col("noise") + 3).alias("noise"))


@query(f"""
SELECT p_partkey, {_case("'Объем общий'", "'Скорость отжима'", "'Вес'", "'Ширина'", "'Цвет'", "'Л'")} AS label, {_case("'л'", "'об/мин'", "'кг'", "'мм'", "''", "''")} AS unit, p_name AS phrase FROM part WHERE p_partkey % 2 = 1
UNION ALL SELECT p_partkey, {_case("'Объем общий'", "'Скорость отжима'", "'Вес'", "'Ширина'", "'Цвет'", "'Л'")}, {_case("'л'", "'об/мин'", "'кг'", "'мм'", "''", "''")}, p_brand || ' ' || p_type || ' характеристики' FROM part WHERE p_partkey % 2 = 0 AND p_brand IS NOT NULL
UNION ALL SELECT p_partkey, {_case("'Объем общий'", "'Скорость отжима'", "'Вес'", "'Ширина'", "'Цвет'", "'Л'")}, {_case("'л'", "'об/мин'", "'кг'", "'мм'", "''", "''")}, p_type || ' характеристики' FROM part WHERE p_partkey % 2 = 0 AND p_brand IS NULL
""")
def key_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _of("объем_общий_л", "скорость_отжима_об_мин", "вес_кг", "ширина_мм", "цвет", "л")
    even = F.col("p_partkey") % 2 == 0
    phrase = display.search_phrase(F.col("p_brand"), F.when(even, F.col("p_type")), F.concat(F.lit("«"), _name(), F.lit("» ")), F.when(even, F.lit("характеристики")))
    return _parts(spark, sf_dir).select("p_partkey", display.key_label(key).alias("l"), phrase.alias("phrase")).select("p_partkey", "l.label", "l.unit", "phrase")


@query("""
WITH t AS (SELECT page_id, 'Достоинства: ' || repeat('очень тихая. ', 1 + (page_id % 60)::INT) AS t FROM pages), c AS (SELECT page_id, CASE WHEN length(trim(t)) <= 700 THEN trim(t) ELSE regexp_extract(substr(trim(t), 1, 701), '(?s)^(.*[.!?])(?:\\s|$)', 1) END AS t FROM t)
SELECT page_id, CASE WHEN length(t) BETWEEN 300 AND 700 THEN t ELSE '' END AS review FROM c
""")
def review_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Отзыв о товаре. Достоинства:  "), F.repeat(F.lit("очень тихая . "), (1 + F.col("page_id") % 60).cast("int")))
    return _table(spark, sf_dir, "pages").select("page_id", display.review_text(raw).alias("review"))


# Cards of parts: a list, two lines, a paragraph, a glued list item, shop attributes with a description, and nothing.
_SYNONYMS = [("Вес", "weight", "number", 1), ("Масса нетто", "weight", "number", 2), ("Цвет", "colour", "enum", 3), ("Сушка", "drying", "boolean", 4), ("Класс", "wash_class", "class_scale", 5), ("Класс", "class_count", "number", 6), ("Количество полок", "shelves", "integer", 7), ("Класс энергопотребления", "energy_class", "class_scale", 8)]


def _dictionary(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    synonyms = spark.createDataFrame(_SYNONYMS, "synonym string, code string, kind string, order int")
    attributes = spark.createDataFrame([("weight", "number", "kg", 0.0, 45.0), ("colour", "enum", None, None, None), ("drying", "boolean", None, None, None), ("wash_class", "class_scale", None, None, None), ("class_count", "number", None, None, None), ("shelves", "integer", None, None, None), ("energy_class", "class_scale", None, None, None)], "code string, kind string, unit string, lo double, hi double")
    return synonyms, attributes, spark.createDataFrame([("вес брутто",)], "phrase string")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.lit("<ul><li>Вес: "), _size(), F.lit(" кг</li><li>Цвет - "), _name(), F.lit("</li><li>РАЗМЕРЫ</li></ul>"))
    lines = F.concat(F.lit("Вес<br/>"), _size(), F.lit(" кг<br>Сушка<br>да<br>")) 
    plain = F.concat(F.lit("Вес "), _size(), F.lit(" кг. Цвет "), _name(), F.lit(". Сушка нет."))
    glued = F.concat(F.lit("<li>Сушка: да Количество полок: "), _size(), F.lit(". Цвет: "), _name(), F.lit("</li>"))
    said = F.concat(F.lit("<p>Цвет: "), _name(), F.lit("</p><br>Вес: 99 кг<br>Шум: 40 дБ"))
    attribute = F.when(F.col("k") == 4, F.array(F.struct(F.lit("Вес").alias("name"), F.concat(_size(), F.lit(" кг")).alias("value"))))
    return _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), attribute.alias("attributes"), _of(listed, lines, plain, glued, F.lit(None), F.lit(None)).alias("annotation"), _of(F.lit(None), F.lit(None), F.lit(None), F.lit(None), said, F.lit(None)).alias("description"))


_CARD_FACTS = f"""
SELECT p_partkey AS id, 'Вес' AS key, {_SIZE_SQL} || ' кг' AS value, CASE WHEN p_partkey % 6 = 4 THEN 'S0' ELSE 'S1' END AS source, CASE p_partkey % 6 WHEN 2 THEN 'dict' WHEN 4 THEN 'attr' ELSE 'sep' END AS via FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)
UNION ALL SELECT p_partkey, 'Цвет', p_name, CASE WHEN p_partkey % 6 = 4 THEN 'S2' ELSE 'S1' END, CASE WHEN p_partkey % 6 = 2 THEN 'dict' ELSE 'sep' END FROM part WHERE p_partkey % 6 IN (0, 2, 3, 4)
UNION ALL SELECT p_partkey, 'Сушка', CASE WHEN p_partkey % 6 = 2 THEN 'нет' ELSE 'да' END, 'S1', CASE WHEN p_partkey % 6 = 2 THEN 'dict' ELSE 'sep' END FROM part WHERE p_partkey % 6 IN (1, 2, 3)
UNION ALL SELECT p_partkey, 'Количество полок', {_SIZE_SQL}, 'S1', 'sep' FROM part WHERE p_partkey % 6 = 3
"""


@query(_CARD_FACTS)
def card_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms = _dictionary(spark)[0]
    required = spark.createDataFrame([("weight",), ("colour",)], "code string")
    return cards.product_facts(_cards(spark, sf_dir), synonyms, required).select("id", "key", "value", "source", "via")


@query(f"WITH f AS ({_CARD_FACTS}) SELECT id, source, via, count(*) AS cnt, string_agg(DISTINCT key, ', ' ORDER BY key) AS keys FROM f GROUP BY ALL")
def card_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.pair_traces(card_facts(spark, sf_dir))


@query(f"""
WITH f AS ({_CARD_FACTS}), c AS (SELECT *, CASE key WHEN 'Вес' THEN 'weight' WHEN 'Цвет' THEN 'colour' WHEN 'Сушка' THEN 'drying' ELSE 'shelves' END AS code, try_cast(regexp_extract(value, '^[0-9]+') AS INT) AS n FROM f)
SELECT id, code, CASE WHEN code IN ('weight', 'shelves') THEN CASE WHEN code = 'weight' AND n > 45 THEN value ELSE n::VARCHAR END WHEN code = 'drying' THEN (value = 'да')::VARCHAR ELSE value END AS value, source AS level,
    CASE WHEN code = 'weight' AND n > 45 THEN 'out_of_range' ELSE 'ok' END AS status FROM c
""")
def normalised_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms, attributes, blacklist = _dictionary(spark)
    facts = card_facts(spark, sf_dir).withColumn("seq", F.xxhash64("source", "key"))
    return normalise.normalize_products(facts.withColumnRenamed("source", "level"), attributes, synonyms, blacklist)


@query("""
SELECT DISTINCT key, value, CASE key WHEN 'Класс' THEN CASE WHEN value = 'A++' THEN 'wash_class' ELSE 'class_count' END WHEN 'нетто масса' THEN 'weight' WHEN 'тип' THEN CASE WHEN value = 'Автомат' THEN 'washer_type' END WHEN 'Количество полок.' THEN 'shelves' WHEN 'Количество полоки' THEN 'shelves' END AS code,
    CASE key WHEN 'Класс' THEN 'exact' WHEN 'нетто масса' THEN 'words' WHEN 'тип' THEN CASE WHEN value = 'Автомат' THEN 'value' ELSE 'unmapped' END WHEN 'вес брутто с паллетой' THEN 'blacklist' WHEN 'Количество полок.' THEN 'exact' WHEN 'Количество полоки' THEN 'fuzzy' END AS how
FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Класс' WHEN 1 THEN 'нетто масса' WHEN 2 THEN 'тип' WHEN 3 THEN 'вес брутто с паллетой' WHEN 4 THEN 'Количество полок.' ELSE 'Количество полоки' END AS key,
    CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size > 25 THEN 'A++' ELSE coalesce(p_size, 0)::VARCHAR END WHEN 2 THEN CASE WHEN p_size > 25 THEN 'Автомат' ELSE p_name END ELSE p_name END AS value FROM part)
""")
def pairs_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    synonyms, _, blacklist = _dictionary(spark)
    synonyms = synonyms.unionByName(spark.createDataFrame([("Вид машины", "washer_type", "enum", 9)], "synonym string, code string, kind string, order int"))
    large = F.col("p_size") > 25
    key = _of("Класс", "нетто масса", "тип", "вес брутто с паллетой", "Количество полок.", "Количество полоки")
    value = _of(F.when(large, "A++").otherwise(_size()), _name(), F.when(large, "Автомат").otherwise(_name()), _name(), _name(), _name())
    return normalise.match_pairs(_parts(spark, sf_dir).select(key.alias("key"), value.alias("value")), synonyms, blacklist)


@query("""
WITH v AS (SELECT p_partkey AS id, 'finish' AS code, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ', 2 x 2 W' ELSE split_part(p_name, ' ', 2) END AS value FROM part),
a AS (SELECT DISTINCT replace(p_name, ' ', '') AS spelling, p_name AS canon FROM part WHERE p_size < 25 UNION SELECT DISTINCT split_part(p_name, ' ', 2), 'any ' || split_part(p_name, ' ', 2) FROM part WHERE p_size < 5 UNION SELECT DISTINCT 'any' || split_part(p_name, ' ', 2), 'any ' || split_part(p_name, ' ', 2) FROM part WHERE p_size < 5),
f AS (SELECT *, replace(replace(lower(value), ' ', ''), ',', '') AS folded FROM v), e AS (SELECT id, canon FROM f JOIN a ON folded = spelling),
i AS (SELECT id, canon FROM f JOIN a ON contains(folded, spelling) AND length(spelling) >= 4 WHERE id NOT IN (SELECT id FROM e) QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(spelling) DESC, spelling DESC) = 1)
SELECT id, code, value, canon FROM f LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM i) USING (id)
""")
def aliased_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    k, noun = F.col("p_partkey") % 3, F.split_part("p_name", F.lit(" "), F.lit(2))
    facts = part.select(F.col("p_partkey").alias("id"), F.lit("finish").alias("code"), F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit(", 2 x 2 W"))).otherwise(noun).alias("value"))
    aliases = part.filter("p_size < 25").select(F.lit("finish").alias("code"), F.col("p_name").alias("alias"), F.col("p_name").alias("canon")).unionByName(part.filter("p_size < 5").select(F.lit("finish"), noun, F.concat(F.lit("any "), noun)).toDF("code", "alias", "canon")).distinct()
    return normalise.alias_values(facts, aliases).select("id", "code", "value", "canon")


@query(f"SELECT p_partkey, {_case("p_name", "'нержавеющ'", "'программ'", "p_name", "'бел'", "replace(p_name, ' ', '')")} AS stem FROM part WHERE p_partkey % 6 IN (1, 2, 4) UNION ALL SELECT p_partkey, replace(p_name, ' ', '') FROM part WHERE p_partkey % 6 IN (0, 3, 5)")
def value_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _of(_name(), "Нержавеющая", "программист", F.concat(_name(), F.lit(" ")), "Белый", F.upper(_name()))
    return _parts(spark, sf_dir).select("p_partkey", value_stem(raw).alias("stem"))


@query(f"""
SELECT p_partkey, {_case("false", "true", "false", "true", "true", "false")} AS ok, {_case("'no_text'", "NULL", "'short_without_facts'", "NULL", "NULL", "'no_text'")} AS reason, p_partkey % 6 IN (1, 4) AND length(split_part(p_name, ' ', 1)) >= 3 AS same FROM part
""")
def enrichable_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _of(" ", F.concat(_name(), F.lit(" 5 кг")), _name(), F.repeat(F.concat(_name(), F.lit(" ")), 20), _name(), F.lit(None))
    facts = _of(F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(2), F.lit(9))
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    other = _of("машина белая", F.concat(F.lit("Стиральная "), F.upper(first)), "машина", "", F.concat(first, F.lit("; для кг")), "холодильник")
    ok = cards.enrichable(text, facts)
    return _parts(spark, sf_dir).select("p_partkey", ok.alias("e"), cards.same_product(_name(), other).alias("same")).select("p_partkey", "e.ok", "e.reason", "same")


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment WHEN c_custkey % 4 = 1 THEN 'dump' WHEN c_custkey % 4 = 2 THEN 'dump<br>' || c_mktsegment ELSE c_mktsegment END AS annotation,
    CASE WHEN c_custkey % 4 = 3 THEN c_name WHEN c_custkey % 4 = 0 THEN c_name ELSE 'text ' || c_name END AS description, CASE WHEN c_custkey % 4 = 1 THEN 'Dump' ELSE c_name END AS name FROM customer
""")
def merged_dump_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, k = _table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    rows = customer.select(F.col("c_custkey").alias("id"), F.when(k == 1, " ").otherwise(F.col("c_name")).alias("name"), F.when(k == 1, "").otherwise(F.col("c_mktsegment")).alias("annotation"), F.col("c_name").alias("description"))
    dump = customer.filter(k != 0).select(F.col("c_custkey").alias("id"), F.lit("Dump").alias("name"), F.when(k == 3, F.col("c_mktsegment")).otherwise("dump").alias("annotation"), F.when(k == 3, F.concat(F.col("c_name"), F.lit(" "))).otherwise("text").alias("description"))
    return cards.merge_dump_texts(rows, dump, "id")


@query("""
WITH f AS (SELECT o_custkey AS id, o_orderstatus AS code, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS labels FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
m AS (SELECT id, string_agg(code || '=' || labels, ';' ORDER BY code) AS filters FROM f GROUP BY id)
SELECT c_custkey AS id, '' AS meta_keywords, c_name AS description_html, c_mktsegment AS annotation_html, coalesce(filters, '') AS filters, '' AS web_info, c_nationkey FROM customer LEFT JOIN m ON id = c_custkey
""")
def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    customer = _table(spark, sf_dir, "customer")
    rows = customer.select(F.col("c_custkey").alias("id"), none.alias("meta_keywords"), F.col("c_name").alias("description_html"), F.col("c_mktsegment").alias("annotation_html"), none.alias("web_info"))
    code = F.when(F.col("o_orderstatus") == "P", "Brand").otherwise(F.col("o_orderstatus"))
    filters = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), code.alias("code"), F.col("o_orderpriority").alias("label"))
    out = cards.customer_rows(rows, filters)
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("filters")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";")
    told = out.withColumn("filters", flat)
    return cards.with_context(told, customer.select(F.col("c_custkey").alias("id"), "c_nationkey", F.lit("other").alias("web_info")), "id")


@query("""
WITH t AS (SELECT event_id, event_type, user_id, CASE event_id % 4 WHEN 0 THEN ' ' ELSE event_type || event_id END AS name FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT CASE WHEN trim(name) = '' THEN 'file' || event_id ELSE name END AS image, event_type AS objects, event_id::VARCHAR AS image_id, user_id::VARCHAR AS product_id, 'a,' || event_type AS tags, 'value=' || event_type AS attributes FROM t
""")
def photo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "described").when(kind == "signup", "ready").otherwise("new")
    items = _table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), status.alias("status"), F.when(F.col("event_id") % 4 == 0, " ").otherwise(F.concat(kind, F.col("event_id"))).alias("name"), F.concat(F.lit("file"), "event_id").alias("filename"), F.lit(None).cast("string").alias("caption"), kind.alias("on_image"),
        F.lit("").alias("description"), F.lit("").alias("alt"), F.array(F.lit("a"), F.lit(" "), kind, F.lit("a ")).alias("tags"), cards.slim_offer(F.array(F.struct(F.lit("value").alias("name"), kind.alias("value")), F.struct(F.lit("value").alias("name"), F.lit("later").alias("value")))).alias("attributes"), F.col("user_id").alias("product_id"),
    )
    flat = F.array_join(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return cards.photo_rows(items).select("image", "objects", "image_id", "product_id", F.array_join("tags", ",").alias("tags"), flat.alias("attributes"))


@query("""
WITH e AS (SELECT *, event_type = 'purchase' AS done FROM events) SELECT event_id, user_id FROM e WHERE done OR NOT (SELECT bool_or(done) FROM e)
""")
def exported_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "purchase", F.lit("x")).alias("enriched"))
    return cards.ready_for_export(rows, "enriched").drop("enriched")


@query("""
WITH f AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) AS n, bool_or(o_orderstatus = 'P') AS p, bool_or(o_orderstatus = 'F') AS f FROM orders GROUP BY 1), r AS (SELECT c_custkey AS id, coalesce(n, 0) < 3 AS thin, coalesce(p, false) AS p, coalesce(f, false) AS f FROM customer LEFT JOIN f ON id = c_custkey WHERE c_custkey % 5 <> 0)
SELECT id, thin, concat_ws(',', CASE WHEN NOT f THEN 'F' END, CASE WHEN NOT p THEN 'P' END) AS missing FROM r WHERE thin OR NOT f OR NOT p
""")
def products_to_look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("model"))
    facts = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("code"), F.lit("S1").alias("level"), F.lit("x").alias("value"))
    wanted = spark.createDataFrame([("F",), ("P",)], "code string")
    return cards.needs_lookup(products, facts, wanted, 3).withColumn("missing", F.array_join("missing", ","))


@query(f"""
SELECT p_partkey, {_case("'washer'", "'fridge'", "'dryer'", "'washer-dryer'", "'accessory'", "'other'")} AS kind, p_partkey % 6 IN (0, 3, 5) AS fits, {_case("'required'", "'optional'", "'none'", "'required'", "'none'", "'optional'")} AS role FROM part
""")
def product_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _of(F.concat(F.lit("Cтиральная машина "), _name()), F.concat(F.lit("Холодильник "), _name()), F.concat(F.lit("Сушильная машина "), _name()), F.concat(F.lit("Стиральная машина "), _name()), F.concat(F.lit("Соединительный элемент "), _name()), _name())
    extra = _of("белая", "", "для стиральной машины", "Сушка: есть", "", "прочее")
    kind = facet_catalog.product_kind(name, extra)
    role = facet_catalog.storefront_role(F.lit(True), _of("ok", "ok", "not_a_filter", "ok", "ok", "ok"), _of("A", "A", "A", "B", "X", "B"), _of(F.lit(False), F.lit(False), F.lit(True), F.lit(True), F.lit(True), F.lit(None)), _of(F.lit(None), F.lit(False), F.lit(True), F.lit(None), F.lit(True), F.lit(None)), F.lit("colour"))
    return _parts(spark, sf_dir).select("p_partkey", kind.alias("kind"), facet_catalog.fits_category(kind, F.lit("washer")).alias("fits"), role.alias("role"))


def _facets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Facets out of parts' types and the nations, and counts of the brands of each type."""
    part = _table(spark, sf_dir, "part")
    none, buckets = F.array().cast("array<string>"), F.array().cast("array<struct<label:string,min:double,max:double>>")
    listed = F.when(F.col("p_type") == "PROMO", F.array(F.lit("Brand#9"), F.lit("house")))
    types = part.select("p_type").distinct().select(F.lit(1).alias("category"), F.col("p_type").alias("code"), F.lower("p_type").alias("name"), F.length("p_type").alias("order"), F.lit("enum").alias("kind"), listed.alias("listed"), F.array().cast("array<int>").alias("int_values"), buckets.alias("buckets"), none.alias("canons"))
    extra = types.limit(1).select(F.lit(2).alias("category"), F.explode(F.array(F.lit("flag"), F.lit("count"), F.lit("empty"), F.lit("brand"))).alias("code"), F.lit(1).alias("order"), none.alias("listed"), buckets.alias("buckets"), none.alias("canons"))
    extra = extra.select("category", "code", F.col("code").alias("name"), "order", F.when(F.col("code") == "flag", "boolean").when(F.col("code") == "count", "int_enum").otherwise("enum").alias("kind"), "listed", F.when(F.col("code") == "count", F.array(F.lit(3), F.lit(1))).otherwise(F.array().cast("array<int>")).alias("int_values"), "buckets", "canons")
    counts = part.filter("p_brand is not null").groupBy(F.col("p_type").alias("code"), F.col("p_brand").alias("label")).agg(F.count("*").alias("cnt"))
    return types.unionByName(extra), counts


@query("""
WITH l AS (SELECT p_type AS code, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS v FROM part GROUP BY 1), p AS (SELECT 'Brand#9|house|' || string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS v FROM part WHERE p_type = 'PROMO' AND p_brand <> 'Brand#9')
SELECT 1 AS category, row_number() OVER (ORDER BY length(code), lower(code)) AS place, code, lower(code) AS name, CASE WHEN code = 'PROMO' THEN (SELECT v FROM p) ELSE v END AS v FROM l
UNION ALL SELECT 2, 1, 'count', 'count', '3|1' UNION ALL SELECT 2, 2, 'flag', 'flag', 'Есть|Нет'
""")
def facet_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_catalog.facet_list(*_facets(spark, sf_dir)).select("category", F.col("place").cast("long").alias("place"), "code", "name", F.array_join("values", "|").alias("v"))


@query("SELECT p_type, string_agg(s, '|' ORDER BY n, s) AS labels FROM (SELECT DISTINCT p_type, p_size::VARCHAR || '-' || (p_size + 5)::VARCHAR AS s, p_size AS n FROM part WHERE p_size IS NOT NULL UNION SELECT p_type, p_brand, 1000 FROM part WHERE p_brand IS NOT NULL) GROUP BY 1")
def ordered_facet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    labels = part.filter("p_size is not null").select("p_type", F.concat_ws("-", "p_size", F.col("p_size") + 5).alias("s")).unionByName(part.filter("p_brand is not null").select("p_type", F.col("p_brand").alias("s")))
    return labels.groupBy("p_type").agg(F.collect_set("s").alias("s")).select("p_type", F.array_join(facet_catalog.ordered_labels(F.col("s")), "|").alias("labels"))


def _uploaded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    part = _table(spark, sf_dir, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    value = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, noun).when(F.col("p_partkey") % 4 == 2, F.concat(F.col("p_name"), F.lit(" matt - нет"))).otherwise("Да")
    uploaded = part.select(F.lower("p_type").alias("name"), value.alias("value"))
    facets = part.select("p_type").distinct().filter("p_type <> 'LARGE'").select(F.lower("p_type").alias("name"), F.col("p_type").alias("code"), F.when(F.col("p_type") == "SMALL", "range").otherwise("enum").alias("kind"), (F.col("p_type") != "PROMO").alias("strict"))
    aliases = part.select(F.col("p_type").alias("code"), F.col("p_name").alias("alias"), F.col("p_name").alias("canon")).filter("code <> 'PROMO'").distinct()
    collapses = part.select(F.lit(None).cast("string").alias("code"), noun.alias("spelling"), F.concat(F.lit("any "), noun).alias("canon")).filter("spelling <> 'bolt'").distinct()
    return uploaded, facets, aliases, collapses


_UPLOADED_SQL = """
u AS (SELECT DISTINCT lower(p_type) AS name, p_type AS code, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name || ' matt - нет' ELSE 'Да' END AS raw, p_partkey % 4 AS k, p_name FROM part),
c AS (SELECT DISTINCT name, raw, CASE WHEN code = 'SMALL' THEN raw WHEN code = 'LARGE' OR k > 1 THEN NULL WHEN k = 0 THEN CASE WHEN code <> 'PROMO' THEN p_name END WHEN code = 'PROMO' AND raw <> 'bolt' THEN 'any ' || raw END AS canon,
    CASE WHEN code = 'LARGE' THEN 'not_enabled_or_unknown' WHEN code = 'SMALL' THEN NULL WHEN k > 1 THEN 'junk_or_wrong_axis' WHEN code <> 'PROMO' AND k = 1 THEN 'not_in_aliases' WHEN code = 'PROMO' AND (k = 0 OR raw = 'bolt') THEN 'no_aliases_freeform' END AS reason FROM u)
"""


@query(f"WITH {_UPLOADED_SQL} SELECT name, raw, canon, CASE WHEN reason IS NOT NULL THEN 'drop' WHEN replace(lower(canon), ' ', '') <> replace(lower(raw), ' ', '') THEN 'map' ELSE 'keep' END AS action, reason FROM c")
def cleaned_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facet_catalog.clean_facets(*_uploaded(spark, sf_dir))


@query(f"WITH {_UPLOADED_SQL} SELECT name, string_agg(DISTINCT canon, '|' ORDER BY lower(canon), canon) AS v FROM c WHERE reason IS NULL GROUP BY name")
def cleaned_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = facet_catalog.clean_facets(*_uploaded(spark, sf_dir))
    return facet_catalog.cleaned_catalog(cleaned).select("name", F.array_join("values", "|").alias("v"))


@query(f"""
WITH {_UPLOADED_SQL}, v AS (SELECT DISTINCT name, raw, upper(name) AS code FROM u), k AS (SELECT * FROM v WHERE code <> 'LARGE')
SELECT DISTINCT name, 'warn' AS severity, 'unknown_facet' AS kind, NULL AS detail FROM v WHERE code = 'LARGE'
UNION ALL SELECT name, 'info', 'single_value', min(raw) FROM k WHERE code <> 'SMALL' GROUP BY name HAVING count(*) = 1
UNION ALL SELECT DISTINCT a.name, 'error', 'synonym_pair', 'bolt + rod' FROM k a JOIN k b ON a.name = b.name AND a.raw = 'bolt' AND b.raw = 'rod'
UNION ALL SELECT name, 'error', 'mixed_axis', raw FROM k WHERE code = 'PROMO' AND lower(raw) LIKE '%anvil%'
""")
def facet_catalog_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploaded, facets, _, _ = _uploaded(spark, sf_dir)
    pairs = spark.createDataFrame([("bolt", "rod"), ("сверху", "верхнее")], "a string, b string")
    wrong = spark.createDataFrame([("PROMO", "anvil", "mixed_axis")], "code string, pattern string, kind string")
    return facet_catalog.catalog_issues(uploaded, facets, pairs, wrong)


@query(f"""
WITH {_UPLOADED_SQL} SELECT DISTINCT name, raw AS value, CASE WHEN k > 1 THEN 'dirty_value' ELSE 'not_in_aliases' END AS kind FROM u WHERE code NOT IN ('LARGE', 'SMALL') AND (k > 1 OR (k = 1 AND code <> 'PROMO'))
""")
def dirty_facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploaded, facets, aliases, _ = _uploaded(spark, sf_dir)
    return facet_catalog.dirty_values(uploaded.distinct(), facets, aliases)


@query(f"""
SELECT p_partkey AS id, p_type AS code, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) END AS value,
    CASE WHEN p_type = 'PROMO' THEN CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE split_part(p_name, ' ', 1) END WHEN p_partkey % 2 = 0 THEN p_name END AS label FROM part
""")
def allowed_facet_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    facts = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("value"))
    aliases = part.filter("p_type <> 'PROMO'").select(F.col("p_type").alias("code"), F.col("p_name").alias("alias"), F.col("p_name").alias("canon")).distinct()
    return facet_catalog.allowed_labels(facts, aliases)


@query("""
WITH k AS (SELECT DISTINCT p_type AS key FROM part UNION SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL UNION SELECT ' ')
SELECT key, CASE WHEN key = ' ' THEN 'skip' WHEN key IN ('LARGE', 'Brand#2', 'Brand#3') THEN 'forbidden' WHEN key IN ('PROMO', 'SMALL', 'Brand#1') THEN 'approved' ELSE 'unlisted' END AS kind FROM k
""")
def classified_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    keys = part.select(F.col("p_type").alias("key")).unionByName(part.filter("p_brand is not null").select(F.col("p_brand").alias("key"))).distinct().unionByName(spark.createDataFrame([(" ",)], "key string"))
    sheet = spark.createDataFrame([("PROMO", True), ("SMALL", True), ("LARGE", False), ("Brand#2", False)], "name string, approved boolean")
    renames = spark.createDataFrame([("SMALL", "Brand#1"), ("Brand#3", "Brand#2"), ("OTHER", "Brand#4")], "old string, new string")
    return facet_catalog.classified_keys(keys, facet_catalog.approved_keys(sheet, renames))
