"""Queries of value rules on texts put together from the tables' columns, each with SQL that computes the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import values
from kartoteka.operators import facet_catalog
from kartoteka.plans.catalog import _table, query

_LETTERS = "ABCDEFGabgАБВГДЕСабвгдес"


@query(f"""
WITH t AS (SELECT p_partkey, substr('{_LETTERS}', 1 + coalesce(p_size, 0)::INT % {len(_LETTERS)}, 1) AS a, substr('{_LETTERS}', 1 + length(coalesce(p_name, '')) % {len(_LETTERS)}, 1) AS b, (p_partkey % 4)::INT AS n, (p_partkey // 4 % 4)::INT AS m FROM part),
u AS (SELECT p_partkey, CASE WHEN m > n THEN b ELSE a END AS letter, greatest(n, m) AS pluses FROM t)
SELECT p_partkey, translate(upper(letter), 'АБВГДЕС', 'ABBGDEC') || repeat('+', pluses) AS class FROM u
""")
def class_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two classes in a text the one of more pluses; Cyrillic letters are read, letters of words are not."""
    one = lambda n: F.substr(F.lit(_LETTERS), (n % len(_LETTERS) + 1).cast("int"), F.lit(1))
    pluses = lambda n: F.repeat(F.lit("+"), n.cast("int"))
    key = F.col("p_partkey")
    text = F.concat(F.lit("Класс по ЕС: "), one(F.coalesce("p_size", F.lit(0))), pluses(key % 4), F.lit(" / "), one(F.length(F.coalesce("p_name", F.lit("")))), pluses(F.floor(key / 4) % 4), F.lit(" (Energy)"))
    return _table(spark, sf_dir, "part").select("p_partkey", values.class_scale(text).alias("class"))


_SAID = ["да", "Есть", "ИМЕЕТСЯ", "+", "on", "Включено", "поддерживается", "да, с дисплеем", "нет", "No", "выключено", "не поддерживается", "функция не предусмотрена", "без сушки", "отсутствует", "Не имеется", "н/д", "нетто", "данные", "синий"]
_TRUE, _FALSE = _SAID[:8], _SAID[8:16]


@query(f"""
WITH t AS (SELECT l_orderkey, l_linenumber, {_SAID}[1 + (l_orderkey + l_linenumber)::INT % {len(_SAID)}] AS said FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN list_contains({_TRUE}, said) THEN true WHEN list_contains({_FALSE}, said) THEN false END AS answer FROM t
""")
def said_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that say yes or no, whole, at the beginning or by a denial; words that only look like one say neither."""
    said = F.get(F.array(*map(F.lit, _SAID)), ((F.col("l_orderkey") + F.col("l_linenumber")) % len(_SAID)).cast("int"))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", values.parse_boolean(said).alias("answer"))


def _spaced_sql(n: str) -> str:
    return f"replace(format('{{:,}}', {n}), ',', ' ')"


@query(f"""
WITH t AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS n FROM orders)
SELECT o_orderkey, 'от ' || {_spaced_sql("n")} || ' до ' || {_spaced_sql("n + 1500")} || ' руб' AS said, n::DOUBLE AS lo, (n + 1500)::DOUBLE AS hi, (n + 1500)::DOUBLE AS most FROM t
""")
def spaced_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and bounds of numbers with spaces between thousands."""
    n = F.floor("o_totalprice").cast("long")
    spaced = lambda x: F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))
    said = F.concat(F.lit("от "), spaced(n), F.lit(" до "), spaced(n + 1500), F.lit(" руб"))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", said.alias("said"), values.parse_range(said).alias("r"), values.bounds_of(F.concat(F.lit("до "), spaced(n + 1500))).alias("b"))
    return rows.select("o_orderkey", "said", "r.lo", "r.hi", F.col("b.hi").alias("most"))


@query("""
WITH t AS (SELECT p_partkey, coalesce(p_size, 0)::INT AS n, p_brand FROM part)
SELECT p_partkey, CASE n % 4 WHEN 0 THEN 'washer-dryer' WHEN 1 THEN 'washer-dryer' WHEN 2 THEN 'washer' ELSE 'accessory' END AS kind, CASE WHEN n % 4 = 3 THEN 487 END::BIGINT AS suggested FROM t
""")
def moved_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by a model's prefix and by what a text says of loads, and the category an accessory should move to."""
    n, brand = F.coalesce("p_size", F.lit(0)).cast("string"), F.coalesce("p_brand", F.lit(""))
    name = F.get(F.array(F.concat(F.lit("HWD7"), n, F.lit(" Стиральная машина "), brand), F.concat(F.lit("Стиральная машина "), brand), F.concat(F.lit("Cтир.машина "), brand), F.concat(F.lit("Элемент CK-"), n)), (F.coalesce("p_size", F.lit(0)) % 4).cast("int"))
    extra = F.when(F.coalesce("p_size", F.lit(0)) % 4 == 1, F.concat(F.lit("Загрузка для режима сушки "), n, F.lit(" кг"))).otherwise(F.lit("Загрузка. Сушка нет"))
    kind = facet_catalog.product_kind(name, extra)
    return _table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), facet_catalog.suggested_category(kind, F.lit(467)).alias("suggested"))
