"""Values that product cards are known to give."""

import pytest
from pyspark.sql import functions as F

from kartoteka.functions import buckets, text, values
from kartoteka.operators import facet_catalog, facets, match, pairs, reports, resolve, shape


def run(spark, column, *inputs):
    """column(value) for each input, in order."""
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert run(spark, text.strip_html, "<b>A&nbsp;&amp; B</b> <br>5&times;6", None) == ["A & B 5×6", ""]
    assert run(spark, text.norm_key, "Ёмкость, л", "Вес (кг)", "Max загрузка [кг]", "Шум: стирка/отжим", "Размеры ВхШхГ, см") == ["емкость", "вес", "загрузка", "шум стирка отжим", "размеры вxшxг"]
    assert run(spark, text.value_fold, "Отдельно стоящая", "Отдельностоящая")[0] == run(spark, text.value_fold, "Отдельно-стоящая")[0]
    assert run(spark, text.annotation_format, "<li>a", "a<br/>b", "text", " <p> </p>", None) == ["LI", "BR", "OTHER", "EMPTY", "EMPTY"]
    assert run(spark, text.html_chunks, "<ul><li>Вес: 5</li><li> </li><li><b>x</b></li></ul>", "a<br>b<BR />") == [["Вес: 5", "x"], ["a", "b"]]
    assert run(spark, lambda c: text.dice(c, F.lit("abc")), "abc", "xyz") == [1.0, 0.0]
    assert run(spark, text.is_packing_key, "Вес в упаковке", "Вес без упаковки", None) == [True, False, False]
    assert run(spark, text.is_heading_line, "Размеры:", "УПРАВЛЕНИЕ", "Вес: 5", "") == [True, True, False, True]
    assert run(spark, lambda c: text.number_label(c.cast("double")), "5", "2.5", "0.3333", None) == ["5", "2.5", "0.333", None]
    assert run(spark, text.model_token, "Холодильник LG GA-B509 60С", "no") == ["GA-B509", None]


def test_values(spark):
    assert run(spark, values.parse_number, "7,5 кг", "1 200 об/мин", "нет данных", "от 5 до 7", "без", None) == [7.5, 1200.0, None, None, None, None]
    assert run(spark, values.unit_of, "12 мес.", "2 года", "600 мм", "5 кг", "50 мл", "3 л", "имя") == ["month", "year", "mm", "kg", "ml", "l", None]
    assert run(spark, values.parse_boolean, "Да", "нет", "есть, с дисплеем", "—", "возможно", "без дисплея") == [True, False, True, None, None, False]
    assert run(spark, values.class_scale, "А++", "класс B", "G+++ ", "нет") == ["A++", "B", "G+++", None]
    assert run(spark, values.parse_range, "5-10", "от 3 до 8 кг", "7", "x") == [(5.0, 10.0), (3.0, 8.0), (7.0, 7.0), None]
    assert run(spark, lambda c: values.parse_dimensions(c, F.lit("Габариты (ВхШхГ), см")), "200x60x65") == [(60.0, 200.0, 65.0)]
    assert run(spark, values.parse_dimensions, "600x850x400 мм", "нет", "600×850×400") == [(60.0, 85.0, 40.0), None, (60.0, 85.0, 40.0)]


def test_buckets(spark):
    assert run(spark, lambda c: buckets.nice_step(c.cast("double")), "265", "0", "49", "8") == [50.0, 1.0, 10.0, 1.0]
    assert run(spark, lambda c: buckets.price_step(c.cast("double")), "34440", "500", "0") == [300.0, 10.0, None]
    assert run(spark, lambda c: buckets.step_label(c.cast("double"), F.lit(2.5)), "6", "2.5") == ["5-7.5", "2.5-5"]
    grid = buckets.buckets_from_breaks(F.array(F.lit(0.0), F.lit(5.0), F.lit(10.0)), F.lit(True))
    assert run(spark, lambda c: buckets.match_bucket(c.cast("double"), grid), "0", "5", "-1", "99") == ["0-5", "5-10", None, "10+"]
    assert run(spark, lambda c: buckets.match_bucket(c.cast("double"), grid, True), "5", "0") == ["0-5", None]
    assert run(spark, lambda c: buckets.snap_int_enum(c.cast("double"), F.array(F.lit(2), F.lit(4))), "2", "3", "9", "-1") == ["2", "2", "4", "2"]
    assert run(spark, buckets.bucket_range, "5-10", "10+", "до 3", "x") == [(5.0, 10.0), (10.0, float("inf")), (float("-inf"), 3.0), None]


def test_range_buckets_of_a_catalog(spark):
    rows = [("w", float(v)) for v in (190, 225, 298, 310, 355, 364, 420, 455)] + [("f", 30.0), ("f", 40.0), ("f", 50.0)]
    got = facets.data_buckets(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()
    assert {r.label for r in got if r.k == "w"} == {"150-200", "200-250", "250-300", "300-350", "350-400", "400-450", "450-500"}
    assert {r.label for r in got if r.k == "f"} == {"30", "40", "50"}


def test_shop_facets(spark):
    rows = [("LG", 43790.0), ("LG", 52890.0), ("POZIS", 18450.0), (None, None)]
    got = {(r.facet, r.value): r for r in facets.shop_facets(spark.createDataFrame(rows, "b string, p double"), "b", "p").collect()}
    assert got["brand", "LG"].cnt == 2 and got["brand", "POZIS"].cnt == 1 and got["brand", "without_value"].cnt == 1
    price = got["price", "without_price"]
    assert (price.cnt, price.min, price.max, price.step) == (1, 18450.0, 52890.0, 300.0)


def test_pairs(spark):
    html = "<ul><li>Вес: 6 кг</li><li>Размеры:</li><li>Шум – 55 дБ</li></ul>"
    table = "<table><tr><td>Вес</td><td>9</td><td>кг</td></tr><tr><th>Цвет</th><td>белый</td></tr></table><dl><dt>Класс</dt><dd>A</dd></dl>"
    df = spark.createDataFrame([(1, html, table), (2, None, None)], "id long, annotation string, description string")
    got = {(r.key, r.value, r.source) for r in pairs.card_pairs(df).collect()}
    assert got == {("Вес", "6 кг", "annotation"), ("Шум", "55 дБ", "annotation"), ("Цвет", "белый", "description"), ("Класс", "A", "description")}
    assert run(spark, pairs.two_numbers, "55 / 73", "55") == [[55.0, 73.0], None]
    assert run(spark, pairs.tag_balance, "<p><b>x</b>", "<p>x</p>") == [["p"], []]


def test_ranked_facts(spark):
    rows = [(1, "w", "S2", 0, "9"), (1, "w", "S1", 1, "6"), (1, "w", "S1", 2, "7"), (2, "w", "model", 0, "1")]
    df = spark.createDataFrame(rows, "id int, code string, level string, seq int, value string").withColumn("rank", resolve.source_rank(F.col("level")))
    assert {r.id: r.value for r in resolve.resolve_facts(df, ["id", "code"], "rank", "seq").collect()} == {1: "6", 2: "1"}
    log = sorted(tuple(r) for r in resolve.conflict_log(df, ["id", "code"], "rank", "seq", "value").collect())
    assert log == [(1, "w", 1, "9", "6", "6", False), (1, "w", 2, "6", "7", "6", True)]


def test_matching(spark):
    synonyms = spark.createDataFrame([("Уровень шума", "noise", 1), ("Максимальная загрузка", "load", 2)], "synonym string, code string, order int")
    barred = spark.createDataFrame([("Гарантия",)], "phrase string")
    keys = spark.createDataFrame([("уровень шума, дБ",), ("Шума уровень",), ("Гарантия магазина",), ("Максимальная загрузкa",), ("Цвет",)], "key string")
    got = {r.key: (r.code, r.how) for r in match.match_keys(keys, synonyms, barred).collect()}
    assert got == {"уровень шума, дБ": ("noise", "exact"), "Шума уровень": ("noise", "words"), "Гарантия магазина": (None, "blacklist"), "Максимальная загрузкa": ("load", "fuzzy"), "Цвет": (None, "unmapped")}
    prefixed = match.prefix_matches(spark.createDataFrame([("Уровень шума при отжиме",)], "key string"), synonyms).first()
    assert (prefixed.code, prefixed.how) == ("noise", "prefix")
    names = spark.createDataFrame([("Холодильник LG Side",), ("Плита Side by Side",), ("x",)], "n string")
    brands = spark.createDataFrame([("LG",), ("Side by Side",), ("Side",)], "b string")
    assert {r.n: r.brand for r in match.brand_in_name(names, "n", brands, "b").collect()} == {"Холодильник LG Side": "Side", "Плита Side by Side": "Side by Side", "x": None}
    canon = match.unify_values(spark.createDataFrame([("c", "белый"), ("c", "белый"), ("c", "белая")], "a string, v string"), "a", "v").collect()
    assert {r.v: r.canon for r in canon} == {"белый": "белый", "белая": "белый"}


def test_reports_and_shape(spark):
    facts = spark.createDataFrame([(1, "a", "5"), (1, "b", None), (2, "a", "6")], "id int, code string, value string")
    rows = spark.createDataFrame([(3,)], "total int")
    got = {r.code: (r.mapped, r.filled, r.coverage) for r in reports.coverage(facts, spark.createDataFrame([("a",), ("b",), ("c",)], "code string"), rows).collect()}
    assert got == {"a": (2, 2, 66.7), "b": (1, 0, 0.0), "c": (0, 0, 0.0)}
    specs = shape.spec_map(facts, spark.createDataFrame([("a", "width_mm", 10.0), ("b", "b", None)], "code string, spec string, mul double")).filter("id = 1").first().specs
    assert specs == {"width_mm": "50.0", "b": None}
    assert run(spark, shape.snake_key, "Скорость отжима, об/мин") == ["скорость_отжима_об_мин"]
    with pytest.raises(KeyError):
        resolve.cross_check(facts, facts, ["id"], "value", "value", 1.0, 0.0, policy="other")


def test_answers_classes_ranges_and_kinds(spark):
    assert run(spark, values.parse_boolean, "+", "on", "Поддерживается", "выключено", "Не поддерживается", "не предусмотрено", "без сушки", "есть дисплей", "1", "-", "белый") == [True, True, True, False, False, False, False, True, True, None, None]
    assert run(spark, values.class_scale, "Б", "г", "д++", "A (B++)", "ЕС", "класс Е", "С+", "EU", None) == ["B", "G", "D++", "B++", None, "E", "C+", None, None]
    assert [tuple(r) for r in run(spark, values.parse_range, "от 1 200 до 1 400", "7 8", "1 200")] == [(1200.0, 1400.0), (7.0, 8.0), (1200.0, 1200.0)]
    assert [r and (r.lo, r.hi) for r in run(spark, values.bounds_of, "до 1 200", "от 1 200 до 1 400", "от 5")] == [(0.0, 1200.0), (1200.0, 1400.0), (5.0, float("inf"))]
    enum = lambda c: values.normalize_value(F.lit("enum"), c, F.lit(None), F.lit(None), key=F.lit("Цвет корпуса"))
    assert [(r.value, r.reason) for r in run(spark, enum, "светодиодное 5 Вт", "6 кг", "Материал", "цвет корпуса", "белый")] == [("светодиодное 5 Вт", None), (None, "qty_in_enum"), (None, "echo_value"), (None, "echo_value"), ("белый", None)]
    names = ("HWD70BP14929B Стиральная машина Haier", "Cтиральная машина Renova WS-35E(BL)", "C47TD H10A2BSW-07 суш маш Candy", "Стиральная машина LG с функцией сушки F1296CDS0X", "B3WFR572AB RU Ст-МашA1 Beyond", "Соединительный элемент CK-3")
    assert run(spark, facet_catalog.product_kind, *names) == ["washer-dryer", "washer", "dryer", "washer-dryer", "washer", "accessory"]
    assert run(spark, lambda c: facet_catalog.product_kind(F.lit("Стиральная машина Beko WDB7425R2W"), c), "Объем - 7 (стирка)/4 (сушка) кг", "Загрузка белья для сушки", "Загрузка 6 кг") == ["washer-dryer", "washer-dryer", "washer"]
    assert run(spark, lambda c: facet_catalog.suggested_category(c, F.lit(467)), "accessory", "dryer") == [487, None]
