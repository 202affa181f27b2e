"""Facts out of card texts, value rules and matching by value, on small texts."""

import pytest
from pyspark.sql import functions as F

from kartoteka.functions import display, values
from kartoteka.functions.text import decode_numeric_entities, is_heading_line, is_packing_key
from kartoteka.operators import consistency, match, normalise, parsing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SYNONYMS = [("Макс. загрузка", "load", "number", 1), ("Макс. скорость отжима", "spin", "number", 2), ("Загрузка белья", "load", "number", 3), ("Интерфейс", "io", "enum", 4), ("Класс", "wash", "class_scale", 5), ("Класс", "levels", "integer", 6), ("Размораживание холодильной камеры", "defrost", "enum", 7), ("Количество полок", "shelves", "integer", 8)]


@pytest.fixture(scope="module")
def synonyms(spark):
    return spark.createDataFrame(SYNONYMS, "synonym string, code string, kind string, order int")


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("Макс. загрузка<br />6 кг<br />Макс. скорость отжима<br />1000 об/мин", [("Макс. загрузка", "6 кг", "sep"), ("Макс. скорость отжима", "1000 об/мин", "sep")]),
        ("<ul><li>Загрузка белья (кг) 4</li></ul>", [("Загрузка белья (кг)", "4", "dict")]),
        ("<li>Цвет корпусаБелый</li><li>УПРАВЛЕНИЕ</li><li>Размеры:</li>", [("Цвет корпуса", "Белый", "case")]),
        ("<li>Размораживание холодильной камеры: капельное. Количество полок: 3</li>", [("Размораживание холодильной камеры", "капельное", "sep"), ("Количество полок", "3", "sep")]),
        ("<li>Страна: Россия Производитель на свое усмотрение и без уведомлений</li>", [("Страна", "Россия", "sep")]),
        ("Загрузка белья 4. Класс A. Количество полок 3.", [("Загрузка белья", "4", "dict"), ("Класс", "A", "dict"), ("Количество полок", "3", "dict")]),
        ("<p>Просто текст без фактов</p>", []),
        ("Разморозка - капельная Количество полок - 55 шт", [("Разморозка", "капельная", "sep"), ("Количество полок", "55 шт", "sep")]),
        ("Перевешиваемые двери - да Габариты без упаковки - 10x20", [("Перевешиваемые двери", "да", "sep"), ("Габариты без упаковки", "10x20", "sep")]),
        ("Серия - новая Габариты без упаковки - 10x20", [("Серия", "новая", "sep"), ("Габариты без упаковки", "10x20", "sep")]),
        ("Подставка для яиц. Морозильное отделение: ниже. Количество полок: 4 шт", [("Морозильное отделение", "ниже", "sep"), ("Количество полок", "4 шт", "sep")]),
        ("Макс. загрузка: 6 кг", [("Макс. загрузка", "6 кг", "sep")]),
        ("Холодильное отделение: Размораживание холодильной камеры: автоматическое (капельная система). Количество полок: 3 шт", [("Размораживание холодильной камеры", "автоматическое (капельная система)", "sep"), ("Количество полок", "3 шт", "sep")]),
        ("<nav>" + "<li>Каталог</li>" * 40 + "</nav><p>Макс. загрузка: 6 кг. Макс. скорость отжима: 1000 об/мин.</p>", [("Макс. загрузка", "6 кг", "sep"), ("Макс. скорость отжима", "1000 об/мин", "sep")]),
        ("Управление: Интерфейс: кнопки", [("Интерфейс", "кнопки", "sep")]),
        ("Интерфейс 2D - да", [("Интерфейс", "2D - да", "dict")]),
        (None, []),
    ],
)
def test_chunks_to_pairs(spark, synonyms, html, want):
    df = spark.createDataFrame([(1, html)], "id int, html string")
    got = parsing.text_pairs(df, {"html": "S1"}, synonyms).orderBy("seq").collect()
    assert [(r.key, r.value, r.via) for r in got] == want


def test_values(spark):
    unit = lambda t: one(spark, values.unit_of(F.lit(t)))
    assert [unit(t) for t in ("5 килограмм", "55 дБ", "1 200 об/мин", "5 лет", "5 л", "шт")] == ["kg", "db", "rpm", "year", "l", None]
    assert one(spark, values.convert_unit(F.lit(5.0), F.lit("year"), F.lit("month"))) == 60 and one(spark, values.convert_unit(F.lit(5.0), F.lit("db"), F.lit("cm"))) == 5
    assert one(spark, is_packing_key(F.lit("Габариты в  упаковке"))) and not one(spark, is_packing_key(F.lit("Вес без упаковки")))
    assert [one(spark, is_heading_line(F.lit(t))) for t in ("", "Размеры:", "УПРАВЛЕНИЕ И ФУНКЦИОНАЛ", "Вес: 5", "A++", "Цвет белый")] == [True, True, True, False, False, False]
    assert one(spark, decode_numeric_entities(F.lit("a&#1041;&#x411;;&b"))) == "aББ;&b"
    assert one(spark, display.display_value(F.lit("  Цвет БЕЛЫЙ  (матовый)."))) == "Белый" and one(spark, display.display_value(F.lit("No Frost (NF)"))) == "No Frost (NF)"
    assert one(spark, values.warranty_months(F.lit("гарантия 5 лет на двигатель"))) is None and one(spark, values.warranty_months(F.lit("Гарантия: 2 года"))) == 24
    assert one(spark, values.labelled_number(F.lit("Глубина, (см) - от 40,5 до 50"), "глубина")) is None


def test_matching_by_value(spark, synonyms):
    barred = spark.createDataFrame([("класс отжима",)], "phrase string")
    pairs = spark.createDataFrame([("Класс", "A"), ("Класс", "3"), ("класс отжима", "B"), ("загрузка макс", "6"), ("Цвет", None)], "key string, value string")
    got = {(r.key, r.value): (r.code, r.how) for r in normalise.match_pairs(pairs, synonyms, barred).collect()}
    assert got == {("Класс", "A"): ("wash", "exact"), ("Класс", "3"): ("levels", "exact"), ("класс отжима", "B"): (None, "blacklist"), ("загрузка макс", "6"): ("load", "words")} | {k: v for k, v in got.items() if k[0] == "Цвет"}


def test_prefix_respects_the_blacklist(spark, synonyms):
    keys = spark.createDataFrame([("Класс отжима B",), ("Класс стирки",)], "key string")
    barred = spark.createDataFrame([("класс отжима",)], "phrase string")
    assert {r.key for r in match.prefix_matches(keys, synonyms, barred).collect()} == {"Класс стирки"}


def test_merged_and_implied(spark):
    assert one(spark, consistency.implied_value(F.lit("Инверторный двигатель"), F.lit("Тип двигателя"))) == "Инверторный"
    size = one(spark, consistency.best_size(F.lit("в упаковке 70x70x200 см; габариты (ШхГхВ) 600 x 650 x 1850 мм")))
    assert (size.width, size.depth, size.height) == (60, 65, 185)
    assert one(spark, consistency.best_size(F.lit("нет"))) is None
