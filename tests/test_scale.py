"""Costly expressions are computed on few rows and by many tasks, and give what they gave."""

from pyspark.sql import functions as F

from kartoteka.operators import audit, consistency, match, normalise, parsing

SYNONYMS, SYNONYM = [("Вес", "weight", "number", 1), ("Количество полок", "shelves", "integer", 2)], "synonym string, code string, kind string, order int"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_are_read_once_a_pair_not_once_a_row(spark):
    synonyms, barred = spark.createDataFrame(SYNONYMS, SYNONYM), spark.createDataFrame([("вес брутто",)], "phrase string")
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "Вес").when(F.col("id") % 3 == 1, "вес брутто с паллетой").otherwise("Количество полоки").alias("key"), (F.col("id") % 2).cast("string").alias("value"))
    asked = match.looked_up(rows.select("key").distinct(), synonyms, barred)
    assert "size(" not in optimized(asked).split("Aggregate", 1)[1]
    found = normalise.match_pairs(rows, synonyms, barred)
    assert "Range" not in optimized(found)
    assert {(r.key, r.code, r.how) for r in found.collect()} == {("Вес", "weight", "exact"), ("вес брутто с паллетой", None, "blacklist"), ("Количество полоки", "shelves", "fuzzy")}
    assert found.count() == 6


def test_texts_are_dealt_out_and_their_phrases_computed_once(spark):
    texts = spark.range(6).coalesce(1).select("id", F.when(F.col("id") % 2 == 0, "A red bolt, boxed").when(F.col("id") == 1, "not red").alias("text"))
    aliases = spark.createDataFrame([("colour", "red", "red"), ("kind", "bolt", "fastener")], "code string, alias string, canon string")
    claims = audit.value_claims(texts, "id", "text", aliases)
    assert "RepartitionByExpression" in optimized(claims) and "size(flatten" not in optimized(claims)
    assert sorted(tuple(r) for r in claims.collect()) == sorted((i, *x) for i in (0, 2, 4) for x in (("colour", "red"), ("kind", "fastener")))


def test_lines_are_read_once_a_line_not_once_a_row(spark):
    lines = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "Вес — 5 кг").otherwise("Количество полоки: 3").alias("line")).distinct()
    found = consistency.suggested_attributes(lines, spark.createDataFrame(SYNONYMS, SYNONYM), spark.createDataFrame([("вес брутто",)], "phrase string"))
    assert "Range" not in optimized(found)
    assert sorted(tuple(r) for r in found.collect()) == [("Вес — 5 кг", "Вес", "5 кг", "weight", "exact"), ("Количество полоки: 3", "Количество полоки", "3", "shelves", "fuzzy")]


def counted(spark, function, returns):
    """function as a UDF, with an accumulator of its calls."""
    calls = spark.sparkContext.accumulator(0)

    def call(*values):
        calls.add(1)
        return function(*values)

    return F.udf(call, returns), calls


def test_cards_of_equal_texts_are_read_once(spark, monkeypatch):
    tail, calls = counted(spark, lambda t: t, "string")
    monkeypatch.setattr(parsing, "without_legal_tail", tail)
    html = F.when(F.col("id") % 4 == 0, "<li>Вес: 5 кг</li><li>Цвет: красный</li>").when(F.col("id") % 4 == 1, "Вес: 6 кг").when(F.col("id") % 4 == 2, "")
    cards = spark.range(200).select("id", html.alias("html"))
    got = parsing.text_pairs(cards, {"html": "S1"}, spark.createDataFrame([("Вес", "weight", 1)], "synonym string, code string, order int")).collect()
    want = [(i, "Вес", "5 кг", "weight") for i in range(0, 200, 4)] + [(i, "Цвет", "красный", None) for i in range(0, 200, 4)] + [(i, "Вес", "6 кг", "weight") for i in range(1, 200, 4)]
    assert sorted((r.id, r.key, r.value, str(r.code)) for r in got) == sorted((i, k, v, str(c)) for i, k, v, c in want)
    assert calls.value <= 12


def test_values_are_read_once_a_pair_not_once_a_row(spark, monkeypatch):
    read, calls = counted(spark, lambda kind, value, lo, hi, unit, key: (value.upper(), None), "value string, reason string")
    monkeypatch.setattr(normalise, "normalize_value", read)
    pairs = spark.range(300).select("id", F.col("id").alias("seq"), F.lit("Вес").alias("key"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("value"), F.lit("S1").alias("level"))
    attributes = spark.createDataFrame([("weight", "number", "kg", 0.0, 45.0)], "code string, kind string, unit string, lo double, hi double")
    got = normalise.normalize_products(pairs, attributes, spark.createDataFrame(SYNONYMS, SYNONYM), spark.createDataFrame([("вес брутто",)], "phrase string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, "weight", "AB"[i % 2], "S1", "ok") for i in range(300)]
    assert calls.value <= 8
