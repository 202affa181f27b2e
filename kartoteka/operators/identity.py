"""Which pages speak of which product: its model as a phrase, its brand under any name, and no other variant of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import fold, fold_lookalikes, squeeze

#: What may stand between the words of a model, or be left out; letters and digits of a word.
BETWEEN, WORDS = "[\\s\\-_/]", "A-Za-zА-Яа-яЁё0-9"
#: Widths that tell variants of a hob or hood apart, and the word for glass.
WIDTHS, GLASS = ("40", "45", "50", "55", "60", "70", "80", "90"), "glass|стекл"
#: Words of names that no product is known by.
GENERIC_STEMS = "стиральн|машин|холодильник|морозильник|морозильн|камер|телевизор|плит|духовк|посудомоечн|микроволнов|печ|кондиционер|вытяжк|воздухоочистител|кухонн|варочн|поверхност|сушильн|сушилк|встраиваем|полновстраиваем|отдельностоящ|двухкамерн|однокамерн"
GENERIC_WORDS = "белый|белая|белое|черный|черная|черное|серебристый|серебристая|серебристое|серый|серая|серое|красный|красная|красное|синий|синяя|синее|бежевый|бежевая|графит|графитовый|цвет|with|the|and|для|или|шт|см|мм|кг|л|и|с|a"


def phrase_words(phrase: Column) -> Column:
    """The words of a model or brand, look-alike letters folded."""
    return F.filter(F.split(fold_lookalikes(phrase), "[\\s\\-_/,]+"), lambda w: w != "")


def _quoted(word: Column) -> Column:
    return F.regexp_replace(word, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a text holds the words of a phrase in order, apart or run together, and not as part of longer words."""
    body = F.array_join(F.transform(phrase_words(phrase), _quoted), BETWEEN + "*")
    return (F.size(phrase_words(phrase)) > 0) & F.rlike(fold_lookalikes(text), F.concat(F.lit(f"(?<![{WORDS}])"), body, F.lit(f"(?![{WORDS}])")))


def variant_of(model: Column) -> Column:
    """struct<glass, sizes, base>: what tells a model from its sisters, and the model without it."""
    size = f"(?:^|{BETWEEN})(\\d{{2,3}})(?=$|[\\s\\-_/,(])"
    base = F.regexp_replace(F.regexp_replace(model, "(?iu)\\bglass\\b|стекл[а-я]*", " "), size, " ")
    return F.struct(model.rlike(f"(?iu)\\bglass\\b|стекл").alias("glass"), F.array_distinct(F.regexp_extract_all(model, F.lit(size), F.lit(1))).alias("sizes"), F.trim(F.regexp_replace(base, f"{BETWEEN}+", " ")).alias("base"))


def variant_conflicts(text: Column, model: Column) -> Column:
    """Whether a text speaks of another variant of a model: with glass or without, or of another width and not of the model's own."""
    v = variant_of(F.coalesce(model, F.lit("")))
    base = F.array_join(F.transform(F.split(v["base"], " "), _quoted), BETWEEN + "*")
    has = lambda *parts: F.rlike(text, F.concat(F.lit("(?iu)"), *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    glass_near = has("(?:", base, f"){BETWEEN}*(?:{GLASS})|(?:{GLASS}){BETWEEN}*(?:", base, ")")
    other_glass = (v["glass"] & ~glass_near & ~text.rlike(f"(?iu)\\bglass\\b|стекл")) | (~v["glass"] & glass_near)
    other_size = F.exists(v["sizes"], lambda s: ~has("(?:", base, f"){BETWEEN}*", s, "\\b|\\b", s, f"{BETWEEN}*(?:", base, ")") & F.exists(F.array(*map(F.lit, WIDTHS)), lambda w: (w != s) & has("(?:", base, f"){BETWEEN}*", w, "\\b")))
    return (v["base"] != "") & (other_glass | other_size)


def key_words(name: Column) -> Column:
    """The words of a name that a product can be known by: no kinds, colours or units, no single letters."""
    bare = F.transform(F.split(squeeze(F.regexp_replace(F.coalesce(name, F.lit("")), "[«»\"(),;]", " ")), " "), lambda w: F.regexp_replace(w, "^[.:]+|[.:]+$", ""))
    letters = lambda w: F.regexp_replace(fold(w), "[^\\p{L}\\d]", "")
    told = F.filter(bare, lambda w: (F.length(letters(w)) >= 2) & ~fold(w).rlike(f"^(?:(?:{GENERIC_STEMS})[а-я]*|(?:{GENERIC_WORDS}))$"))
    return F.filter(told, lambda w, i: F.array_position(F.transform(told, letters), letters(w)) == i + 1)


def known_by(products: DataFrame) -> DataFrame:
    """products (product_id, name, brand, model, brand_names) with `phrases`: what a page must hold, and `probe`: the longest of them in one word."""
    phrases = F.when(F.coalesce(F.trim("model"), F.lit("")) != "", F.array("model")).otherwise(key_words(F.col("name")))
    compact = lambda p: F.array_join(phrase_words(p), "")
    longest = F.array_max(F.transform("phrases", lambda p: F.struct(F.length(compact(p)).alias("n"), compact(p).alias("word"), F.size(phrase_words(p)).alias("words"))))
    return products.withColumn("phrases", phrases).withColumn("probe", longest)


def product_pages(pages: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, page_id): pages (page_id, text) that hold a product's model, or all key words of its name, name its brand, and show no other variant.

    Words of a page that follow each other, run together, meet the longest
    phrase of each product in one equi-join, for as many words as any product's
    phrase has; what meets is checked in the text. Without a brand none is asked
    for; without a model or key word a product has no page.
    """
    wanted = known_by(products).filter("probe.word <> ''")
    most = wanted.agg(F.max("probe.words").alias("most"))
    runs = F.filter(F.split(fold_lookalikes(F.col("text")), f"[^a-zа-я0-9\\s\\-_/]+"), lambda r: r != "")
    spread = pages.select("page_id", "text", F.explode(runs).alias("run")).withColumn("w", F.filter(F.split("run", f"{BETWEEN}+"), lambda w: w != ""))
    spread = spread.crossJoin(F.broadcast(most)).filter("size(w) > 0")  # one row
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least("most", F.size("w") - i + 1)), lambda n: F.array_join(F.slice("w", i, n), ""))))
    words = spread.select("page_id", F.explode(F.array_distinct(windows)).alias("word")).distinct()
    met = words.join(wanted.select("product_id", F.col("probe.word").alias("word")), "word").select("page_id", "product_id").distinct()
    both = met.join(pages.select("page_id", "text"), "page_id").join(wanted.select("product_id", "model", "brand", "brand_names", "phrases"), "product_id")
    text = F.col("text")
    named = F.array_distinct(F.array_compact(F.concat(F.array("brand"), F.coalesce("brand_names", F.array().cast("array<string>")))))
    branded = (F.coalesce("brand", F.lit("")) == "") | F.exists(named, lambda b: contains_phrase(text, b))
    sound = F.forall("phrases", lambda p: contains_phrase(text, p)) & branded & ~variant_conflicts(text, F.col("model"))
    return both.filter(sound).select("product_id", "page_id")
