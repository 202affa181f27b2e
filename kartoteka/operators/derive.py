"""Values that follow from others: ordered rules, typical values, sizes from axes, product identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import fold, fold_lookalikes, model_token, norm_key, squeeze


def apply_rules(cards: DataFrame, rules: list[tuple[str, Column, Column]]) -> DataFrame:
    """cards with rules (target, condition, value) applied in order.

    A rule fills its target only where it is empty, and later rules read what
    earlier ones filled; each is one projection, so Catalyst folds them.
    """
    for target, condition, value in rules:
        held = F.col(target) if target in cards.columns else F.lit(None)
        cards = cards.withColumn(target, F.coalesce(held, F.when(condition, value)))
    return cards


def fill_defaults(facts: DataFrame, products: DataFrame, defaults: DataFrame) -> DataFrame:
    """(id, code, value, origin): facts, and the dictionary's typical value for each product that has none.

    defaults: code, value. Each product meets each default once; the expected
    pairs grow with products times a dictionary of a few dozen rows.
    """
    offered = products.select("id").crossJoin(defaults.select("code", F.col("value").alias("_default")))
    joined = facts.select("id", "code", "value").join(offered, ["id", "code"], "full")
    origin = F.when(F.col("value").isNotNull(), "fact").when(F.col("_default").isNotNull(), "default")
    return joined.select("id", "code", F.coalesce("value", "_default").alias("value"), origin.alias("origin"))


def size_of_axes(width: Column, height: Column, depth: Column) -> Column:
    """The three axes as one size, or null while one is missing."""
    whole = width.isNotNull() & height.isNotNull() & depth.isNotNull()
    return F.when(whole, F.struct(width.alias("width"), height.alias("height"), depth.alias("depth")))


def reconcile_size(separate: Column, compound: Column, tolerance: float = 0.05) -> Column:
    """struct<value, mismatch>: axes given on their own win over a compound size that differs by more than the tolerance."""
    off = F.abs(separate - compound) > tolerance * F.greatest(F.abs(separate), F.abs(compound))
    return F.struct(F.coalesce(separate, compound).alias("value"), F.coalesce(off, F.lit(False)).alias("mismatch"))


#: Words that tell variants of one model apart.
VARIANT_WORDS = ("белый", "черный", "серый", "серебристый", "бежевый", "красный", "синий", "графит", "inverter", "pro", "plus", "max", "mini", "lite")


def identity(name: Column, brand: Column) -> Column:
    """struct<brand, model, article, variant> of a product's name; look-alike letters are folded in the model."""
    article = F.regexp_extract(name, "\\(([A-Za-zА-Яа-я0-9./-]{4,})\\)\\s*$", 1)
    words = F.split(norm_key(name), " ")
    variant = F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in VARIANT_WORDS])))
    return F.struct(brand.alias("brand"), fold_lookalikes(F.nullif(model_token(name), F.lit(""))).alias("model"), F.nullif(article, F.lit("")).alias("article"), variant.alias("variant"))


def says_in_order(text: Column, phrase: Column) -> Column:
    """Whether the words of the phrase stand together in the text."""
    pad = lambda c: F.concat(F.lit(" "), norm_key(c), F.lit(" "))
    return (norm_key(phrase) != "") & F.contains(pad(text), pad(phrase))


def pages_of_products(pages: DataFrame, products: DataFrame) -> DataFrame:
    """(product_id, page_id, how): pages that name a product's article or model, the first page of each product.

    pages: page_id, text. products: product_id, model, article. Words of pages
    meet models in an equi-join; article counts before identity.
    """
    words = pages.select("page_id", F.explode(F.array_distinct(F.split(fold_lookalikes(squeeze(F.col("text"))), "[\\s,;:()]+"))).alias("word"))
    wanted = products.select("product_id", F.explode(F.array_compact(F.array(F.when(F.col("article").isNotNull(), F.struct(fold_lookalikes(F.col("article")).alias("word"), F.lit("article").alias("how"))), F.when(F.col("model").isNotNull(), F.struct(fold_lookalikes(F.col("model")).alias("word"), F.lit("identity").alias("how"))))) ).alias("w")).select("product_id", "w.*")
    hits = words.join(wanted, "word").groupBy("product_id").agg(F.min(F.struct("page_id", "how")).alias("f"))
    return hits.select("product_id", "f.page_id", "f.how")


#: Attribute, words that tell its value, words that must be absent, and the value; the first row that fits counts.
APPLIANCE_WORDS = (
    ("install", "установк[а-я]*\\s*[-–—:]\\s*[^,;\\n]*встраиваем", None, "Встраиваемая"),
    ("install", "установк[а-я]*\\s*[-–—:]\\s*[^,;\\n]*(?:отдельн|напольн|свободностоя)", None, "Отдельностоящая"),
    ("install", "встраиваем|встроенн", "отдельн(?:о\\s*)?стоя|напольн|свободностоя", "Встраиваемая"),
    ("install", ".", "встраиваем|встроенн", "Отдельностоящая"),
    ("load_type", "вертикал", None, "Вертикальная"),
    ("load_type", "фронтал|стиральн|стир\\.?\\s*маш", None, "Фронтальная"),
    ("washer_type", "полуавтомат", None, "Полуавтоматическая"),
    ("washer_type", "стиральн|стир\\.?\\s*маш", None, "Автоматическая"),
    ("freezer_pos", "side\\s*-?\\s*by\\s*-?\\s*side|сбоку", None, "Сбоку"),
    ("freezer_pos", "без морозил", None, "Отсутствует"),
    ("freezer_pos", "нижн|снизу", None, "Снизу"),
    ("freezer_pos", "верхн|сверху", None, "Сверху"),
    ("chambers", "четырехкамер|4-камер", None, "4"),
    ("chambers", "трехкамер|3-камер", None, "3"),
    ("chambers", "однокамер|1-камер", None, "1"),
    ("chambers", "двухкамер|2-камер|side\\s*-?\\s*by", None, "2"),
    ("fridge_type", "side\\s*-?\\s*by\\s*-?\\s*side", None, "Side-by-Side"),
    ("doors", "четырехдвер|4\\s*-?\\s*двер", None, "4"),
    ("doors", "трехдвер|3\\s*-?\\s*двер", None, "3"),
    ("doors", "однодвер|1\\s*-?\\s*двер", None, "1"),
    ("doors", "двухдвер|2\\s*-?\\s*двер", None, "2"),
)
#: Attributes that follow from others once these are known: attribute, the other one, its value, what follows.
APPLIANCE_LINKS = (
    ("fridge_type", "chambers", "3", "Трёхкамерный"), ("fridge_type", "chambers", "1", "Однокамерный"), ("fridge_type", "chambers", "2", "Двухкамерный"),
    ("doors", "fridge_type", "Однокамерный", "1"), ("doors", "fridge_type", "Двухкамерный", "2"),
)
#: Attributes that only washing machines and only fridges have.
WASHER_ONLY, FRIDGE_ONLY = ("load_type", "washer_type"), ("freezer_pos", "chambers", "fridge_type", "doors")


def derive_appliance(cards: DataFrame, text: str, kind: str) -> DataFrame:
    """cards with install, load_type, washer_type, freezer_pos, chambers, fridge_type and doors filled, where they are empty, from a card's text and kind.

    What the text says counts before what follows from other attributes, and
    these are read in the order in which they are filled. Accessories get none,
    dryers no washer's, and only fridges a fridge's.
    """
    said = fold(F.col(text))
    fits = {a: F.col(kind).isin("washer", "washer-dryer") for a in WASHER_ONLY} | {a: F.col(kind) == "fridge" for a in FRIDGE_ONLY}
    rules = []
    for target in dict.fromkeys(a for a, *_ in APPLIANCE_WORDS):
        right_kind = fits.get(target, F.col(kind) != "accessory")
        rules += [(target, right_kind & said.rlike(words) & (F.lit(True) if absent is None else ~said.rlike(absent)), F.lit(value)) for a, words, absent, value in APPLIANCE_WORDS if a == target]
        rules += [(target, right_kind & (F.col(other) == known), F.lit(value)) for a, other, known, value in APPLIANCE_LINKS if a == target]
    return apply_rules(cards, rules)
