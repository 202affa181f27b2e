"""A category's facet catalog: order and fallback of values, cleaning of uploaded facets, and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.display import display_value
from kartoteka.functions.text import fold, let, norm_key, value_fold
from kartoteka.functions.values import BARE_WORDS, is_value_fragment
from kartoteka.operators.cards import is_brand_key

STRINGS = "array<string>"


def _order_key(label: Column) -> Column:
    number = F.regexp_extract(label, "^-?\\d+(?:\\.\\d+)?", 0).try_cast("double")
    return F.struct(number.isNull().alias("text"), number.alias("n"), F.lower(label).alias("l"), label.alias("label"))


def ordered_labels(labels: Column) -> Column:
    """Labels in the order that people expect: by the number they begin with, then by their letters."""
    return F.transform(F.array_sort(F.transform(labels, _order_key)), lambda x: x["label"])


def shown_values(kind: Column, listed: Column, occupied: Column, int_values: Column, buckets: Column, canons: Column) -> Column:
    """The values a facet shows: the listed ones and then occupied ones; without a list those occupied; without any its fallback.

    Fallbacks: yes and no, the whole numbers allowed, bucket labels, or the canonical values.
    """
    none = F.array().cast(STRINGS)
    seeded, found = F.filter(F.coalesce(listed, none), lambda v: F.trim(v) != ""), F.coalesce(occupied, none)
    fallback = (
        F.when(kind == "boolean", F.array(F.lit("Есть"), F.lit("Нет")))
        .when((kind == "int_enum") & (F.size(int_values) > 0), F.transform(int_values, lambda x: x.cast("string")))
        .when((kind == "range") & (F.size(buckets) > 0), F.transform(buckets, lambda b: b["label"]))
        .otherwise(F.coalesce(canons, none))
    )
    return F.when(F.size(seeded) > 0, F.array_union(seeded, ordered_labels(found))).when(F.size(found) > 0, ordered_labels(found)).otherwise(fallback)


def facet_list(facets: DataFrame, counts: DataFrame) -> DataFrame:
    """(category, place, code, name, values): the facets of each category in their order, those without any value left out.

    facets: category, code, name, order, kind, listed, int_values, buckets, canons.
    counts: code, label, cnt; labels without products are not occupied.
    """
    occupied = counts.filter("cnt > 0").groupBy("code").agg(F.collect_set("label").alias("occupied"))
    named = facets.filter(~is_brand_key(F.col("code")) & ~is_brand_key(F.col("name"))).join(occupied, "code", "left")
    values = shown_values(*[F.col(c) for c in ("kind", "listed", "occupied", "int_values", "buckets", "canons")])
    rows = named.select("category", "code", "name", "order", values.alias("values")).filter(F.size("values") > 0)
    place = F.row_number().over(Window.partitionBy("category").orderBy("order", "name", "code"))
    return rows.select("category", place.alias("place"), "code", "name", "values")


def allowed_labels(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (id, code, value) whose attribute has canonical values only where the value is one of them; `label` as shown, null if barred."""
    canons = aliases.select("code", value_fold(F.col("canon")).alias("folded"), F.col("canon").alias("label")).distinct()
    strict = aliases.select("code").distinct().withColumn("strict", F.lit(True))
    joined = facts.withColumn("folded", value_fold(F.col("value"))).join(strict, "code", "left").join(canons, ["code", "folded"], "left")
    return joined.select("id", "code", "value", F.when(F.col("strict"), F.col("label")).otherwise(display_value(F.col("value"))).alias("label"))


def clean_facets(uploaded: DataFrame, facets: DataFrame, aliases: DataFrame, collapses: DataFrame) -> DataFrame:
    """(name, raw, canon, action, reason): what becomes of each value of an uploaded facet catalog: keep, map or drop.

    uploaded: name, value. facets: name, code, kind, strict. aliases: code,
    alias, canon. collapses: code (null: any), spelling, canon; known spellings
    that no dictionary has. Ranges and booleans stay as they are. A facet that
    is a brand, or that no dictionary has, goes with all its values.
    """
    rows = uploaded.select("name", F.trim("value").alias("raw")).filter("raw <> ''").distinct()
    known = rows.join(facets.select("name", "code", "kind", "strict"), "name", "left").withColumn("folded", value_fold(F.col("raw")))
    spelled = aliases.select("code", value_fold(F.col("alias")).alias("folded"), "canon").unionByName(aliases.select("code", value_fold(F.col("canon")).alias("folded"), "canon"))
    spelled = spelled.groupBy("code", "folded").agg(F.min("canon").alias("aliased"))
    forced = collapses.select(F.col("code").alias("for_code"), value_fold(F.col("spelling")).alias("folded"), F.col("canon").alias("collapsed"))
    own = forced.filter("for_code is not null").withColumnRenamed("for_code", "code").withColumnRenamed("collapsed", "own_collapsed")
    any_ = forced.filter("for_code is null").drop("for_code")
    joined = known.join(spelled, ["code", "folded"], "left").join(own, ["code", "folded"], "left").join(any_, "folded", "left")
    collapsed = F.coalesce("own_collapsed", "collapsed")
    again = joined.withColumn("turned", value_fold(collapsed)).join(spelled.select("code", F.col("folded").alias("turned"), F.col("aliased").alias("through")), ["code", "turned"], "left")
    as_is = F.col("kind").isin("range", "boolean")
    junk = fold(F.col("raw")).rlike(BARE_WORDS) | is_value_fragment(F.col("raw"))
    canon = F.when(as_is, F.col("raw")).when(F.col("strict"), F.coalesce("aliased", "through")).otherwise(F.coalesce("aliased", "through", collapsed))
    reason = (
        F.when(is_brand_key(F.col("name")), "brand_not_a_filter")
        .when(F.col("code").isNull(), "not_enabled_or_unknown")
        .when(~as_is & junk, "junk_or_wrong_axis")
        .when(canon.isNull() & F.col("strict"), "not_in_aliases")
        .when(canon.isNull(), "no_aliases_freeform")
    )
    action = F.when(reason.isNotNull(), "drop").when(value_fold(canon) != F.col("folded"), "map").otherwise("keep")
    return again.select("name", "raw", F.when(reason.isNull(), canon).alias("canon"), action.alias("action"), reason.alias("reason"))


def cleaned_catalog(cleaned: DataFrame) -> DataFrame:
    """(name, values) of clean_facets' result: what is left of each facet, in order; facets without a value are gone."""
    left = cleaned.filter("action <> 'drop'").groupBy("name").agg(F.collect_set("canon").alias("v"))
    return left.select("name", ordered_labels(F.col("v")).alias("values"))


def catalog_issues(uploaded: DataFrame, facets: DataFrame, pairs: DataFrame, wrong_axis: DataFrame) -> DataFrame:
    """(name, severity, kind, detail): unknown facets, single values, pairs of synonyms and values of another axis.

    uploaded: name, value. facets: name, code, kind. pairs: a, b (spellings of
    one value). wrong_axis: code, pattern, kind.
    """
    values = uploaded.select("name", "value").distinct()
    per_name = values.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("only")).join(facets.select("name", "code", "kind"), "name", "left")
    none = F.lit(None).cast("string")
    unknown = per_name.filter("code is null").select("name", F.lit("warn").alias("severity"), F.lit("unknown_facet").alias("kind"), none.alias("detail"))
    single = per_name.filter("code is not null and n = 1 and kind not in ('range', 'boolean')").select("name", F.lit("info").alias("severity"), F.lit("single_value").alias("kind"), F.col("only").alias("detail"))
    known = values.join(facets.select("name", "code"), "name").withColumn("folded", norm_key(F.col("value")))
    sides = pairs.select(norm_key(F.col("a")).alias("a"), norm_key(F.col("b")).alias("b"))
    left = known.select("name", F.col("folded").alias("a")).join(sides, "a")
    synonyms = left.join(known.select("name", F.col("folded").alias("b")), ["name", "b"]).select("name", F.lit("error").alias("severity"), F.lit("synonym_pair").alias("kind"), F.concat_ws(" + ", "a", "b").alias("detail"))
    axis = known.join(wrong_axis.select("code", "pattern", F.col("kind").alias("fault")), "code").filter(F.expr("lower(value) rlike pattern")).select("name", F.lit("error").alias("severity"), F.col("fault").alias("kind"), F.col("value").alias("detail"))
    return unknown.unionByName(single).unionByName(synonyms.distinct()).unionByName(axis)


def dirty_values(catalog: DataFrame, facets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, value, kind): values that must not be shown: fragments of other facts, and values outside a strict dictionary."""
    canons = aliases.select("code", value_fold(F.col("canon")).alias("folded")).distinct().withColumn("listed", F.lit(True))
    rows = catalog.join(facets.select("name", "code", "kind", "strict"), "name").filter(~F.col("kind").isin("range", "boolean")).withColumnRenamed("kind", "facet_kind").withColumn("folded", value_fold(F.col("value")))
    kind = F.when(fold(F.col("value")).rlike(BARE_WORDS) | is_value_fragment(F.col("value")), "dirty_value").when(F.col("strict") & F.col("listed").isNull(), "not_in_aliases")
    return rows.join(canons, ["code", "folded"], "left").select("name", "value", kind.alias("kind")).filter("kind is not null")


def storefront_role(enabled: Column, status: Column, tier: Column, highlight: Column, required: Column, code: Column) -> Column:
    """required, optional or none: the part an attribute plays among the filters; an explicit flag beats highlight and tier A."""
    shown = F.coalesce(enabled, F.lit(False)) & (F.coalesce(status, F.lit("")) != "not_a_filter") & (F.coalesce(tier, F.lit("")) != "X") & ~is_brand_key(code)
    asked = F.coalesce(required, F.coalesce(highlight, F.lit(False)) | (F.coalesce(tier, F.lit("")) == "A"))
    return F.when(~shown, "none").when(asked, "required").otherwise("optional")


def approved_keys(sheet: DataFrame, renames: DataFrame) -> DataFrame:
    """(name, key, approved): every key under which a line of the approval sheet may stand, renames followed both ways.

    sheet: name, approved. renames: old, new.
    """
    own = sheet.select("name", F.trim("name").alias("key"), "approved")
    ahead = own.join(renames.select(F.col("old").alias("key"), "new"), "key").select("name", F.col("new").alias("key"), "approved")
    canon = own.join(ahead.select("name", F.col("key").alias("target")), "name", "left").select("name", "approved", F.coalesce("target", "key").alias("target"))
    back = canon.join(renames.select("old", F.col("new").alias("target")), "target").select("name", F.col("old").alias("key"), "approved")
    return own.unionByName(ahead).unionByName(back).distinct()


def classified_keys(keys: DataFrame, approved: DataFrame) -> DataFrame:
    """keys (key) with `kind`: forbidden before approved before unlisted; blank keys are skipped."""
    per_key = approved.groupBy("key").agg(F.bool_and("approved").alias("ok"))
    kind = F.when(F.trim("key") == "", "skip").when(~F.col("ok"), "forbidden").when(F.col("ok"), "approved").otherwise("unlisted")
    return keys.join(per_key, "key", "left").select("key", kind.alias("kind"))


#: Words of names, in the order in which they decide a product's kind.
KINDS = (
    ("accessory", "соединительн|элемент\\s*ck|комплект\\s*для\\s*колонн|переходник", "стиральн|стир\\.?\\s*машин|ст[\\s-]?маш|холодильник"),
    ("dryer", "сушильн|суш(?:ильная)?\\s*маш", "стиральн|стир\\.?\\s*машин|ст[\\s-]?маш"),
    ("washer-dryer", "стирально[-\\s]?сушильн|с\\s+сушкой|с\\s+функци(?:ей|я)\\s+сушк|\\bHWD\\d|сушка\\s*[-–—:]\\s*(?:да|есть|\\+)|для\\s+сушки|\\(\\s*сушка\\s*\\)|(?:загрузк[а-яёa-z]*|цикл[ае]?)\\s+[^\\n.]{0,32}сушк", None),
    ("washer", "стиральн|стир\\.?\\s*машин|ст[\\s-]?маш", None),
    ("fridge", "холодильник", None),
    ("hood", "вытяжк|воздухоочист", None),
)


def product_kind(name: Column, extra: Column | None = None) -> Column:
    """The kind of a product by its name, and where that leaves it open by its texts; a Latin C before Cyrillic counts as Cyrillic."""

    def kind(c: Column) -> Column:
        out = None
        for label, has, not_ in KINDS:
            hit = c.rlike(f"(?iu){has}") & (F.lit(True) if not_ is None else ~c.rlike(f"(?iu){not_}"))
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out.otherwise("other")

    plain = lambda c: F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), "[Cc](?=[а-яёА-ЯЁ])", "с"), "ё", "е")
    by_name = let(plain(name), kind)
    if extra is None:
        return by_name
    by_all = let(plain(F.concat_ws("\n", name, extra)), kind)
    return F.when(by_name.isin("dryer", "accessory", "fridge", "hood"), by_name).when(by_all == "washer-dryer", by_all).when(by_name.isin("washer", "washer-dryer"), by_name).otherwise(by_all)


#: Where a product of a foreign kind belongs, by the category it stands in.
SUGGESTED = {("accessory", 467): 487}


def suggested_category(kind: Column, category: Column) -> Column:
    """The category a product of a kind should move to from its own; null where none is known."""
    out = F.lit(None).cast("long")
    for (of, at), to in SUGGESTED.items():
        out = F.when((kind == of) & (category == at), F.lit(to).cast("long")).otherwise(out)
    return out


def fits_category(kind: Column, expected: Column) -> Column:
    """Whether a product of a kind belongs in a category of the expected one; unknown kinds and categories always do."""
    return expected.isNull() | (kind == expected) | (kind == "other") | ((expected == "washer") & (kind == "washer-dryer"))
