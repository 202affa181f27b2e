"""Cards: facts out of their texts, what may be enriched, dumps merged in, and the shapes they leave in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.display import looks_dumped, without_legal_tail
from kartoteka.functions.text import fold, norm_key, squeeze
from kartoteka.operators.pairs import pairs_of_attributes
from kartoteka.operators.parsing import text_pairs

#: A description without key words is believed from so many pairs on.
FEWEST_PAIRS = 3


def product_facts(cards: DataFrame, synonyms: DataFrame, required: DataFrame) -> DataFrame:
    """(id, source, seq, key, value, via, code): shop attributes (S0), the annotation (S1), and of the description (S2) what is missing.

    cards: id, attributes, annotation, description. The description counts only
    where a required attribute (code) is still open: whole, if it is a dump or
    nothing else speaks and it has three pairs; else the pairs that fill a hole.
    """
    told = text_pairs(cards, {"annotation": "S1", "description": "S2"}, synonyms, keep={"dump": looks_dumped(F.col("description"))})
    shop = cards.select("id", F.lit(False).alias("dump"), F.posexplode_outer(pairs_of_attributes(F.col("attributes"))).alias("at", "p"))  # the outer form, or a filter would compute the pairs once more; whether it is a dump counts for descriptions alone
    seq = F.struct(F.lit(0).alias("part"), F.col("at").alias("line"), F.lit(0).alias("phrase"), F.lit(0).alias("step"))
    shop = shop.select("id", "dump", F.lit("S0").alias("source"), seq.alias("seq"), F.col("p.key").alias("key"), without_legal_tail(F.col("p.value")).alias("value"), F.lit("attr").alias("via")).filter("value <> ''")
    known = synonyms.select(norm_key(F.col("synonym")).alias("normal"), "code", "order").groupBy("normal").agg(F.min_by("code", F.struct("order", "code")).alias("code"))
    shop = shop.withColumn("normal", norm_key(F.col("key"))).join(known, "normal", "left").drop("normal")
    needed = required.select("code").distinct()
    marked = told.unionByName(shop).join(needed.withColumn("needed", F.lit(True)), "code", "left").crossJoin(F.broadcast(needed.agg(F.count("*").alias("n_required"))))
    own, early = Window.partitionBy("id"), F.col("source").isin("S0", "S1")
    hole = F.when(F.col("needed"), F.col("code"))
    judged = marked.withColumns({"held": F.collect_set(F.when(early, hole)).over(own), "early": F.count_if(early).over(own), "late": F.count_if(~early).over(own)})
    whole = F.col("dump") | ((F.col("early") == 0) & (F.col("late") >= FEWEST_PAIRS))
    fills = ~F.col("dump") & (F.col("early") > 0) & F.coalesce(F.col("needed"), F.lit(False)) & ~F.array_contains("held", F.coalesce("code", F.lit("")))
    wanted = early | ((F.size("held") < F.col("n_required")) & (whole | fills))
    return judged.filter(wanted).select("id", "source", "seq", "key", "value", "via", "code")


def pair_traces(pairs: DataFrame) -> DataFrame:
    """(id, source, via, cnt, keys): where each card's facts were found, for its log."""
    return pairs.groupBy("id", "source", "via").agg(F.count("*").alias("cnt"), F.array_join(F.array_sort(F.collect_set("key")), ", ").alias("keys"))


def enrichable(text: Column, facts: Column, least: int = 100) -> Column:
    """struct<ok, reason>: a card without text has nothing to enrich, nor has a short one without a single fact."""
    size = F.length(squeeze(F.coalesce(text, F.lit(""))))
    reason = F.when(size == 0, "no_text").when((size < least) & (F.coalesce(facts, F.lit(0)) == 0), "short_without_facts")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def fact_counts(products: DataFrame, facts: DataFrame, least: int = 5) -> DataFrame:
    """(id, facts, thin): filled facts of each product (a brand that the shop itself told does not count), and whether they are few."""
    filled = facts.filter((F.coalesce("value", F.lit("")) != "") & ~((F.col("code") == "brand") & (F.col("level") == "S0")))
    counted = filled.groupBy("id").agg(F.countDistinct("code").alias("facts"))
    joined = products.select("id").join(counted, "id", "left").select("id", F.coalesce("facts", F.lit(0)).cast("long").alias("facts"))
    return joined.withColumn("thin", F.col("facts") < least)


def needs_lookup(products: DataFrame, facts: DataFrame, wanted: DataFrame, least: int = 5) -> DataFrame:
    """(id, thin, missing): identifiable products (model) with few facts, or without some of the wanted codes."""
    counts = fact_counts(products, facts, least)
    asked = wanted.select("code").distinct()
    held = facts.filter("coalesce(value, '') <> ''").select("id", "code").join(asked, "code", "left_semi").groupBy("id").agg(F.collect_set("code").alias("held"))
    everything = asked.agg(F.collect_set("code").alias("all"))  # one row, as long as the dictionary
    none = F.array().cast("array<string>")
    lacking = F.array_sort(F.array_except("all", F.coalesce("held", none)))
    missing = products.select("id").distinct().join(held, "id", "left").crossJoin(F.broadcast(everything)).select("id", lacking.alias("missing"))
    joined = products.filter(F.coalesce("model", F.lit("")) != "").select("id").join(counts, "id").join(missing, "id", "left")
    return joined.select("id", "thin", F.coalesce("missing", none).alias("missing")).filter(F.col("thin") | (F.size("missing") > 0))


def merge_dump_texts(cards: DataFrame, dump: DataFrame, key: str) -> DataFrame:
    """cards with annotation and description of the dump before their own where the two differ, and its name where they have none."""
    theirs = dump.select(key, *[F.col(c).alias(f"dump_{c}") for c in ("name", "annotation", "description")])
    filled = lambda c: F.nullif(squeeze(F.col(c)), F.lit(""))

    def merged(c: str, between: str) -> Column:
        own, other = filled(c), filled(f"dump_{c}")
        return F.when(own.isNull() | other.isNull() | (own == other), F.coalesce(other, F.col(c))).otherwise(F.concat_ws(between, other, own)).alias(c)

    changed = {"annotation": merged("annotation", "<br>"), "description": merged("description", " "), "name": F.coalesce(filled("name"), filled("dump_name"), F.col("name")).alias("name")}
    return cards.join(theirs, key, "left").select(*[changed.get(c, F.col(c)) for c in cards.columns])


#: Words of names that say nothing about the model.
GENERIC_NAME = "^(?:стиральн|машин|холодильник|вытяжк|бел|черн|фронтальн|вертикальн|отдельностоящ|встраиваем|автоматическ)[а-я]*$|^(?:для|кг|см|мм)$"


def name_tokens(name: Column) -> Column:
    """Words of three letters or more that may tell a product apart."""
    return F.filter(F.split(fold(name), "[^a-z0-9а-я]+"), lambda t: (F.length(t) >= 3) & ~t.rlike(GENERIC_NAME))


def same_product(a: Column, b: Column) -> Column:
    """Whether two names share a word that tells products apart."""
    return F.coalesce(F.arrays_overlap(name_tokens(a), name_tokens(b)), F.lit(False))


def ready_for_export(cards: DataFrame, enriched: str) -> DataFrame:
    """The enriched cards, or all of them if none is; one look at whether there is one."""
    any_ = cards.agg(F.coalesce(F.bool_or(F.col(enriched).isNotNull()), F.lit(False)).alias("any_enriched"))
    return cards.crossJoin(F.broadcast(any_)).filter(F.col(enriched).isNotNull() | ~F.col("any_enriched")).drop("any_enriched")


def with_context(rows: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """rows joined with their sources; a column that both have is the row's, present nulls included, unless the row has no source column."""
    others = [c for c in sources.columns if c != key and c not in rows.columns]
    return rows.join(sources.select(key, *others), key, "left")


def customer_rows(cards: DataFrame, filters: DataFrame) -> DataFrame:
    """The six fields of an export, in order: id, meta_keywords, description_html, annotation_html, filters, web_info.

    filters: id, code, label; labels are arrays, and brands are no filters.
    """
    listed = filters.filter(~is_brand_key(F.col("code"))).groupBy("id", "code").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    maps = listed.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "labels")))).alias("filters"))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return cards.join(maps, "id", "left").select("id", empty("meta_keywords").alias("meta_keywords"), empty("description_html").alias("description_html"), empty("annotation_html").alias("annotation_html"), F.coalesce("filters", F.create_map().cast("map<string,array<string>>")).alias("filters"), empty("web_info").alias("web_info"))


def is_brand_key(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("бренд", "brand")


def without_dictionary(cards: DataFrame) -> DataFrame:
    """Cards of a category without a dictionary: those with a text, no filters, each to be reviewed."""
    kept = cards.filter((F.coalesce("annotation_html", F.lit("")) != "") | (F.coalesce("description_html", F.lit("")) != ""))
    return kept.select("id", "description_html", "annotation_html", F.create_map().cast("map<string,array<string>>").alias("filters"), F.lit("no_dictionary").alias("review"))


def photo_rows(items: DataFrame) -> DataFrame:
    """Described photos as training rows: image, caption, objects, description, alt, tags, attributes, product_id, image_id."""
    text = lambda *names: F.coalesce(*[F.nullif(squeeze(F.col(n).cast("string")), F.lit("")) for n in names], F.lit(""))
    tags = F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), squeeze), lambda t: t != ""))
    shown = items.filter(F.col("status").isin("described", "ready"))
    return shown.select(text("name", "filename").alias("image"), text("caption").alias("caption"), text("on_image").alias("objects"), text("description").alias("description"), text("alt").alias("alt"), tags.alias("tags"), F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"), text("product_id").alias("product_id"), text("id").alias("image_id"))


def slim_offer(params: Column, most: int = 40, key_chars: int = 80, value_chars: int = 300) -> Column:
    """The first `most` parameters (array<struct<name, value>>) of an offer as a map, both sides cut to a length; null without any."""
    named = F.filter(params, lambda p: p["name"].isNotNull())
    entries = F.transform(F.slice(named, 1, most), lambda p: F.struct(F.left(p["name"], F.lit(key_chars)).alias("k"), F.left(F.coalesce(p["value"], F.lit("")), F.lit(value_chars)).alias("v")))
    first = F.filter(F.transform(entries, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, F.lit(1), e["i"]), lambda b: b["k"] == e["k"]))
    return F.when(F.size(first) > 0, F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"]))))


def offer_facts(offers: DataFrame) -> DataFrame:
    """(id, name, category, brand, article, specs): an offer as a readable block of facts."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return offers.select("id", "name", filled("category").alias("category"), filled("brand").alias("brand"), filled("sku").alias("article"), slim_offer(F.col("params"), most=1 << 20, key_chars=1 << 20, value_chars=1 << 20).alias("specs"))
