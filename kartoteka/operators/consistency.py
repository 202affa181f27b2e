"""Whether a card's surfaces (facts, filters, annotation, description) agree, what to do where they do not, and dictionary upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.display import display_value
from kartoteka.functions.text import fold, let, squeeze, strip_html, value_fold
from kartoteka.functions.values import BARE_WORDS, as_number, refrigerant
from kartoteka.operators.normalise import alias_values, match_pairs
from kartoteka.operators.resolve import source_rank
from kartoteka.storage import computed_once

#: Sources whose facts may become filters; a model's word and reviews may not.
FILTER_SOURCES = ("S0", "S1", "S2", "S3", "source_json", "manufacturer", "official_product_page", "trusted_retailer", "major_retailer", "retailer", "distributor")
#: Words of shops' calls to buy.
SALES_WORDS = "(?iu)купить|заказать|доставк|скидк|цена|корзин|акци[яию]|магазин"
#: Phrases of unproven praise.
PRAISE = "(?iu)лучш(?:ий|ая|ее)\\s+(?:в\\s+мире|на\\s+рынке)|не\\s+имеет\\s+аналогов|революционн|уникальн(?:ая|ый)\\s+технологи|гарантирует\\s+идеальн|номер\\s+один"
#: Issue kinds by what mends them, in the order in which they are handled.
DECISIONS = (("fabrication", "strip"), ("annotation_duplicate", "strip"), ("not_in_aliases", "map"), ("bucket", "recompute"), ("cross_field", "align"), ("contradiction", "align"))


def usable_facts(facts: DataFrame, sources: tuple[str, ...] = FILTER_SOURCES) -> DataFrame:
    """Facts (id, code, value, level) that may become filters: of an allowed source, or of a product without any source at all."""
    traced = facts.groupBy("id").agg(F.bool_or(F.col("level").isNotNull()).alias("traced"))
    return facts.join(traced, "id").filter(~F.col("traced") | F.coalesce(F.col("level").isin(*sources), F.lit(False))).drop("traced")


def facets_of_rows(rows: DataFrame, filters: str) -> DataFrame:
    """(code, labels, products): the facet catalog that exported rows (filters map<code, array<label>>) add up to."""
    flat = rows.select("id", F.explode(filters).alias("code", "labels")).select("id", "code", F.explode("labels").alias("label"))
    return flat.groupBy("code").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.countDistinct("id").alias("products"))


def surface_truth(surfaces: DataFrame) -> DataFrame:
    """(id, code, value, surface, agreed): the value that holds for each attribute of a card, and whether all its surfaces say it.

    surfaces: id, code, surface (fact, annotation, filter, description), value,
    level. A fact of a source of rank 30 or more counts first, then the
    annotation, then any fact, the filter, the description.
    """
    strong = (F.col("surface") == "fact") & (source_rank(F.col("level")) >= 30)
    place = F.when(strong, 0).when(F.col("surface") == "annotation", 1).when(F.col("surface") == "fact", 2).when(F.col("surface") == "filter", 3).otherwise(4)
    told = surfaces.filter("coalesce(value, '') <> ''")
    best = F.min(F.struct(place.alias("p"), F.col("surface"), F.col("value"))).alias("b")
    return told.groupBy("id", "code").agg(best, F.countDistinct(value_fold(F.col("value"))).alias("n")).select("id", "code", "b.value", "b.surface", (F.col("n") == 1).alias("agreed"))


def topic_report(cards: DataFrame, topics: dict[str, str], id_col: str, description: str, annotation: str) -> DataFrame:
    """(topic, mentions, ok, problem): how many descriptions name each topic (name: pattern), and in how many the annotation backs it; per cent of the rest."""
    said = lambda c, p: F.coalesce(F.col(c), F.lit("")).rlike(f"(?iu){p}")
    counts = cards.agg(*[F.count_if(said(description, p)).alias(f"m{i}") for i, p in enumerate(topics.values())], *[F.count_if(said(description, p) & said(annotation, p)).alias(f"o{i}") for i, p in enumerate(topics.values())])
    rows = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"m{i}").alias("mentions"), F.col(f"o{i}").alias("ok")) for i, t in enumerate(topics)])
    flat = counts.select(F.explode(rows).alias("r")).select("r.*")
    return flat.withColumn("problem", F.coalesce(F.floor(F.try_divide((F.col("mentions") - F.col("ok")) * 100, F.col("mentions")) + 0.5), F.lit(0)))


def topic_issues(cards: DataFrame, topics: dict[str, str], id_col: str, description: str, annotation: str) -> DataFrame:
    """(id, topic, kind): topics that a description claims and its annotation denies (contradiction) or does not know (fabrication)."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = []
    for topic, p in topics.items():
        denied = text(annotation).rlike(f"(?iu)(?:{p})[^\\n.;<]{{0,30}}(?:[-–—:]\\s*нет|отсутств)")
        claimed = text(description).rlike(f"(?iu){p}") & ~text(description).rlike(f"(?iu)(?:без|нет)\\s+(?:{p})")
        kind = F.when(claimed & denied, "contradiction").when(claimed & ~text(annotation).rlike(f"(?iu){p}"), "fabrication")
        found.append(F.when(kind.isNotNull(), F.struct(F.lit(topic).alias("topic"), kind.alias("kind"))))
    return cards.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.topic", "f.kind")


def claim_issues(text: Column) -> Column:
    """Kinds of claims that no fact can back: unproven praise, and a denied radio without a source."""
    t = F.coalesce(text, F.lit(""))
    denied = "(?iu)(?:wi-?fi|вай[\\s-]?фай)[^\\n.]{0,20}(?:нет|отсутств|не\\s+поддерж)|(?:нет|отсутств|не\\s+поддерж)[^\\n.]{0,20}(?:wi-?fi|вай[\\s-]?фай)"
    return F.array_compact(F.array(F.when(t.rlike(PRAISE), "praise"), F.when(t.rlike(denied), "negative_without_source")))


def shared_raw(facts: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(id, code, other, raw): attributes that must be told apart but were both read from one raw key. facts: id, code, raw."""
    sides = facts.sparkSession.createDataFrame(pairs, "code string, other string")
    mine = facts.join(sides, "code").select("id", "code", "other", "raw")
    return mine.join(facts.select("id", F.col("code").alias("other"), "raw"), ["id", "other", "raw"]).select("id", "code", "other", "raw")


def confirmed(facts: DataFrame, conflicts: DataFrame, least_rank: int = 15) -> DataFrame:
    """(id, confirmed, total, share): facts of a source of enough rank without an open conflict, of all facts of the product."""
    open_ = conflicts.filter("needs_review").select("id", "code").distinct().withColumn("open", F.lit(True))
    sure = (source_rank(F.col("level")) >= least_rank) & F.col("open").isNull()
    counts = facts.join(open_, ["id", "code"], "left").groupBy("id").agg(F.count_if(sure).alias("confirmed"), F.count("*").alias("total"))
    return counts.withColumn("share", F.round(F.col("confirmed") / F.col("total"), 4))


def decided(issues: DataFrame) -> DataFrame:
    """issues (id, code, kind...) with `decision` and `place`: what mends each, the first handled first; unknown kinds are for people."""
    decision = place = None
    for i, (kind, action) in enumerate(DECISIONS):
        hit = F.col("kind") == kind
        decision = F.when(hit, action) if decision is None else decision.when(hit, action)
        place = F.when(hit, i) if place is None else place.when(hit, i)
    return issues.withColumn("decision", decision.otherwise("review")).withColumn("place", place.otherwise(len(DECISIONS)))


def applied(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """facts (id, code, value) after the first decision (decision, place, new_value) on each: strip empties, map and align take the new value, others stay."""
    first = decisions.groupBy("id", "code").agg(F.min_by(F.struct("decision", "new_value"), F.struct("place", "decision")).alias("d"))
    value = F.when(F.col("d.decision") == "strip", None).when(F.col("d.decision").isin("map", "align"), F.coalesce("d.new_value", "value")).otherwise(F.col("value"))
    return facts.join(first, ["id", "code"], "left").select("id", "code", value.alias("value"), F.coalesce("d.decision", F.lit("keep")).alias("decision"))


def report_sections(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, name, value): the parts of a report, each given as (name, value), in one table."""
    out = None
    for name, part in sections.items():
        rows = part.select(F.lit(name).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def page_prose(html: Column, least: int = 40, most: int = 2000) -> Column:
    """The sentences of a page of more than `least` characters that sell nothing, up to `most` characters."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<(script|style|noscript|svg|template)(?:\\s[^>]*)?>.*?</\\1>", " ")
    blocks = F.transform(F.split(body, "(?i)</?(?:p|div|li|td|tr|br|h[1-6]|article|section|nav|footer|ul)[^>]*>"), strip_html)
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, "(?<=[.!?])\\s+")))
    kept = F.filter(F.transform(sentences, squeeze), lambda s: (F.length(s) > least) & ~s.rlike(SALES_WORDS))
    return F.left(F.array_join(kept, " "), F.lit(most))


def merged_aliases(aliases: DataFrame) -> DataFrame:
    """(code, alias, canon): a canonical value that is a spelling of another one joins it; canons are written as shown.

    aliases: code, alias, canon.
    """
    shown = aliases.select("code", "alias", F.coalesce(F.nullif(display_value(F.col("canon")), F.lit("")), F.col("canon")).alias("canon"))
    every = shown.unionByName(shown.select("code", F.col("canon").alias("alias"), "canon")).withColumn("folded", value_fold(F.col("alias"))).distinct()
    canons = shown.select("code", "canon", value_fold(F.col("canon")).alias("folded")).distinct()
    into = canons.join(every.select("code", "folded", F.col("canon").alias("target")), ["code", "folded"]).filter(value_fold(F.col("target")) != F.col("folded"))
    target = into.groupBy("code", "canon").agg(F.min("target").alias("target"))
    joined = every.join(target, ["code", "canon"], "left").withColumn("final", F.coalesce("target", "canon"))
    return joined.groupBy("code", "folded", F.col("final").alias("canon")).agg(F.min("alias").alias("alias")).select("code", "alias", "canon")


def implied_value(key: Column, name: Column) -> Column:
    """The value that a key itself says where its answer is yes ("Инверторный двигатель: да"); null where it only names the attribute."""
    words = "(?iu)(?<![а-яёa-z])(?:тип|вид|двигател[а-яё]*|мотор[а-яё]*|engine|motor|освещен[а-яё]*|подсветк[а-яё]*|lighting)(?![а-яёa-z])"
    bare = squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(key, F.lit("")), "\\s*\\([^)]*\\)\\s*", " "), words, " "))
    said = lambda b: F.when(fold(b) == "led", "Светодиодное").otherwise(display_value(b))
    known = lambda v: F.when((v != "") & ~fold(v).rlike(BARE_WORDS) & (value_fold(v) != value_fold(name)), v)
    return F.when(value_fold(key) != value_fold(name), let(let(bare, said), known))


def same_value(a: Column, b: Column) -> Column:
    """Whether two values are one: equal refrigerant codes or spellings, or both a word for LED."""
    led = lambda c: let(value_fold(display_value(c)), lambda v: F.when((v == "led") | v.startswith("светодиодн"), "led").otherwise(v))
    gases = refrigerant(a).isNotNull() & refrigerant(b).isNotNull()
    return F.coalesce(F.when(gases & (value_fold(refrigerant(a)) == value_fold(refrigerant(b))), F.lit(True)).otherwise(led(a) == led(b)), F.lit(False))


def mapped_values(facts: DataFrame, aliases: DataFrame, skipped: DataFrame) -> DataFrame:
    """facts (id, code, value) under the dictionary: the canonical value, null where the value is to be skipped, `pending` where the dictionary does not know it.

    aliases: code, alias, canon. skipped: code, value. Attributes without aliases stay as they are.
    """
    strict = aliases.select("code").distinct().withColumn("strict", F.lit(True))
    out = skipped.select("code", value_fold(F.col("value")).alias("folded")).distinct().withColumn("skip", F.lit(True))
    joined = alias_values(facts, aliases).withColumn("folded", value_fold(F.col("value"))).join(out, ["code", "folded"], "left").join(strict, "code", "left")
    value = F.when(F.col("skip"), None).when(F.col("strict"), F.col("canon")).otherwise(F.col("value"))
    return joined.select("id", "code", value.alias("value"), (F.col("skip").isNull() & F.coalesce(F.col("strict"), F.lit(False)) & F.col("canon").isNull()).alias("pending"))


def suggested_attributes(lines: DataFrame, synonyms: DataFrame, blacklist: DataFrame, least: float = 0.72) -> DataFrame:
    """(line, key, value, code, how): "key — value" lines of an import with the attribute that each key may be.

    Lines are computed once: the filter on their keys would else be pushed to
    the rows they come from.
    """
    lines = computed_once(lines)
    parts = F.split(squeeze(F.col("line")), "\\s+[-–—]\\s+|\\s*:\\s+|\\t", 2)
    rows = lines.select("line", squeeze(F.get(parts, F.lit(0))).alias("key"), F.coalesce(squeeze(F.get(parts, F.lit(1))), F.lit("")).alias("value")).filter("key <> ''")
    return rows.join(match_pairs(rows, synonyms, blacklist, least), ["key", "value"]).select("line", "key", "value", "code", "how")


#: A triple of measures with the words before and after it.
TRIPLE = "([^0-9]{0,140}?)(\\d+(?:[.,]\\d+)?)\\s*[xх×*]\\s*(\\d+(?:[.,]\\d+)?)\\s*[xх×*]\\s*(\\d+(?:[.,]\\d+)?)(?=([^0-9]{0,36}))"
AXES = "([швгд])\\s*[xх×]\\s*([швгд])\\s*[xх×]\\s*([швгд])"


def best_size(text: Column) -> Column:
    """struct<width, height, depth> in centimetres of the best triple of a text: net with named axes, then net, then any.

    Axes are named by letters near the triple, before it or after it; without
    them the order is width, depth, height. Without a unit 400 and more are
    millimetres.
    """

    def triple(x: Column) -> Column:
        raw = F.transform(F.array(x["a"], x["b"], x["c"]), as_number)
        near = F.concat_ws(" ", x["before"], x["after"])
        mm = near.rlike("(?<![а-яёa-z])мм(?![а-яё])") | (~near.rlike("(?<![а-яёa-z])см(?![а-яё])") & (F.array_max(raw) >= 400))
        letters = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(x["before"], AXES, 0), "[^швгд]", ""), F.lit("")), F.nullif(F.regexp_replace(F.regexp_extract(x["after"], f"^\\s*(?:мм|см)?\\.?\\s*(\\(\\s*{AXES})", 1), "[^швгд]", ""), F.lit("")))
        order = F.translate(F.coalesce(letters, F.lit("шгв")), "д", "г")
        cm = F.transform(raw, lambda n: F.when(mm, n / 10).otherwise(n))
        size = F.struct(*[F.get(cm, F.locate(letter, order) - 1).alias(axis) for letter, axis in (("ш", "width"), ("в", "height"), ("г", "depth"))])
        packed = x["before"].rlike("упаковк|брутто|в коробк") & ~x["before"].rlike("без\\s+упаковк")
        return F.struct(packed.alias("packed"), letters.isNull().alias("unnamed"), x["i"].alias("i"), size.alias("size"))

    t = fold(text)
    group = lambda i: F.regexp_extract_all(t, F.lit(TRIPLE), F.lit(i))
    found = F.transform(F.arrays_zip(*[group(i).alias(n) for i, n in enumerate(("before", "a", "b", "c", "after"), 1)]), lambda x, i: F.struct(x["before"].alias("before"), x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), x["after"].alias("after"), i.alias("i")))
    return F.array_min(F.transform(found, triple))["size"]


def annotation_html(lines: Column) -> Column:
    """A list of the card's lines, each once whatever its case; empty without any."""
    once = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: (F.coalesce(x["t"], F.lit("")) != "") & ~F.exists(F.slice(lines, F.lit(1), x["i"]), lambda b: F.coalesce(F.lower(b) == F.lower(x["t"]), F.lit(False))))
    return let(once, lambda o: F.when(F.size(o) > 0, F.concat(F.lit("<ul>"), F.array_join(F.transform(o, lambda x: F.concat(F.lit("<li>"), x["t"], F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise(""))


def compact_html(html: Column) -> Column:
    """Without white space between tags, and with single spaces elsewhere."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "\\s+", " "), "\\s*(</?(?:ul|li|p|br)[^>]*>)\\s*", "$1"))


def meta_keywords(phrases: Column, most: int = 9) -> Column:
    """Phrases joined by commas, each once whatever its case, at most `most`."""
    clean = F.filter(F.transform(phrases, squeeze), lambda p: F.coalesce(p, F.lit("")) != "")
    once = lambda c: F.filter(F.transform(c, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: ~F.exists(F.slice(c, F.lit(1), x["i"]), lambda b: F.lower(b) == F.lower(x["p"])))
    return let(clean, lambda c: F.array_join(F.slice(F.transform(once(c), lambda x: x["p"]), 1, most), ", "))


def filled_from_text(cards: DataFrame, patterns: dict[str, dict[str, str]], text: str) -> DataFrame:
    """cards with each column (column: {value: pattern}) filled, where it is empty, by the first value whose pattern the text matches."""
    t = F.coalesce(F.col(text), F.lit(""))
    for column, values in patterns.items():
        out = None
        for value, pattern in values.items():
            hit = t.rlike(f"(?iu){pattern}")
            out = F.when(hit, value) if out is None else out.when(hit, value)
        cards = cards.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), out) if column in cards.columns else out)
    return cards


