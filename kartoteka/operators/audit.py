"""Checks of cards against their facts: filters, numbers and values in texts, rules, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.text import let, norm_key, value_fold
from kartoteka.functions.values import agrees, as_number
from kartoteka.operators.facets import facet_labels

#: Numbers of a text with the word after them.
MEASURE = "(\\d+(?:[.,]\\d+)?)[\\s\\u00A0]*(\\p{L}+|%)"
#: Words before a value that deny it.
NEGATIONS = ("не", "нет", "без", "кроме", "not", "no", "without")


def wrong_labels(assigned: DataFrame, facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, code, assigned, expected): labels that the facts do not give, either way round."""
    expected = facet_labels(facts, attributes).select(F.col("id").alias("_id"), F.col("code").alias("_code"), F.col("label").alias("expected")).filter("expected is not null").distinct()
    own = assigned.select("id", "code", F.col("label").alias("assigned")).distinct()
    odd = own.join(expected, F.expr("id = _id and code = _code and assigned = expected"), "full").filter("assigned is null or expected is null")
    return odd.select(F.coalesce("id", "_id").alias("id"), F.coalesce("code", "_code").alias("code"), "assigned", "expected")


def measures(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, unit) of every number with a word after it, once a text."""
    found = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(MEASURE), F.lit(1)).alias("n"), F.regexp_extract_all(text_col, F.lit(MEASURE), F.lit(2)).alias("u"))
    return texts.select(F.col(id_col).alias("id"), F.explode(found).alias("m")).select("id", as_number(F.col("m.n")).alias("number"), F.lower("m.u").alias("unit")).distinct()


def unverified_measures(texts: DataFrame, id_col: str, text_col: str, facts: DataFrame) -> DataFrame:
    """Measures of a text that no fact (id, number, unit) of its card confirms."""
    return measures(texts, id_col, text_col).join(facts.select("id", "number", "unit"), ["id", "number", "unit"], "left_anti")


def measure_mismatches(texts: DataFrame, id_col: str, text_col: str, facts: DataFrame, least: float = 0.05, relative: float = 0.01) -> DataFrame:
    """(id, unit, number, fact): measures whose unit has facts, none of which agrees within the tolerance; the nearest fact is told."""
    joined = measures(texts, id_col, text_col).join(facts.select("id", "unit", F.col("number").alias("fact")), ["id", "unit"])
    nearest = joined.groupBy("id", "unit", "number").agg(F.min_by("fact", F.struct(F.abs(F.col("number") - F.col("fact")), "fact")).alias("fact"))
    return nearest.filter(~agrees(F.col("number"), F.col("fact"), least, relative))


def value_claims(texts: DataFrame, id_col: str, text_col: str, aliases: DataFrame) -> DataFrame:
    """(id, code, canon): dictionary values that texts name and do not deny.

    aliases: code, alias, canon. Phrases of up to as many words as the longest
    alias has meet aliases in an equi-join; a phrase inside a longer known one does not count,
    nor one after a word of denial.
    """
    most_words = aliases.agg(F.max(F.size(F.split(norm_key(F.col("alias")), " ")))).first()[0] or 1
    phrases = lambda words: F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size(words) - i + 1)), lambda n: F.struct(i.alias("at"), n.alias("n"), F.array_join(F.slice(words, i, n), " ").alias("phrase"), F.get(words, i - 2).alias("before")))))
    # reading a text costs far more than moving it: texts are dealt out to as many tasks as a shuffle has
    dealt = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    # a text has one word at least, an empty one; the outer form keeps the optimizer from a filter that would compute the phrases once more
    said = dealt.select("id", F.explode_outer(let(F.split(norm_key(F.col("t")), " "), phrases)).alias("s")).select("id", "s.*")
    hits = said.join(aliases.select("code", "canon", norm_key(F.col("alias")).alias("phrase")).distinct(), "phrase")
    longest = F.max(F.col("at") + F.col("n")).over(Window.partitionBy("id", "code").orderBy("at", F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1))
    kept = hits.withColumn("_end", longest).filter("_end is null or at + n > _end").filter(~F.coalesce(F.col("before").isin(*NEGATIONS), F.lit(False)))
    return kept.select("id", "code", "canon").distinct()


def likely_repeats(values: DataFrame, attribute: str, value: str) -> DataFrame:
    """(attribute, a, b, how): values of one attribute that fold to one, or one of which holds the other's words."""
    distinct = values.select(F.col(attribute).alias("k"), F.col(value).alias("v")).filter("v is not null").distinct()
    folded = distinct.withColumn("f", value_fold(F.col("v")))
    same = folded.select("k", "f", F.col("v").alias("a")).join(folded.select("k", "f", F.col("v").alias("b")), ["k", "f"]).filter("a < b").select("k", "a", "b", F.lit("same").alias("how"))
    words = F.split(norm_key(F.col("v")), " ")
    n = F.size(words)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda m: F.when(m < n, F.array_join(F.slice(words, i, m), " ")))))
    inside = distinct.select("k", F.col("v").alias("b"), F.explode(F.array_distinct(F.array_compact(parts))).alias("p")).join(distinct.select("k", F.col("v").alias("a"), norm_key(F.col("v")).alias("p")), ["k", "p"])
    return same.unionByName(inside.filter("a <> b").select("k", "a", "b", F.lit("inside").alias("how"))).distinct().withColumnRenamed("k", attribute)


def repeat_groups(values: DataFrame, attribute: str, value: str) -> DataFrame:
    """(attribute, representative, member): values of one attribute that fold to one, each beside the least of its group; groups of one are left out.

    A group has as many rows as members, however large it is.
    """
    folded = values.select(F.col(attribute), F.col(value).alias("member"), value_fold(F.col(value)).alias("_f")).filter("member is not null").distinct()
    least = folded.groupBy(attribute, "_f").agg(F.min("member").alias("representative"), F.count("*").alias("_n")).filter("_n > 1")
    return folded.join(least, [attribute, "_f"]).select(attribute, "representative", "member")


def rule_errors(cards: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, error): a row for each rule that a card breaks; all rules in one pass."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules.items()]))
    return cards.select(F.col(id_col).alias("id"), F.explode(found).alias("error"))


def known_filters_only(cards: DataFrame, filters: str, known: DataFrame) -> DataFrame:
    """cards with the filter map stripped of keys that no approved filter (code) has."""
    entries = cards.select("id", F.explode(filters).alias("code", "labels")).join(known.select("code"), "code", "left_semi")
    kept = entries.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "labels")))).alias(filters))
    return cards.drop(filters).join(kept, "id", "left")


def stratified_sample(rows: DataFrame, stratum: str, balance: str, key: str, per_stratum: int, seed: int = 0) -> DataFrame:
    """`per_stratum` rows of each stratum, taken in turn from the values of `balance`, in a seeded order.

    A sampling operator: the count is its purpose. The order is a hash of the
    key, so reruns agree.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    turn = F.row_number().over(Window.partitionBy(stratum, balance).orderBy(h, key))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_turn", "_h", key))
    return rows.withColumn("_h", h).withColumn("_turn", turn).withColumn("place", place).filter(F.col("place") <= per_stratum).drop("_h", "_turn")


def fnv1a(c: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's characters, as a long; a character above the basic plane counts as one."""
    step = lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("long"), step)


def stratified_pick(rows: DataFrame, key: str, balance: str, strata: list[tuple[str, Column, int]], size: int) -> DataFrame:
    """(key, strata): up to `size` rows, a quota from each stratum (name, condition, quota) in turn, the rest from all.

    Strata may overlap; a row is taken once. Each round takes rows of the least
    taken values of `balance` first, then by the hash of the key, then by the
    key, so reruns agree. A row's strata are all that it fits, `plain` for none.
    A sampling operator: its counts are its purpose, and all that the driver
    holds are the keys taken so far. Keys are one a row; null keys are left out.
    """
    spark = rows.sparkSession
    kinds = f"key {rows.schema[key].dataType.simpleString()}, brand {rows.schema[balance].dataType.simpleString()}"
    told = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds, _ in strata]))
    asked = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(balance).alias("brand"), fnv1a(F.col(key).cast("string")).alias("h"), told.alias("strata"))
    taken: list = []
    for name, quota in [*[(n, q) for n, _, q in strata], (None, None)]:
        room = size - len(taken) if quota is None else quota
        if room <= 0:
            continue
        chosen = F.broadcast(spark.createDataFrame([(r["key"], r["brand"]) for r in taken], kinds))  # at most all quotas and `size` rows
        open_ = asked.join(chosen.select("key"), "key", "left_anti").join(F.broadcast(chosen.groupBy("brand").agg(F.count("*").alias("n")).withColumnRenamed("brand", "b")), F.col("brand").eqNullSafe(F.col("b")), "left")
        fits = open_ if name is None else open_.filter(F.array_contains("strata", name))
        taken += fits.orderBy(F.coalesce("n", F.lit(0)), "h", "key").limit(room).select("key", "brand", "strata").collect()
    out = [(r["key"], r["strata"] or ["plain"]) for r in taken[:size]]
    return spark.createDataFrame(out, f"{key} {rows.schema[key].dataType.simpleString()}, strata array<string>")


def enrichment_order(facts: DataFrame, products: DataFrame, tiers: DataFrame) -> DataFrame:
    """(id, missing_a, missing_b, priority): what each product lacks of tiers A and B; B weighs 1000 to A's 1.

    Counts of what is there are taken from the counts of what there could be.
    """
    wanted = tiers.agg(F.count_if(F.col("tier") == "A").alias("all_a"), F.count_if(F.col("tier") == "B").alias("all_b"))
    has = facts.filter("value is not null").select("id", "code").distinct().join(tiers, "code").groupBy("id").agg(F.count_if(F.col("tier") == "A").alias("a"), F.count_if(F.col("tier") == "B").alias("b"))
    joined = products.select("id").join(has, "id", "left").crossJoin(F.broadcast(wanted))
    a, b = F.col("all_a") - F.coalesce("a", F.lit(0)), F.col("all_b") - F.coalesce("b", F.lit(0))
    return joined.select("id", a.alias("missing_a"), b.alias("missing_b"), (b * 1000 + a).alias("priority"))
