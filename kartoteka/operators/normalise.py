"""From pairs of cards to facts of a dictionary: keys matched by their values too, values normalised, sources resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import fold, norm_key, value_fold
from kartoteka.functions.values import normalize_value
from kartoteka.operators.match import LEAST_LIKENESS, blacklisted, looked_up, pair_likeness
from kartoteka.operators.resolve import resolve_facts, source_rank
from kartoteka.storage import computed_once

#: Bare keys that a value tells apart, and what the value must look like.
RESCUES = (("тип", "washer_type", "^(?:автомат(?:ическая)?|полуавтомат(?:ическая)?)$"), ("класс", "energy_class", "^[a-gа-е]\\+{1,3}$"))


def candidate_score(kind: Column, value: Column, length: Column) -> Column:
    """How well an attribute of a kind suits a value, among attributes that share a synonym of a length."""
    text = F.trim(F.coalesce(value, F.lit("")))
    classy = text.rlike("(?iu)^[a-gа-е]\\+{0,3}$") | text.rlike("(?iu)класс\\s*[a-gа-е]\\+{0,3}")
    number, answer = text.rlike("^-?\\d"), fold(text).rlike("^(?:да|нет|есть|имеется|true|false|yes|no)$")
    points = [(classy & (kind == "class_scale"), 100), (number & kind.isin("number", "integer"), 100), (~number & (kind == "enum"), 10), ((kind == "boolean") & ~answer, -50), ((kind == "boolean") & answer, 40)]
    total = length
    for holds, n in points:
        total = total + F.when(F.coalesce(holds, F.lit(False)), n).otherwise(0)
    return total


def match_pairs(pairs: DataFrame, synonyms: DataFrame, blacklist: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """(key, value, code, how) of each distinct key and value: exact, words, the value's rescue, blacklist, fuzzy, unmapped.

    synonyms: synonym, code, kind, order. Among attributes that share a synonym
    the one whose kind suits the value wins, then the lesser order. Keys of fewer
    than four letters are not matched by likeness, nor are blacklisted synonyms.
    Distinct pairs are computed once: filters on their keys would else be pushed
    to the rows they come from.
    """
    asked = computed_once(pairs.select("key", "value").distinct())
    met = looked_up(asked, synonyms, blacklist)
    score = F.struct(candidate_score(F.col("kind"), F.col("value"), F.col("n")).alias("s"), (-F.col("order")).alias("o"))
    best = lambda how: F.max_by("code", F.when((F.col("how") == how) & F.col("found"), score)).alias(how)
    wanted = None
    for key, code, pattern in RESCUES:
        holds = (norm_key(F.col("key")) == key) & fold(F.trim("value")).rlike(pattern)
        wanted = F.when(holds, code) if wanted is None else wanted.when(holds, code)
    first = met.groupBy("key", "value").agg(best("exact"), best("words"), F.max(F.when((F.col("how") == "barred") & F.col("found"), True)).alias("barred")).withColumn("wanted", wanted)
    first = first.join(synonyms.select(F.col("code").alias("wanted")).distinct().withColumn("rescued", F.col("wanted")), "wanted", "left").drop("wanted")
    rest = first.filter("exact is null and words is null and rescued is null and barred is null").filter(F.length(norm_key(F.col("key"))) >= 4).select("key").distinct()
    sound = blacklisted(synonyms.select(F.col("synonym").alias("key")).distinct(), blacklist).select(F.col("key").alias("synonym"))
    likely = pair_likeness(rest, synonyms.join(sound, "synonym", "left_anti").select("synonym", "code", "order"), least)
    likely = likely.groupBy("key").agg(F.max_by("code", F.struct("likeness", (-F.col("order")).alias("o"))).alias("fuzzy"))
    done = first.join(likely, "key", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("words").isNotNull(), "words").when(F.col("rescued").isNotNull(), "value").when(F.col("barred"), "blacklist").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unmapped")
    code = F.when(F.coalesce("exact", "words", "rescued").isNotNull() | F.col("barred").isNull(), F.coalesce("exact", "words", "rescued", "fuzzy"))
    return done.select("key", "value", code.alias("code"), how.alias("how"))


def alias_values(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (id, code, value...) with `canon`: the dictionary's value by equal spelling, else by the longest spelling of four letters or more inside it.

    aliases: code, alias, canon. Only distinct values are compared; those inside
    meet on the first four letters of a spelling.
    """
    spelled = aliases.select("code", value_fold(F.col("alias")).alias("spelling"), "canon").unionByName(aliases.select("code", value_fold(F.col("canon")).alias("spelling"), "canon"))
    spelled = spelled.filter("spelling <> ''").groupBy("code", "spelling").agg(F.min("canon").alias("canon"))
    values = facts.select("code", "value").distinct().withColumn("folded", value_fold(F.col("value")))
    equal = values.join(spelled.select("code", F.col("spelling").alias("folded"), F.col("canon").alias("equal")), ["code", "folded"], "left")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("folded") - 3), lambda i: F.substr("folded", i, F.lit(4))))
    inside = values.filter(F.length("folded") >= 4).withColumn("gram", F.explode(grams)).join(spelled.filter(F.length("spelling") >= 4).withColumn("gram", F.left("spelling", F.lit(4))), ["code", "gram"]).filter(F.contains("folded", F.col("spelling")))
    longest = inside.groupBy("code", "value").agg(F.max_by("canon", F.struct(F.length("spelling").alias("n"), "spelling")).alias("inside"))
    known = equal.join(longest, ["code", "value"], "left").select("code", "value", F.coalesce("equal", "inside").alias("canon"))
    return facts.join(known, ["code", "value"], "left")


def normalize_products(pairs: DataFrame, attributes: DataFrame, synonyms: DataFrame, blacklist: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """(id, code, value, level, status): each product's facts, and rows without a code or value for what was not understood.

    pairs: id, seq, key, value, level. attributes: code, kind, unit, lo, hi. A
    fact is the first one of the highest source; status is ok, the reason why a
    value was refused, or unmapped for keys of no attribute. pairs are computed
    once: matching looks at them several times, and reading cards is costly.
    Values are read once a distinct key and value.
    """
    pairs = computed_once(pairs)
    matched = match_pairs(pairs, synonyms, blacklist, least)
    read = normalize_value(F.col("kind"), F.col("value"), F.col("lo"), F.col("hi"), F.col("unit"), F.col("key"))
    known = computed_once(matched.join(attributes, "code", "left").select("key", "value", "code", F.when(F.col("code").isNotNull(), read).alias("v")))
    rows = pairs.join(known, ["key", "value"]).select("id", "seq", "level", "key", F.col("value").alias("raw"), "code", "v")
    sound = rows.filter("v.value is not null").select("id", "code", F.col("v.value").alias("value"), "level", "seq", source_rank(F.col("level")).alias("rank"))
    facts = resolve_facts(sound, ["id", "code"], "rank", "seq").select("id", "code", "value", "level", F.lit("ok").alias("status"))
    odd = rows.filter("v.value is null").select("id", "code", F.when(F.col("code").isNull(), F.col("key")).otherwise(F.col("raw")).alias("value"), "level", F.coalesce("v.reason", F.lit("unmapped")).alias("status"))
    return facts.unionByName(odd.distinct())


def specs_as_pairs(specs: DataFrame, code_to_spec: DataFrame) -> DataFrame:
    """(id, seq, key, value, level): a card's specs map<string, string> as pairs of source S3, numbers scaled back.

    code_to_spec: code, name, spec, mul.
    """
    entries = specs.select("id", F.explode("specs").alias("spec", "v")).filter("coalesce(v, '') <> ''")
    number = F.col("v").try_cast("double") / F.col("mul")
    text = F.when(F.col("mul").isNotNull() & number.isNotNull(), F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string"))).otherwise(F.col("v"))
    rows = entries.join(code_to_spec, "spec").select("id", F.xxhash64("spec").alias("seq"), F.col("name").alias("key"), text.alias("value"), F.lit("S3").alias("level"))
    return rows
