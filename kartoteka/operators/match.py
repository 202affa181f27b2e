"""Matching keys and names to a dictionary: exact, by words, by prefix, by likeness.

Every join is an equi-join on a derived key; likeness counts shared letter
pairs. Work follows the number of different keys, not of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.text import bigrams, let, norm_key, token_bag

#: Least likeness of a fuzzy match, and how much lengths may differ.
LEAST_LIKENESS, LENGTH_GAP = 0.9, 12


def exact_matches(keys: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(key, code, how) by normal form; the synonym of least order wins."""
    return _best(keys.withColumn("_k", norm_key(F.col("key"))).join(synonyms.withColumn("_k", norm_key(F.col("synonym"))), "_k"), "exact")


def bag_matches(keys: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(key, code, how) by the set of words."""
    left = keys.withColumn("_k", token_bag(F.col("key"))).filter("_k <> ''")
    return _best(left.join(synonyms.withColumn("_k", token_bag(F.col("synonym"))), "_k"), "words")


def prefix_matches(keys: DataFrame, synonyms: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """(key, code, how): the longest synonym whose words the key begins with, unless with the next word it is a blacklisted phrase (phrase)."""
    words = F.split(norm_key(F.col("key")), " ")
    starts = keys.withColumn("_k", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))))
    if blacklist is not None:
        longer = F.array_join(F.slice(words, F.lit(1), F.size(F.split("_k", " ")) + 1), " ")
        barred = blacklist.select(norm_key(F.col("phrase")).alias("_longer")).distinct()
        starts = starts.withColumn("_longer", longer).join(barred, "_longer", "left_anti")
    joined = starts.join(synonyms.withColumn("_k", norm_key(F.col("synonym"))), "_k")
    longest = F.struct(F.length("_k").alias("a"), (-F.col("order")).alias("b"))
    return joined.groupBy("key").agg(F.max_by("code", longest).alias("code")).withColumn("how", F.lit("prefix"))


def pair_likeness(keys: DataFrame, synonyms: DataFrame, least: float = LEAST_LIKENESS, gap: int = LENGTH_GAP) -> DataFrame:
    """(key, synonym, code, order, likeness): pairs whose letter pairs agree to `least` (Dice).

    Two texts as alike as that share one of the rarest letter pairs of the key:
    of its n pairs at most (1 - least) / (2 - least) of both sets are its own,
    so only that many of its rarest, and one more, look for synonyms. Lengths
    bound the rest before any set is compared.
    """
    spelled = synonyms.withColumn("_s", norm_key(F.col("synonym"))).withColumn("_sg", bigrams(F.col("_s")))
    grams = spelled.select("synonym", "code", "order", "_s", "_sg", F.explode("_sg").alias("_pair"))
    often = grams.groupBy("_pair").agg(F.count("*").alias("_often"))
    asked = keys.select("key").distinct().withColumn("_k", norm_key(F.col("key"))).withColumn("_kg", bigrams(F.col("_k")))
    counted = asked.select("key", "_k", "_kg", F.explode("_kg").alias("_pair")).join(often, "_pair", "left").groupBy("key").agg(F.any_value("_k").alias("_k"), F.any_value("_kg").alias("_kg"), F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), F.col("_pair").alias("p")))).alias("_by"))
    # |A and B| >= least (|A| + |B|) / 2 and |B| >= |A and B| leave at most this share of A's pairs outside B
    outside = F.floor(F.size("_kg") * (2 - 2 * least) / (2 - least) + 1e-9).cast("int")
    probes = counted.withColumn("_pair", F.explode(F.transform(F.slice("_by", F.lit(1), F.greatest(outside + 1, F.lit(0))), lambda x: x["p"])))
    met = probes.join(grams, "_pair").filter(F.abs(F.length("_k") - F.length("_s")) <= gap).dropDuplicates(["key", "synonym", "code", "order"])
    share = 2 * F.size(F.array_intersect("_kg", "_sg")) / (F.size("_kg") + F.size("_sg"))
    return met.select("key", "synonym", "code", "order", share.alias("likeness")).filter(F.col("likeness") >= least)


def fuzzy_matches(keys: DataFrame, synonyms: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    likest = F.max_by("code", F.struct("likeness", (-F.col("order")).alias("_o")))
    return pair_likeness(keys, synonyms, least).groupBy("key").agg(likest.alias("code")).withColumn("how", F.lit("fuzzy"))


def blacklisted(keys: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Keys that are, begin with or end in a blacklisted phrase (whole words)."""
    words = F.split(norm_key(F.col("key")), " ")
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array(F.array_join(F.slice(words, 1, n), " "), F.array_join(F.slice(words, F.size(words) - n + 1, n), " "))))
    return keys.withColumn("_k", F.explode(F.array_distinct(ends))).join(blacklist.select(norm_key(F.col("phrase")).alias("_k")).distinct(), "_k", "left_semi").select("key").distinct()


def match_keys(keys: DataFrame, synonyms: DataFrame, blacklist: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """(key, code, how): exact, then by words, then blacklist, then fuzzy, else unmapped.

    keys: key. synonyms: synonym, code, order. blacklist: phrase.
    """
    met = looked_up(keys.select("key").distinct(), synonyms, blacklist)
    best = lambda how: F.min_by("code", F.when((F.col("how") == how) & F.col("found"), F.struct("order", "code"))).alias(how)
    first = met.groupBy("key").agg(best("exact"), best("words"), F.bool_or((F.col("how") == "barred") & F.col("found")).alias("barred"))
    open_ = F.coalesce("exact", "words").isNull() & ~F.coalesce("barred", F.lit(False))
    likely = fuzzy_matches(first.filter(open_).select("key"), synonyms, least).select("key", F.col("code").alias("fuzzy"))
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("words").isNotNull(), "words").when(F.col("barred"), "blacklist").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("unmapped")
    return first.join(likely, "key", "left").select("key", F.coalesce("exact", "words", "fuzzy").alias("code"), how.alias("how"))


def looked_up(asked: DataFrame, synonyms: DataFrame, blacklist: DataFrame) -> DataFrame:
    """asked (key ...) with what its keys meet in one join: how (exact, words, barred), found, and the synonym's columns, with n, its length.

    A key asks as it is, as a set of words, and with each of its beginnings and
    ends for a blacklisted phrase; what meets nothing keeps rows of nulls. There
    is always something to ask: the outer form only keeps the optimizer from a
    filter on the size of what is asked, which it would push to the rows that
    asked is made of.
    """
    ends = let(F.split(norm_key(F.col("key")), " "), lambda words: F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array(F.array_join(F.slice(words, F.lit(1), n), " "), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ")))))
    probe = lambda how, text: F.struct(F.lit(how).alias("how"), text.alias("text"))
    probes = F.concat(F.array(probe("exact", norm_key(F.col("key"))), probe("words", token_bag(F.col("key")))), F.transform(F.array_distinct(ends), lambda e: probe("barred", e)))
    own = [c for c in synonyms.columns if c != "synonym"]
    known = synonyms.select(*own, F.explode(F.array(probe("exact", norm_key(F.col("synonym"))), probe("words", token_bag(F.col("synonym"))))).alias("p"), F.length(norm_key(F.col("synonym"))).alias("n")).select(*own, "n", "p.how", "p.text")
    barred = blacklist.select(*[F.lit(None).cast(synonyms.schema[c].dataType).alias(c) for c in own], F.lit(0).alias("n"), F.lit("barred").alias("how"), norm_key(F.col("phrase")).alias("text")).distinct()
    dictionary = known.unionByName(barred).filter("text <> ''").withColumn("found", F.lit(True))
    return asked.withColumn("p", F.explode_outer(probes)).select(*asked.columns, "p.how", "p.text").join(dictionary, ["how", "text"], "left")


def brand_in_name(names: DataFrame, name: str, brands: DataFrame, brand: str) -> DataFrame:
    """names with `brand`: the longest brand whose words stand in the name, the first such place in ties."""
    longest = brands.agg(F.max(F.size(F.split(norm_key(F.col(brand)), " ")))).first()[0] or 1
    known = brands.select(F.col(brand).alias("_brand"), norm_key(F.col(brand)).alias("phrase")).distinct()
    hits = names.select(F.col(name).alias("_name")).distinct().withColumn("_s", F.explode(_spots(F.col("_name"), longest))).select("_name", "_s.*").join(known, "phrase")
    best = hits.groupBy("_name").agg(F.max_by("_brand", F.struct(F.length("phrase").alias("a"), "place", "_brand")).alias("brand"))
    return names.join(best, F.col(name) == F.col("_name"), "left").drop("_name")


def _spots(name, longest: int):
    """Phrases of up to `longest` words of a name, with minus their places."""
    words = F.split(norm_key(name), " ")
    at = F.sequence(F.lit(1), F.size(words))
    return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.struct(F.array_join(F.slice(words, i, n), " ").alias("phrase"), (-i).alias("place")))))


def _best(joined: DataFrame, how: str) -> DataFrame:
    return joined.groupBy("key").agg(F.min_by("code", F.struct("order", "code")).alias("code")).withColumn("how", F.lit(how))


def unify_values(values: DataFrame, attribute: str, value: str) -> DataFrame:
    """(attribute, value, canon): spellings with one stem take its most frequent one."""
    stem = F.regexp_replace(F.array_join(F.array_sort(F.transform(F.split(norm_key(F.col(value)), " "), lambda w: F.regexp_replace(w, "(?<=\\p{L}{3})(?:ая|ое|ый|ий|ые|ие|ой|а|ы|и|s)$", ""))), " "), "\\s+", " ")
    counts = values.groupBy(attribute, value).agg(F.count("*").alias("_n")).withColumn("_stem", stem)
    best = F.first(value).over(Window.partitionBy(attribute, "_stem").orderBy(F.col("_n").desc(), F.length(value), F.col(value)))
    return counts.select(attribute, value, best.alias("canon"))
