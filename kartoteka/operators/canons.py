"""Spellings of one value that contain each other, brought to one: a forest of stems, closed step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.display import display_value
from kartoteka.functions.text import value_stem
from kartoteka.storage import computed_once

#: Shortest stem that others may hang from.
SHORTEST_STEM = 6


def stem_parents(shown: DataFrame) -> DataFrame:
    """(attribute, stem, parent): each stem under the stem of one of its words, the last; else under the shortest stem it begins with; else under itself.

    shown: attribute, shown, stem. Both kinds of parents are found by equi-joins,
    on a word's stem and on a stem's beginnings.
    """
    stems = shown.select("attribute", "stem").distinct()
    known = stems.filter(F.length("stem") >= SHORTEST_STEM)
    beginnings = F.transform(F.sequence(F.lit(SHORTEST_STEM), F.length("stem") - 1), lambda n: F.left("stem", n))
    begun = stems.filter(F.length("stem") > SHORTEST_STEM).select("attribute", F.col("stem").alias("longer"), F.explode(beginnings).alias("stem")).join(known, ["attribute", "stem"])
    roots = begun.groupBy("attribute", "longer").agg(F.min_by("stem", F.length("stem")).alias("root"))
    words = shown.select("attribute", "shown", F.col("stem").alias("longer"), F.posexplode(F.split("shown", "[\\s,/|+]+")).alias("place", "word")).withColumn("stem", value_stem(F.col("word"))).filter("stem <> longer")
    held = words.join(known, ["attribute", "stem"]).groupBy("attribute", "longer").agg(F.max_by("stem", F.struct("place", "shown")).alias("word"))
    joined = stems.withColumnRenamed("stem", "longer").join(roots, ["attribute", "longer"], "left").join(held, ["attribute", "longer"], "left")
    return joined.select("attribute", F.col("longer").alias("stem"), F.coalesce("word", "root", "longer").alias("parent"))


def closed(parents: DataFrame) -> DataFrame:
    """(attribute, stem, parent): the last ancestor of each stem; every round doubles the steps taken, until none changes."""
    parents = computed_once(parents)
    while True:
        above = parents.select("attribute", F.col("stem").alias("parent"), F.col("parent").alias("above"))
        raised = computed_once(parents.join(above, ["attribute", "parent"]).select("attribute", "stem", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")))
        parents = raised.drop("moved")
        if not raised.filter("moved").take(1):
            return parents


def unified_spellings(values: DataFrame, attribute: str, value: str) -> DataFrame:
    """(attribute, value, canon): every value of an attribute as its tree spells it: the most frequent spelling, the shortest of equals, then the first.

    Values are spelled as they are shown; those with one stem, a stem that
    begins with another of six letters or more, or a word with the stem of
    another value belong to one tree. A parent's stem is shorter than its
    child's but for endings, so that trees have roots. Null values are left out.
    """
    counted = values.filter(F.col(value).isNotNull()).groupBy(F.col(attribute).alias("attribute"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    shown = computed_once(counted.withColumn("shown", display_value(F.col("value"))).withColumn("stem", value_stem(F.col("shown"))))
    rooted = shown.join(closed(stem_parents(shown.select("attribute", "shown", "stem").distinct())), ["attribute", "stem"])
    spellings = rooted.groupBy("attribute", "parent", "shown").agg(F.sum("n").alias("n"))
    best = spellings.groupBy("attribute", "parent").agg(F.min_by("shown", F.struct(-F.col("n"), F.length("shown"), "shown")).alias("canon"))
    return rooted.join(best, ["attribute", "parent"]).select(F.col("attribute").alias(attribute), F.col("value").alias(value), "canon")
