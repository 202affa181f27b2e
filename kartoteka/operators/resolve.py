"""Which of several values holds: rank resolution, conflicts, last entries, cross-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.values import agrees

#: Rank of each source of a fact; others have rank 0.
SOURCE_RANKS = {
    "manufacturer": 50, "official_product_page": 45, "S0": 40, "source_json": 35, "S1": 35, "S2": 20,
    "trusted_retailer": 15, "major_retailer": 15, "S3": 10, "retailer": 10, "distributor": 8, "model": 5, "review": 3, "other": 0,
}
#: Confidence by least rank.
CONFIDENCES = ((45, 1.0), (30, 0.9), (15, 0.7), (5, 0.5))


def source_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in SOURCE_RANKS.items() for x in pair])
    return F.coalesce(F.element_at(ranks, level), F.lit(0))


def confidence(rank: Column) -> Column:
    out = None
    for least, value in CONFIDENCES:
        out = F.when(rank >= least, value) if out is None else out.when(rank >= least, value)
    return out.otherwise(0.3)


def resolve_facts(facts: DataFrame, keys: list[str], rank: str, seq: str) -> DataFrame:
    """The first fact of the highest rank for each key: a grouped maximum, no sort of the group."""
    others = [c for c in facts.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct(F.col(rank), (-F.col(seq)).alias("_first"))).alias("_best")
    return facts.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in others])


def conflict_log(facts: DataFrame, keys: list[str], rank: str, seq: str, value: str) -> DataFrame:
    """Facts that met a different standing value, in order: with kept value, selected value and needs_review.

    The value standing before a fact is the first one of the highest rank so far.
    """
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    standing = F.max(F.struct(F.col(rank).alias("r"), (-F.col(seq)).alias("s"), F.col(value).alias("v"))).over(before)
    met = facts.withColumn("_standing", standing).filter(F.col("_standing").isNotNull() & (F.col("_standing.v") != F.col(value)))
    wins = F.col(rank) > F.col("_standing.r")
    return met.select(*keys, F.col(seq), F.col("_standing.v").alias("standing"), F.col(value).alias("incoming"), F.when(wins, F.col(value)).otherwise(F.col("_standing.v")).alias("selected"), (F.col(rank) == F.col("_standing.r")).alias("needs_review"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; rows without a key are all kept."""
    others = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"))
    kept = best.select(key, *[F.col(f"_last.{c}").alias(c) for c in others]).select(*rows.columns)
    return kept.unionByName(rows.filter(F.col(key).isNull()))


def first_per(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_first"))
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others]).select(*rows.columns)


def merge_facts(text: DataFrame, attributes: DataFrame, keys: list[str], value: str, absolute: float, relative: float) -> DataFrame:
    """keys, value, origin: facts of two origins; where both speak and disagree neither counts, and the row says so."""
    a, b = text.withColumnRenamed(value, "_a"), attributes.withColumnRenamed(value, "_b")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    same = agrees(F.col("_a"), F.col("_b"), absolute, relative)
    origin = F.when(both & ~same, "conflict").when(both, "both").when(F.col("_a").isNotNull(), "text").otherwise("attributes")
    return a.join(b, keys, "full").select(*keys, F.when(~both | same, F.coalesce("_b", "_a")).alias(value), origin.alias("origin"))


def cross_check(specs: DataFrame, facts: DataFrame, keys: list[str], spec: str, fact: str, absolute: float, relative: float, policy: str = "prefer_source") -> DataFrame:
    """specs against facts: `checked` (value under the policy) and `outcome` ok, mismatch or unchecked.

    prefer_source takes the fact, flag keeps the spec, strict keeps neither.
    """
    joined = specs.join(facts, keys, "left")
    outcome = F.when(F.col(fact).isNull() | F.col(spec).isNull(), "unchecked").when(agrees(F.col(spec), F.col(fact), absolute, relative), "ok").otherwise("mismatch")
    instead = {"prefer_source": F.col(fact), "flag": F.col(spec), "strict": F.lit(None).cast("double")}[policy]
    return joined.select(*keys, F.when(outcome == "mismatch", instead).otherwise(F.coalesce(spec, fact)).alias("checked"), outcome.alias("outcome"))


def weakest_level(facts: DataFrame, keys: list[str], level: str) -> DataFrame:
    """The level of least rank among the facts a derived value rests on."""
    return facts.groupBy(*keys).agg(F.min_by(F.col(level), F.struct(source_rank(F.col(level)), F.col(level))).alias(level))
