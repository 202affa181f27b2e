"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sizes are words. Blocks of equal size are apportioned by highest quotients,
first to sources by their targets, then to groups of shards and to shards by
their sizes, so every shard has an integer quota. A shard lays its documents in
a seeded order end to end; its quota is some full passes over it and, for the
rest, blocks picked by a seeded permutation. Each step works on rows keyed by
source and shard; shards are small, so a hot source spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.llm.common import cut

WEIGHTS = (5, 2, 1)
#: Words of a block and of a shard, shards of a group, and most repeats of a source.
BLOCK, SHARD, GROUP, REPEATS = 128, 1 << 18, 1024, 3
#: A prime above the blocks of any shard; the permutation of blocks steps by it.
STEP = 1_000_003
WORD = "[^\\x20\\x09-\\x0D]+"


def apportion(children: DataFrame, parent: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """children with `out`: its share of the parent's seats by the Sainte-Lague method.

    The seats of a parent go to the highest quotients weight / (2k - 1). Two
    divisors that enclose the right one settle all but about two seats a child;
    only the quotients between them are ranked. Ties go to the lesser key.
    """
    every = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    total, n = F.sum(weight).over(every), F.count("*").over(every)
    bounded = children.withColumn("_total", total).withColumn("_n", n)
    share = lambda add: F.floor(F.col(weight) * (F.col(seats) + add * F.col("_n") / 2) / F.col("_total") + 0.5)
    settled = F.when(F.col("_total") > 0, F.greatest(F.lit(0), share(-1) - 1)).otherwise(0).cast("long")
    highest = F.when(F.col(weight) > 0, share(1) + 1).otherwise(0).cast("long")
    bounded = bounded.withColumn("_settled", settled).withColumn("_highest", highest)
    bounded = bounded.withColumn("_left", F.col(seats) - F.sum("_settled").over(every))
    rank = F.row_number().over(every.orderBy(F.col("_quotient").desc(), F.col(key).asc_nulls_last(), "_k"))
    open_ = bounded.filter("_highest > _settled").withColumn("_k", F.explode(F.sequence(F.col("_settled") + 1, F.col("_highest"))))
    open_ = open_.withColumn("_quotient", F.col(weight) / (2 * F.col("_k") - 1))
    won = open_.withColumn("_rank", rank).filter("_rank <= _left").groupBy(*parent, key).agg(F.count("*").alias("_won"))
    names = [*parent, key]
    won = won.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(names)], "_won")
    on = [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(names)]
    return bounded.join(won, on, "left").select(*[F.col(c) for c in children.columns], (F.col("_settled") + F.coalesce("_won", F.lit(0))).alias(out))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target. Weights repeat over sources in code point order, null last.

    Targets share the total by weight and stop at `repeats` times the source's
    size. Sources reach that limit in the order of limit / weight; the shares of
    those beyond it follow from the totals up to each place in this order.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", pick.cast("long")).withColumn("limit", F.col("source_size") * repeats)
    all_rows = Window.partitionBy(F.lit(0))
    order = all_rows.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(order), F.lit(0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    placed = weighed.withColumn("_level", level)
    final = F.max("_level").over(all_rows)  # it rises while the next source is to be limited, and falls after that
    return placed.withColumn("_final", final).select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("_final") * F.col("weight")).alias("target"))


def _hash(*parts: Column) -> Column:
    """A seeded long that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: id, size, source, source_size, target, taken (words the mix takes, repeats counted).

    A size is the number of `[^\\x20\\x09-\\x0D]+` in the text, null and empty
    texts 0; a long text is counted whole. A null source is a source. taken is at
    most three times the size. Shards are drawn by id and text, so rows of one
    or no id spread; rows that agree in both are interchangeable. Every row
    gives one row. An empty table, or one without a word, takes nothing. Other
    columns of any name are not looked at. Targets need the order of all sources,
    so one task holds a row a source (not a document).
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    text_hash = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    h = _hash(F.lit(str(seed)), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), text_hash)
    rows = cut(docs.select(F.col(id_col).cast("long").alias("id"), words.alias("size"), F.col(source_col).cast("string").alias("source"), h.alias("h")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    sources = sources.withColumn("_seats", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / BLOCK).cast("long"))
    sources = apportion(sources, [], "source", "target", "_seats", "quota")
    sources = cut(sources.select(F.col("source").alias("s_source"), "source_size", "target", "quota", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).cast("long").alias("shards")))
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("shard", F.pmod(F.col("h"), F.col("shards")))
    source = ["source", "source_size", "target", "quota"]
    shards = placed.groupBy(*source, "shard").agg(F.sum("size").alias("shard_size")).withColumn("group", F.floor(F.col("shard") / GROUP))
    groups = shards.groupBy(*source, "group").agg(F.sum("shard_size").alias("group_size"))
    groups = apportion(groups, ["source"], "group", "group_size", "quota", "group_quota")
    groups = groups.select(F.col("source").alias("g_source"), F.col("group").alias("g_group"), "group_quota")
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("g_source")) & (F.col("group") == F.col("g_group")))
    shards = apportion(shards, ["source", "group"], "shard", "shard_size", "group_quota", "shard_quota")
    words_due = F.least(F.col("shard_quota") * BLOCK, F.col("shard_size") * REPEATS)
    shards = cut(shards.filter("shard_size > 0").select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "shard_size", words_due.alias("due")))
    on = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard"))
    dealt = placed.join(shards, on, "left").withColumn("shift", _hash(F.lit(str(seed)), F.coalesce("source", F.lit("null")), F.col("shard").cast("string")))
    before = Window.partitionBy("source", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = dealt.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("passes", F.floor(F.col("due") / F.col("shard_size")))
    dealt = dealt.withColumn("rest", F.col("due") - F.col("passes") * F.col("shard_size")).withColumn("full", F.floor(F.col("shard_size") / BLOCK))
    at, size, full, rest = (F.col(c) for c in ("at", "size", "full", "rest"))

    def overlap(j: Column) -> Column:
        place = F.when(j < full, F.pmod(j * STEP + F.col("shift"), full)).otherwise(full)
        chosen = F.greatest(F.lit(0), F.least(F.lit(BLOCK), rest - place * BLOCK))
        return F.greatest(F.lit(0), F.least(at + size, j * BLOCK + chosen) - F.greatest(at, j * BLOCK))

    blocks = F.sequence(F.floor(at / BLOCK), F.floor((at + size - 1) / BLOCK))
    extra = F.aggregate(F.transform(blocks, overlap), F.lit(0).cast("long"), lambda a, b: a + b)
    taken = F.when((size > 0) & F.col("due").isNotNull(), F.col("passes") * size + extra).otherwise(0).cast("long")
    return dealt.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", taken.alias("taken"))
