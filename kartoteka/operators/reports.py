"""Reports and audits over facts, cards and runs; each is one or two grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.text import annotation_format


def percent(part: Column, whole: Column) -> Column:
    """Per cent with one decimal, halves up; null for an empty whole."""
    return F.floor(F.try_divide(part * 1000, whole) + 0.5) / 10


def coverage(facts: DataFrame, attributes: DataFrame, rows: DataFrame) -> DataFrame:
    """(code, mapped, filled, total, coverage): products with a fact and with a value, of all `rows` (total)."""
    per_code = facts.groupBy("code").agg(F.countDistinct("id").alias("mapped"), F.countDistinct(F.when(F.col("value").isNotNull(), F.col("id"))).alias("filled"))
    total = rows.agg(F.sum("total").alias("total"))
    joined = attributes.select("code").join(per_code, "code", "left").crossJoin(F.broadcast(total))
    none = F.lit(0).cast("long")
    return joined.select("code", F.coalesce("mapped", none).alias("mapped"), F.coalesce("filled", none).alias("filled"), "total", percent(F.coalesce("filled", none), F.col("total")).alias("coverage"))


def format_counts(cards: DataFrame, html: str) -> DataFrame:
    return cards.groupBy(annotation_format(F.col(html)).alias("format")).agg(F.count("*").alias("cnt"))


def top_values(rows: DataFrame, key: str, most: int, weight: str | None = None) -> DataFrame:
    """(key, cnt): the most frequent values, ties in order; a bounded top-k, not a sort of all."""
    n = F.count("*") if weight is None else F.sum(weight)
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(n.alias("cnt")).orderBy(F.col("cnt").desc(), F.col(key)).limit(most)


def value_inventory(facts: DataFrame, code: str, value: str, most: int) -> DataFrame:
    """(code, value, cnt, place): each attribute's most frequent values."""
    counts = facts.filter(F.col(value).isNotNull()).groupBy(code, value).agg(F.count("*").alias("cnt"))
    place = F.row_number().over(Window.partitionBy(code).orderBy(F.col("cnt").desc(), F.col(value)))
    return counts.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def label_quality(rows: DataFrame, group: str, gold: str, predicted: str) -> DataFrame:
    """(group, checkable, agreed, invented, missed, precision, recall) of a 0/1 prediction against a 0/1 gold label; nulls are unlabelled or unfilled."""
    g, p = F.col(gold), F.col(predicted)
    stats = rows.groupBy(group).agg(
        F.count_if(g.isNotNull() & p.isNotNull()).alias("checkable"),
        F.count_if(g == p).alias("agreed"),
        F.count_if((g == 0) & (p == 1)).alias("invented"),
        F.count_if((g == 1) & (F.coalesce(p, F.lit(0)) == 0)).alias("missed"),
        F.count_if((g == 1) & (p == 1)).alias("_hit"),
    )
    return stats.withColumn("precision", percent(F.col("_hit"), F.col("_hit") + F.col("invented"))).withColumn("recall", percent(F.col("_hit"), F.col("_hit") + F.col("missed"))).drop("_hit")


def usage(rows: DataFrame, by: list[str], status: str, cost_cents: str) -> DataFrame:
    """Per run: rows, those ok, skipped and failed, and the summed cost."""
    s = F.col(status)
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s == "error").alias("failed"), F.sum(cost_cents).alias("cost_cents"))


def issue_groups(issues: DataFrame, kind: str, product: str, samples: int = 8) -> DataFrame:
    """(kind, events, products, samples): how often, for how many products, and the first ids; bounded per group."""
    counted = issues.groupBy(kind, product).agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(product))
    first = counted.withColumn("_p", place).filter(F.col("_p") <= samples).groupBy(kind).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.col(product))), lambda x: x.cast("string"))).alias("samples"))
    return counted.groupBy(kind).agg(F.sum("_n").alias("events"), F.count("*").alias("products")).join(first, kind)


def card_status(cards: DataFrame, extra: str, missing: str, issues: str) -> DataFrame:
    """cards with `status`: extra before missing before issues before ok."""
    return cards.withColumn("status", F.when(F.col(extra) > 0, "extra").when(F.col(missing) > 0, "missing").when(F.col(issues) > 0, "issues").otherwise("ok"))


def quality_score(confirmed: Column, total: Column, penalties: list[tuple[Column, float]]) -> Column:
    """confirmed / total less the weighted counts of faults, within 0 and 1."""
    score = F.coalesce(F.try_divide(confirmed, total), F.lit(0.0))
    for count, weight in penalties:
        score = score - count * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def sliding_count(events: DataFrame, by: str, at: str, seconds: int) -> DataFrame:
    """events with `in_window`: the events of the group in the seconds up to and including each."""
    frame = Window.partitionBy(by).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("in_window", F.count("*").over(frame))


def filters_missing(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(present, keys, "left_anti")


def same_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (same): whether both hold the same rows, counted."""
    left = a.exceptAll(b).limit(1).select(F.lit(1).alias("x"))
    return left.unionByName(b.exceptAll(a).limit(1).select(F.lit(1).alias("x"))).agg((F.count("*") == 0).alias("same"))


def todo(catalog: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Rows of the catalog that the ledger has neither enriched nor skipped; failed ones are tried again."""
    done = ledger.filter("enriched is not null or skipped is not null").select(key)
    return catalog.join(done, key, "left_anti")


def forward_fill(rows: DataFrame, column: str, order: str, by: list[str]) -> DataFrame:
    """The last value given before or at each row of its group, as sheets with merged cells have it.

    An empty `by` makes one group of the whole table, which one task must hold: for sheets filled in by hand.
    """
    frame = Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(frame))
