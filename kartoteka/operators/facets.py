"""Faceted filters: shop facets, buckets from the data, dictionary facets, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.buckets import match_bucket, nice_step, price_step, snap_int_enum, step_label
from kartoteka.functions.text import number_label, value_fold

#: Facets of few values list them; text facets of more or longer labels are left out.
FEW_VALUES, MOST_LABELS, LONGEST_LABEL = 6, 24, 48


def shop_facets(items: DataFrame, brand: str, price: str) -> DataFrame:
    """(facet, value, cnt, min, max, step): brand counts, the price range, and rows without either."""
    brands = items.filter(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("value")).agg(F.count("*").alias("cnt"))
    none = F.lit(None).cast("double")
    listed = brands.select(F.lit("brand").alias("facet"), "value", "cnt", none.alias("min"), none.alias("max"), none.alias("step"))
    priced = F.when(F.col(price) > 0, F.col(price))
    totals = items.agg(F.count_if(F.col(brand).isNull()).alias("no_brand"), F.count_if(priced.isNull()).alias("no_price"), F.min(priced).alias("min"), F.max(priced).alias("max"))
    rest = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("brand").alias("facet"), F.lit("without_value").alias("value"), F.col("no_brand").alias("cnt"), none.alias("min"), none.alias("max"), none.alias("step")),
                F.struct(F.lit("price").alias("facet"), F.lit("without_price").alias("value"), F.col("no_price").alias("cnt"), F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), price_step(F.col("max") - F.col("min")).alias("step")),
            )
        ).alias("r")
    )
    return listed.unionByName(rest.select("r.*"))


def data_buckets(items: DataFrame, group: str, value: str) -> DataFrame:
    """(group, label, cnt): values as they are where few differ, else in round steps over the group's span.

    The statistics are one small row a group; they meet the items in a join
    that Spark broadcasts only if they are small.
    """
    stats = items.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    spread = stats.groupBy(group).agg(F.count("*").alias("_different"), F.min(value).alias("_low"), F.max(value).alias("_high"), F.bool_and(F.col(value) == F.floor(value)).alias("_whole"))
    spread = spread.withColumn("_step", nice_step((F.col("_high") - F.col("_low")).cast("double")))
    as_is = (F.col("_different") <= FEW_VALUES) | ((F.col("_step") <= 1) & F.col("_whole"))
    label = F.when(as_is, number_label(F.col(value))).otherwise(step_label(F.col(value).cast("double"), F.col("_step")))
    return stats.join(spread, group).groupBy(group, label.alias("label")).agg(F.sum("_n").alias("cnt"))


def unify_labels(items: DataFrame, label: str) -> DataFrame:
    """(folded, label, cnt, variants): the most frequent spelling of labels that fold to one; ties to the shorter, then lesser."""
    counts = items.filter(F.col(label).isNotNull()).groupBy(value_fold(F.col(label)).alias("folded"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("a"), F.length("label").alias("b"), F.col("label").alias("label")))
    return counts.groupBy("folded").agg(best["label"].alias("label"), F.sum("n").alias("cnt"), F.count("*").alias("variants"))


def text_facets(specs: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, cnt) of the keys with few and short labels."""
    counts = specs.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("cnt"))
    kept = counts.groupBy(key).agg(F.count("*").alias("_n"), F.avg(F.length(label)).alias("_len")).filter((F.col("_n") <= MOST_LABELS) & (F.col("_len") <= LONGEST_LABEL))
    return counts.join(kept.select(key), key, "left_semi")


def facet_kind(kind: Column, value_type: Column, has_buckets: Column, low: Column, high: Column, unit: Column) -> Column:
    """How an attribute is shown: its type decides, not the spread of its data."""
    counted = unit.isNull() & (low >= 0) & (high - low <= 20) & (low == F.floor(low)) & (high == F.floor(high))
    listed = (kind == "range") & ~has_buckets & ((value_type == "integer") | F.coalesce(counted, F.lit(False)))
    return F.when(value_type == "dimensions", "dimensions").when(kind == "int_enum", "int_enum").when((value_type == "boolean") & F.coalesce(kind.isin("boolean", "enum"), F.lit(True)), "boolean").when(kind == "boolean", "boolean").when(listed, "enum").otherwise(kind)


def facet_labels(facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """facts with `label` (null where the value fits no bucket).

    facts: id, code, value (string). attributes: code, kind, step, origin,
    buckets, int_values; a dictionary of a category, small by nature, but left
    for Spark to size.
    """
    number = F.col("value").try_cast("double")
    label = (
        F.when(F.col("kind") == "range", F.when(F.size("buckets") > 0, match_bucket(number, F.col("buckets"))).otherwise(step_label(number, F.col("step"), F.coalesce("origin", F.lit(0.0)))))
        .when(F.col("kind") == "int_enum", snap_int_enum(number, F.col("int_values")))
        .when(F.col("kind") == "boolean", F.when(F.lower("value") == "true", "Есть").when(F.lower("value") == "false", "Нет"))
        .otherwise(F.col("value"))
    )
    return facts.join(attributes, "code").withColumn("label", label)


def dictionary_facets(facts: DataFrame, attributes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(code, label, cnt): occupied labels and, with 0, the catalog's labels that no product has. A product counts once a label."""
    labelled = facet_labels(facts, attributes).filter("label is not null").select("id", "code", "label").distinct()
    counts = labelled.groupBy("code", "label").agg(F.count("*").alias("cnt"))
    return catalog.select("code", "label").join(counts, ["code", "label"], "full").select("code", "label", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def facet_warnings(counts: DataFrame, rows: DataFrame, least_coverage: float = 0.7, dominant: float = 0.95, most_buckets: int = 8) -> DataFrame:
    """(code, coverage, top_share, labels, warning) from (code, label, cnt) and the row count (total); warns, never drops."""
    stats = counts.filter("cnt > 0").groupBy("code").agg(F.sum("cnt").alias("_filled"), F.max("cnt").alias("_top"), F.count("*").alias("labels"))
    shares = stats.crossJoin(F.broadcast(rows.agg(F.sum("total").alias("_total")))).withColumn("coverage", F.col("_filled") / F.col("_total")).withColumn("top_share", F.col("_top") / F.col("_total"))
    found = F.concat_ws(",", F.when(F.col("coverage") < least_coverage, "coverage"), F.when(F.col("top_share") > dominant, "dominant"), F.when(F.col("labels") > most_buckets, "buckets"))
    return shares.select("code", "coverage", "top_share", "labels", found.alias("warning"))


def assign_filters(facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """(id, filters map<code, array<label>>, gaps array<struct<code, value>>): each product's labels, and values without one."""
    labelled = facet_labels(facts, attributes)
    per_code = labelled.groupBy("id", "code").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.collect_set(F.when(F.col("label").isNull(), F.col("value"))).alias("lost"))
    entry = F.when(F.size("labels") > 0, F.struct("code", "labels"))
    gaps = F.flatten(F.collect_list(F.transform("lost", lambda v: F.struct(F.col("code").alias("code"), v.alias("value")))))
    return per_code.groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("filters"), F.array_sort(gaps).alias("gaps"))

