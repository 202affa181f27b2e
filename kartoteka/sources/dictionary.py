"""Attribute dictionaries of categories as tables, with their overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions.buckets import BUCKET_TYPE, buckets_from_breaks
from kartoteka.functions.text import norm_key, value_fold
from kartoteka.operators.facets import facet_kind

ATTRIBUTE = (
    "code string, name string, type string, unit string, cardinality string, `order` int, tier string, highlight boolean, valid_range array<double>,"
    " synonyms array<string>, blacklist array<string>, value_aliases map<string, array<string>>,"
    " facet struct<enabled: boolean, label: string, kind: string, status: string, step: double, origin: double, open_last: boolean, bound_rule: string,"
    " breaks array<double>, buckets array<struct<label: string, min: double, max: double>>, int_values array<int>, round: string, required: boolean>"
).replace("breaks array", "breaks: array").replace("buckets array<struct", "buckets: array<struct").replace("int_values array", "int_values: array")


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """Attributes of a dictionary file: an array, or an object with `attributes`."""
    wrapped = spark.read.schema(f"attributes array<struct<{_as_fields(ATTRIBUTE)}>>").json(path, multiLine=True)
    inside = wrapped.filter("attributes is not null").select(F.explode("attributes").alias("a")).select("a.*")
    plain = spark.read.schema(ATTRIBUTE).json(path, multiLine=True).filter("code is not null")
    return inside.unionByName(plain)


def _as_fields(ddl: str) -> str:
    """A column list as the fields of a struct type."""
    out, depth = [], 0
    for part in ddl.split(","):
        if not depth:
            name, _, kind = part.strip().partition(" ")
            part = f"{name}: {kind}"
        out.append(part)
        depth += part.count("<") - part.count(">")
    return ",".join(out)


def synonyms(attributes: DataFrame) -> DataFrame:
    """(synonym, code, order): names and synonyms, the attribute's own name first."""
    return attributes.select(F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("synonym"), "code", "order").filter(norm_key(F.col("synonym")) != "")


def blacklist(attributes: DataFrame) -> DataFrame:
    return attributes.select(F.explode("blacklist").alias("phrase")).distinct()


def value_aliases(attributes: DataFrame) -> DataFrame:
    """(code, folded, canon): each spelling's canonical value; the canon's own spelling is one."""
    flat = attributes.select("code", F.explode("value_aliases").alias("canon", "list"))
    spelled = flat.select("code", "canon", F.explode(F.concat(F.array("canon"), F.coalesce("list", F.array().cast("array<string>")))).alias("alias"))
    return spelled.groupBy("code", value_fold(F.col("alias")).alias("folded")).agg(F.min("canon").alias("canon"))


def canonical_values(facts: DataFrame, aliases: DataFrame) -> DataFrame:
    """facts (code, value...) with value replaced by its canon where the dictionary has one, and `known`."""
    joined = facts.withColumn("folded", value_fold(F.col("value"))).join(aliases, ["code", "folded"], "left")
    return joined.withColumn("value", F.coalesce("canon", "value")).withColumn("known", F.col("canon").isNotNull()).drop("folded", "canon")


def facet_attributes(attributes: DataFrame) -> DataFrame:
    """code, kind, step, origin, buckets, int_values: what facet_labels needs of a dictionary."""
    f = F.col("facet")
    listed = F.coalesce(f["buckets"], F.array().cast(BUCKET_TYPE))
    broken = F.coalesce(F.when(F.size(f["breaks"]) >= 2, buckets_from_breaks(f["breaks"], f["open_last"])), F.array().cast(BUCKET_TYPE))
    buckets = F.when(F.size(listed) > 0, listed).otherwise(broken)
    kind = facet_kind(f["kind"], F.col("type"), F.size(buckets) > 0, F.get("valid_range", F.lit(0)), F.get("valid_range", F.lit(1)), F.col("unit"))
    shown = attributes.filter(F.coalesce(f["enabled"], F.lit(False)))
    return shown.select("code", kind.alias("kind"), f["step"].alias("step"), F.coalesce(f["origin"], F.lit(0.0)).alias("origin"), buckets.alias("buckets"), F.coalesce(f["int_values"], F.array().cast("array<int>")).alias("int_values"))


def overlay_filters(attributes: DataFrame, spec: DataFrame) -> DataFrame:
    """attributes with the kind, step and buckets of a filter spec (code, kind, step, buckets) where it has them; `not_a_filter` switches a facet off."""
    over = spec.select("code", F.col("kind").alias("_kind"), F.col("step").alias("_step"), F.col("buckets").alias("_buckets"))
    f = F.col("facet")
    joined = attributes.join(over, "code", "left")
    off = F.coalesce(F.col("_kind") == "not_a_filter", F.lit(False))
    facet = f.withField("kind", F.when(off, f["kind"]).otherwise(F.coalesce("_kind", f["kind"]))).withField("step", F.coalesce("_step", f["step"])).withField("buckets", F.coalesce("_buckets", f["buckets"])).withField("enabled", ~off & F.coalesce(f["enabled"], F.lit(True)))
    return joined.withColumn("facet", facet).drop("_kind", "_step", "_buckets")
