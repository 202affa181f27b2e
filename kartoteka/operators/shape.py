"""Shaping of rows: first values, specs and templates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import squeeze

_SLOT = re.compile(r"\{\{\s*([\w.]+)\s*\}\}")


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that exists and is not blank."""
    there = [F.nullif(squeeze(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def spec_map(facts: DataFrame, code_to_spec: DataFrame) -> DataFrame:
    """(id, specs map<string, string>): facts under their spec keys, numbers scaled; the first of two facts of a key."""
    scaled = F.coalesce((F.col("value").try_cast("double") * F.col("mul")).cast("string"), F.col("value"))
    keyed = facts.join(code_to_spec, "code").groupBy("id", "spec").agg(F.min_by(F.when(F.col("mul").isNull(), F.col("value")).otherwise(scaled), "code").alias("v"))
    return keyed.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("spec", "v")))).alias("specs"))


def from_template(template: dict) -> Column:
    """A JSON text per row from nested dicts, lists and strings with {{column.path}} slots.

    A string that is one slot takes the column's own type; null slots inside a
    longer string are empty.
    """
    return F.to_json(_node(template))


def _node(x) -> Column:
    if isinstance(x, dict):
        return F.struct(*[_node(v).alias(k) for k, v in x.items()])
    if isinstance(x, list):
        return F.array(*[_node(v) for v in x])
    if not isinstance(x, str):
        return F.lit(x)
    whole = _SLOT.fullmatch(x)
    if whole:
        return F.col(whole[1])
    parts = _SLOT.split(x)
    return F.concat(*[F.coalesce(F.col(p).cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def snake_key(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^\\p{L}\\p{N}]+", "_"), "^_|_$", "")


def category_paths(categories: DataFrame, hops: int = 8) -> DataFrame:
    """(id, path): names from the root to each category, by at most `hops` joins with the tree."""
    out = categories.select("id", F.col("parent").alias("_up"), F.col("name").alias("path"))
    above = categories.select(F.col("id").alias("_id"), F.col("parent").alias("_parent"), F.col("name").alias("_name"))
    for _ in range(hops):
        joined = out.join(above, F.col("_up") == F.col("_id"), "left")
        out = joined.select("id", F.col("_parent").alias("_up"), F.concat_ws(" / ", "_name", "path").alias("path"))
    return out.select("id", "path")


def merge_tables(base: DataFrame, overlay: DataFrame, key: str) -> DataFrame:
    """All rows of both by key; values of the overlay win where it has them."""
    names = [c for c in base.columns if c != key]
    over = overlay.select(key, *[F.col(c).alias(f"_o_{c}") for c in names if c in overlay.columns])
    return base.join(over, key, "full").select(key, *[F.coalesce(f"_o_{c}", c).alias(c) if c in overlay.columns else F.col(c) for c in names])
