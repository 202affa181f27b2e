"""Sinks: category outputs, append-only ledgers, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_category(products: DataFrame, filters: DataFrame, folder: str, category: int) -> None:
    """The two tables of a category, each replaced as a whole by Spark's committer."""
    products.write.mode("overwrite").json(f"{folder}/products_{category}")
    filters.write.mode("overwrite").json(f"{folder}/filters_{category}")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_rows(rows: DataFrame, path: str, kind: str) -> None:
    """json (lines), parquet, csv or xml."""
    if kind == "xml":
        rows.write.mode("overwrite").format("xml").option("rowTag", "item").option("rootTag", "items").save(path)
    elif kind == "csv":
        rows.write.mode("overwrite").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").format(kind).save(path)


def write_missing(missing: DataFrame, path: str) -> None:
    """Ids without a value, a folder for each filter."""
    missing.write.mode("overwrite").partitionBy("filter").option("header", True).csv(path)


def write_artefacts(tables: dict[str, DataFrame], folder: str, category: int, dirty: DataFrame | None = None) -> list[str]:
    """One JSON table an artefact of a category (data, products, filters, coverage, held, report ...); the names written.

    With dirty values (any row) the filters are held back and the values are
    written as filters_reject instead; products go out all the same.
    """
    refused = dirty is not None and bool(dirty.take(1))
    out = {k: v for k, v in tables.items() if not (refused and k.startswith("filters") and k != "filters_coverage")}
    if refused:
        out["filters_reject"] = dirty
    for name, table in out.items():
        table.write.mode("overwrite").json(f"{folder}/{name}_{category}")
    return sorted(out)


#: Versions of a dump that are kept.
VERSIONS = 8


def save_version(rows: DataFrame, folder: str, version: int, keep: int = VERSIONS) -> None:
    """One version of a dump beside the others, of which the newest `keep` stay; readers take the highest (latest_version)."""
    rows.write.mode("overwrite").parquet(f"{folder}/version={version}")
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    held = sorted((int(f.getPath().getName().removeprefix("version=")), f.getPath()) for f in files.listStatus(root) if f.getPath().getName().startswith("version="))
    for _, path in held[:-keep]:
        files.delete(path, True)


def restore_version(spark, folder: str, version: int, as_version: int) -> None:
    """An older version of a dump as the newest one."""
    rows = spark.read.parquet(f"{folder}/version={version}")
    save_version(rows, folder, as_version)


def latest_version(spark, folder: str) -> DataFrame:
    every = spark.read.parquet(folder)
    newest = every.agg(F.max("version")).first()[0]
    return every.filter(F.col("version") == newest).drop("version")
