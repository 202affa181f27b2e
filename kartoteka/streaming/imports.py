"""Incremental imports on Structured Streaming: new files in, each product once, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def import_new(spark: SparkSession, incoming: str, schema: str, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends the first row of every key in the JSON files of `incoming` to Parquet at `out`, then stops.

    The checkpoint remembers files and keys, so a rerun takes up where the last
    one ended and known keys are skipped.
    """
    rows = spark.readStream.schema(schema).json(incoming).filter(F.col(key).isNotNull()).dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def facet_counts(rows: DataFrame, facet: str, at: str, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts of a facet's values per window of event time; rows later than `late` behind the latest are dropped."""
    return rows.withWatermark(at, late).groupBy(F.window(at, window), facet).agg(F.count("*").alias("cnt"))


def ledger_of(rows: DataFrame, sink: str, checkpoint: str, enrich) -> StreamingQuery:
    """Runs `enrich` (DataFrame to DataFrame) on every batch of new rows and adds its results to a ledger, with the batch's number.

    A batch is a folder of its own, so one that is run again after a failure
    takes the place of its first attempt.
    """

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").json(f"{sink}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CURSOR = "run long, next_offset long, last_offset long, last_limit long, last_added long, exhausted boolean"


def import_cursor(spark: SparkSession, album: str) -> dict:
    """Where the last finished import of an album ended; run 0 before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{album}/cursor")
    start = dict(run=0, next_offset=0, last_offset=0, last_limit=0, last_added=0, exhausted=False)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return start
    last = spark.read.schema(CURSOR).json(f"{album}/cursor").orderBy(F.desc("run")).first()
    return last.asDict() if last else start


def import_offers(offers: DataFrame, album: str, limit: int = 0) -> dict:
    """Takes the next `limit` offers (all, if 0) of a feed into an album, and returns the cursor after them.

    offers: place (from 0, in the feed's order), id, image_url and more. Offers
    without a picture, and those whose id the album or an earlier place has, are
    passed over. Items are written under the number of the run, then the cursor
    is; a run that failed between the two is done again under the same number
    and leaves what it would have left at once. A feed is exhausted when fewer
    offers than asked for were left.
    """
    spark, at = offers.sparkSession, import_cursor(offers.sparkSession, album)
    run, offset = at["run"] + 1, at["next_offset"]
    window = offers.filter((F.col("place") >= offset) & ((F.lit(limit) == 0) | (F.col("place") < offset + limit)))
    first = window.filter(F.col("image_url").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in window.columns]), "place").alias("o")).select("o.*")
    if run > 1:
        have = spark.read.parquet(f"{album}/items").filter(F.col("run") < run).select("id")
        first = first.join(have, "id", "left_anti")
    first.write.mode("overwrite").parquet(f"{album}/items/run={run}")
    added, seen = spark.read.parquet(f"{album}/items/run={run}").count(), window.count()
    after = dict(run=run, next_offset=offset + seen, last_offset=offset, last_limit=limit or seen, last_added=added, exhausted=limit > 0 and seen < limit)
    spark.createDataFrame([tuple(after.values())], CURSOR).coalesce(1).write.mode("overwrite").json(f"{album}/cursor/at={run}")
    return after
