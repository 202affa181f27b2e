"""A training corpus from `documents`: five stages, each an operator of kartoteka.llm.

Each stage works on all rows its predecessor kept, written as Parquet and read
again, and returns the columns of `documents`; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.llm.common import cut, discard, is_empty, new_path, prepare, release, table, written
from kartoteka.llm.language import UNKNOWN, identify_language
from kartoteka.llm.minhash import near_duplicates
from kartoteka.llm.mixing import mix
from kartoteka.llm.packing import pack
from kartoteka.llm.suffix import remove_repeats

#: A document is rejected where its likeliest language lies less than this share of the way from chance (one of all known) to certainty.
LEAST_SURE = 2 / 15
#: Words of the shortest repeated passage that goes: passages of over 50 words do.
REPEAT_WORDS = 51


def _same_rows(docs: DataFrame) -> list[Column]:
    """What tells rows apart: all their values, and where these are null."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return [*columns, *[c.isNull() for c in columns]]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: without a letter, or none clearly likelier than chance.

    Null and empty texts hold no letter and go. Rows are judged one by one, so
    repeated rows, tied and null ids do not matter; extra columns may have any
    names. Where no row has a language to learn from, no language is known and
    all go. An empty table stays empty.
    """
    prepare(spark)
    named = identify_language(docs, row_col="row")
    chance = 1 / max(1, docs.agg(F.countDistinct("lang")).first()[0])
    likely = F.col("score") >= chance + LEAST_SURE * (1 - chance) - 1e-6
    return named.filter((F.col("lang_pred") != UNKNOWN) & likely).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (Jaccard 0.8 of five-word shingles): that of least id, null last.

    Rows are told apart by a hash of all their columns, so ids may be null or
    tied, and extra columns may have any names. Of rows that agree in all
    columns one stays. Rows without a word, null texts among them, are no copies
    of anything and all stay. An empty table stays empty.
    """
    prepare(spark)
    keyed = docs.select(F.xxhash64(*_same_rows(docs)).alias("key"), F.col("doc_id").alias("id"), F.col("text").alias("text"), F.struct("*").alias("row"))
    rows = near_duplicates(keyed.select("key", "text"), id_col="key", percent=80).groupBy("key").agg(F.first("component_id").alias("component"), (F.first("n_shingles") > 0).alias("words"), F.count("*").alias("n"))
    ids = keyed.groupBy("key").agg(F.first("id").alias("id"))
    order = F.struct(F.col("id").isNull(), "id", "key", (F.col("words") & (F.col("n") > 1)).alias("again"))
    kept = rows.join(ids, "key").groupBy("component").agg(F.min(order).alias("least")).select("least.key", "least.again")
    kept = cut(kept)
    release(spark)  # what the search has shuffled, before the texts are
    again = kept.filter("again")
    if is_empty(again):
        return keyed.join(kept, "key", "left_semi").select("row.*")
    once = keyed.join(kept.filter("not again"), "key", "left_semi").select("key", "row")
    return once.unionByName(keyed.join(again, "key", "left_semi").select("key", "row").dropDuplicates(["key"])).select("row.*")


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of over 50 words that occur more than once out of the texts; documents stay, if empty too.

    Passages are compared word by word, so neither the bytes of their words nor
    the white space between these matter. Repeated rows repeat each other's
    texts, whatever their ids; null texts stay null. Extra columns may have any
    names; n_chars, where it is there, follows the text. An empty table stays
    empty.
    """
    prepare(spark)
    spans = "removed_spans"
    while spans in docs.columns:
        spans += "_"
    done = remove_repeats(docs, length=REPEAT_WORDS, words=True, spans_col=spans)
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source comes near its target.

    A document stands in the result as often as the mix takes its words; a
    fraction left over becomes a whole copy with that probability, by a seeded
    hash of its id and text. Rows that share an id share their words, null ids
    too. Documents without a word, null texts among them, have none that the mix
    could take and go. A null source is a source. Extra columns may have any
    names. An empty table stays empty.
    """
    taken = mix(docs.select("doc_id", "text", "source")).groupBy(F.col("doc_id").alias("taken_id")).agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("times"))
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.lit(17), "doc_id", "text").alias("h"), F.struct("*").alias("row"))
    chance = F.pmod("h", F.lit(1 << 20)) / (1 << 20)
    copies = F.floor("times") + F.when(chance < F.col("times") - F.floor("times"), 1).otherwise(0)
    joined = rows.join(taken, F.col("id").eqNullSafe(F.col("taken_id"))).withColumn("copies", copies).filter("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mixed documents in sequences of 2048.

    Null and empty texts are the end token alone; repeated rows and ids are
    packed like any others, a null id stays null. Only doc_id and text are looked
    at. An empty table gives no piece.
    """
    prepare(spark)
    return pack(docs, capacity=2048, end_id=1)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("mixing", mixing), ("packing", packing)]

#: A trained network decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. A stage's table goes once the next one's is written; the last stage keeps what it needs of it itself."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    packed = STAGES[-1][1](spark, docs, sf_dir)
    discard(spark, before)
    return packed
