"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.llm import oracles
from kartoteka.llm.chat import format_chats, read_back, turns_as_events
from kartoteka.llm.clustering import cluster_report
from kartoteka.llm.common import prepare, table
from kartoteka.llm.exact import exact_duplicates
from kartoteka.llm.fingerprint import edited_report
from kartoteka.llm.infill import infill_report
from kartoteka.llm.language import identify_language
from kartoteka.llm.minhash import near_duplicates
from kartoteka.llm.mixing import mix
from kartoteka.llm.packing import pack
from kartoteka.llm.suffix import repeat_report
from kartoteka.llm.tokens import token_counts
from kartoteka.llm.toxicity import toxicity
from kartoteka.llm.vectors import near_vectors


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repeat_report(table(spark, sf_dir, "documents"), length=400)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return identify_language(table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_counts(table(spark, sf_dir, "documents"), limit=4096)


#: Both turns of the added conversation say this.
PROBE = "\\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_chats(turns_as_events(rows.unionByName(probe))))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pack(table(spark, sf_dir, "documents"), capacity=2048, end_id=1)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return edited_report(table(spark, sf_dir, "documents"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), largest=True)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return cluster_report(table(spark, sf_dir, "embeddings"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_suffix": op2_suffix,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_tokens": op5_tokens,
    "op6_chat": op6_chat,
    "op7_packing": op7_packing,
    "op8_minhash": op8_minhash,
    "op9_vectors": op9_vectors,
    "op10_fingerprint": op10_fingerprint,
    "op11_exact": op11_exact,
    "op12_clusters": op12_clusters,
    "op13_infill": op13_infill,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op2_suffix": oracles.REPEATS,
    "op6_chat": oracles.CHAT,
    "op8_minhash": oracles.NEAR_TEXTS,
    "op9_vectors": oracles.NEAR_VECTORS,
    "op11_exact": oracles.COPIES,
    "op12_clusters": oracles.clusters(),
    "op13_infill": oracles.INFILL,
}
