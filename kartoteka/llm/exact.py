"""Exact duplicates by a tree of merged digest runs, with DataFrame functions only.

Every partition turns its rows into a run of (digest, best identifier, rows),
sorted by digest. Runs meet in rounds: `ways` runs of one round are merged into
one of the next, so a digest is in at most ways**(rounds - r) records after
round r, however many rows hold it, and each merge keeps only the identifier
that stays. An exchange deals the records of a merged run out by digest, so no
task holds a whole run. Digests are SHA-256; a record is merged with another
only if the byte length and a second hash agree too.

A row's answer comes back by a join on the digest. Only digests of two rows and
more take part; a digest of very many rows is a skewed key on the side of the
rows, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.llm.common import written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs that are merged into one, and rounds: the first round has WAYS ** ROUNDS runs.
WAYS, ROUNDS = 16, 2
#: A digest and what verifies it.
KEY = ("digest", "check", "bytes")


def lower_ascii(text: Column) -> Column:
    """text with A-Z lower-cased and nothing else; null as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, digest, check, bytes) for every row; row numbers rows across partitions."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(F.col(f"`{text_col}`")).alias("said"))
    return texts.select("id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("said", 256)).alias("digest"), F.xxhash64("said").alias("check"), F.octet_length("said").alias("bytes"))


def merge_runs(runs: DataFrame, keep: Callable[[str], Column] = F.min, ways: int = WAYS, rounds: int = ROUNDS) -> DataFrame:
    """One record a digest: the least `best` of its records (or what `keep` takes of them) and the sum of their `size`.

    runs has run (from 0), best (anything with an order), size and the columns
    of KEY. Runs numbered ways**rounds and above share a number with lower ones.
    """
    runs = runs.withColumn("run", F.pmod("run", F.lit(ways**rounds)))
    for _ in range(rounds):
        runs = runs.withColumn("run", F.floor(F.col("run") / ways)).groupBy("run", *KEY).agg(keep("best").alias("best"), F.sum("size").alias("size"))
    return runs.select(*KEY, "best", "size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = False, ways: int = WAYS, rounds: int = ROUNDS) -> DataFrame:
    """Which row of equal texts stays: id_col, keep_id, group_size, kept, text_sha256 for every row.

    Texts are equal when identical after A-Z are lower-cased. The row of the
    smallest id stays, or of the largest; ids may be of any type with an order.
    Null texts count as empty and equal empty ones. A null id stays only where no
    row of the text has another. Of rows that tie in id and text one stays. Whole
    texts are hashed, however long; extra columns may have any names and are not
    looked at. An empty table gives an empty result.
    """
    rows = written(digests(docs, id_col, text_col))
    has_id = F.col("id").isNotNull()
    best, keep = (F.struct(has_id, "id", (-F.col("row")).alias("at")), F.max) if largest else (F.struct(~has_id, "id", F.col("row").alias("at")), F.min)
    # the bits of a row's number above the 33rd are its partition, whose run it belongs to
    runs = rows.select(F.shiftright("row", 33).alias("run"), *KEY, best.alias("best"), F.lit(1).cast("long").alias("size"))
    merged = merge_runs(runs, keep, ways, rounds).filter("size > 1")
    groups = written(merged.select(*KEY, F.col("best")["id"].alias("keep_id"), F.abs(F.col("best")["at"]).alias("keep_row"), "size"))
    joined = rows.join(groups, list(KEY), "left")
    alone = F.col("size").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
