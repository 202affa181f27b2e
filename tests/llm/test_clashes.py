"""Every operator on columns under names of its own kind, on nulls, ties, repeated rows, long texts and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from kartoteka.llm.chat import format_chats, turns_as_events
from kartoteka.llm.fingerprint import edited_report, fingerprinted
from kartoteka.llm.language import identify_language
from kartoteka.llm.minhash import near_duplicates
from kartoteka.llm.mixing import mix
from kartoteka.llm.packing import pack
from kartoteka.llm.suffix import remove_repeats, repeat_report
from kartoteka.llm.tokens import token_counts
from kartoteka.llm.vectors import near_vectors
from tests.llm import clashing

OPERATORS = {
    "mix": mix,
    "repeat_report": lambda d: repeat_report(d, length=30),
    "remove_repeats": lambda d: remove_repeats(d, length=30).select("doc_id", "text", "lang"),
    "identify_language": identify_language,
    "token_counts": lambda d: token_counts(d, budgets=(3,)),
    "pack": lambda d: pack(d).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")),
    "near_duplicates": near_duplicates,
    "fingerprinted": fingerprinted,
    "edited_report": edited_report,
}


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 60)}" for _ in range(n))
    rows = [(i, text(rng.randint(1, 40)), "ab"[i % 2], "st"[i % 2]) for i in range(14)]
    rows += [rows[3], rows[3], (3, None, None, None), (None, rows[4][1], "a", None), (None, None, None, "s"), (20, "", "b", "t"), (21, text(9_000), "a", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_of_other_columns_change_nothing(docs, name):
    run = OPERATORS[name]
    plain, extra = (sorted(run(d).collect(), key=str) for d in (docs, clashing(docs)))
    assert plain == extra and len(plain) > 0
    if name != "pack":
        assert len(plain) == docs.count()
    assert run(clashing(docs).limit(0)).count() == 0


def test_chats_and_vectors(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    plain, extra = (sorted(format_chats(turns_as_events(d)).collect(), key=str) for d in (turns, clashing(turns)))
    assert plain == extra and len(plain) == 2
    rows = [(1, 1, [1.0, 0.0]), (2, 1, [1.0, 0.01]), (2, 1, [1.0, 0.01]), (None, 1, [0.0, 1.0]), (3, None, [1.0, 0.0]), (4, 1, None), (5, 1, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    plain, extra = (sorted(near_vectors(d).collect(), key=str) for d in (vectors, clashing(vectors)))
    assert plain == extra and len(plain) == len(rows)
