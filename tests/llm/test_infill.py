"""Fill-in-the-middle against a plain Python version, unit grammars against findall, and the way back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kartoteka.llm.infill import GRAMMARS, infill, infill_report, restored, units
from tests.llm import clashing

WHOLE = {
    "lines": r"[^\n]*\n|[^\n]+",
    "words": r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+",
    "paragraphs": r"(?:[^\n]|\n(?!\n))+\n*|\n+",
    "characters": r"[\s\S]",
}
ODD = ["", "\n", "\n\n\n", "a", "a\n", "\na", "a\n\nb\r\nc", "x y\u0085z\n\x0bq", "😀\n😀😀", "<P>", "a <S\n>", "a\n<M>\nb", "<\nS>\nP>\n", "a b  c\td", None]


def texts():
    rng = random.Random(2)
    return [*ODD, *["".join(rng.choice("ab<>PSM \n\né😀") for _ in range(rng.randint(1, 40))) for _ in range(300)], "word and line\n" * 20_000]


@pytest.mark.parametrize("unit", sorted(WHOLE))
def test_boundaries_give_the_units_of_the_grammar(spark, unit):
    said = [t for t in texts() if t is not None][:-1]
    df = spark.createDataFrame([(t,) for t in said], "t string").select(units(F.col("t"), GRAMMARS[unit]))
    assert [r[0] for r in df.collect()] == [re.findall(WHOLE[unit], t) for t in said]


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    us = re.findall(WHOLE["lines"], text)
    n = len(us)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(us[:low]), "".join(us[low:high]), "".join(us[high:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


def test_report_matches_a_plain_version(spark):
    rows = [*enumerate(texts()), (None, "a\nb\nc"), (3, "tie\nof an id"), (3, "tie\nof an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([brute(*r) for r in rows], key=str)
    assert sorted([tuple(r) for r in infill_report(df).collect()], key=str) == want
    assert sorted([tuple(r) for r in infill_report(clashing(df)).collect()], key=str) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    assert infill_report(df.limit(0)).collect() == []


@pytest.mark.parametrize("unit", sorted(GRAMMARS))
def test_every_text_comes_back_in_every_grammar(spark, unit):
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    made = infill(df, GRAMMARS[unit], seed=1, rate=70, spm=30).withColumn("again", restored(F.col("output"), F.col("form")))
    both = made.join(df, "doc_id")
    assert both.filter(~F.col("again").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    parts = both.filter("form <> 'plain'")
    assert parts.filter("concat(prefix, middle, suffix) <> text").count() == 0
    share = parts.count() / df.filter("text <> '' and not text rlike '<[PSM]>'").count()
    assert 0.55 < share < 0.85
