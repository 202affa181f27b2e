"""Fill-in-the-middle transformation, with DataFrame functions only.

A unit grammar is a list of pairs of neighbouring character classes: a unit ends
wherever a character of the first class stands before one of the second. As a
regular expression that is a lookbehind and a lookahead of no width, so Spark's
split cuts there and keeps every character; joined, the pieces are the text. An
empty text, for which split gives one empty piece, has no unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ANY, _SPACE, _WORD = r"[\x00-\x{10FFFF}]", r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: What ends a unit, and what may begin the next. Line: up to its line feed. Word: with
#: the white space after it. Paragraph: with the empty lines after it. Sentence: up to
#: its marks and the white space after them.
GRAMMARS: dict[str, list[tuple[str, str]]] = {
    "lines": [(r"\n", _ANY)],
    "words": [(_SPACE, _WORD)],
    "paragraphs": [(r"\n\n", r"[^\n]")],
    "sentences": [(rf"[.!?]{_SPACE}{{1,8}}", _WORD)],
    "characters": [(_ANY, _ANY)],
}
SENTINELS = ("<P>", "<S>", "<M>")


def boundary(grammar: list[tuple[str, str]]) -> str:
    """The regular expression of no width that matches between the classes of any pair."""
    return "|".join(f"(?<={before})(?={after})" for before, after in grammar)


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of text, in order; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def infill(docs: DataFrame, grammar: list[tuple[str, str]] = GRAMMARS["lines"], seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (units), form, prefix, middle, suffix, output for every row.

    Two of the four numbers that the hash of seed and id gives draw the places
    of the cuts among the n + 1 between units, the third whether a text is
    transformed (`rate` of 100), the fourth whether its suffix comes first
    (`spm` of 100). A text that is empty or holds a sentinel stays plain, with
    null parts; so every output but a plain one holds each sentinel once. Null
    texts count as empty, null ids as an empty number; rows of one id are cut by
    the same numbers. A text is one cell and its units one array, however long.
    Extra columns may have any names and are not looked at. An empty table gives
    an empty result.
    """
    p, s, m = sentinels
    said = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("said"))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    cut = said.select("*", drawn.alias("drawn"), units(F.col("said"), grammar).alias("units"))
    h1, h2, h3, h4 = (F.conv(F.substring("drawn", at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25))
    n = F.size("units").cast("long")
    plain = (F.col("said") == "") | F.contains("said", F.lit(p)) | F.contains("said", F.lit(s)) | F.contains("said", F.lit(m)) | (h3 % 100 >= rate)
    placed = cut.select("id", "said", "units", n.alias("n"), (h1 % (n + 1)).alias("one"), (h2 % (n + 1)).alias("two"), F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm").alias("form"))
    placed = placed.select("id", "said", "units", "n", "form", F.least("one", "two").cast("int").alias("low"), F.greatest("one", "two").cast("int").alias("high"))
    part = lambda begin, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", begin, length), ""))
    low, high = F.col("low"), F.col("high")
    parts = placed.select("id", "said", "n", "form", part(F.lit(1), low).alias("prefix"), part(low + 1, high - low).alias("middle"), part(high + 1, F.size("units")).alias("suffix"))
    psm = F.concat(F.lit(p), "prefix", F.lit(s), "suffix", F.lit(m), "middle")
    spm_ = F.concat(F.lit(s), "suffix", F.lit(p), "prefix", F.lit(m), "middle")
    output = F.when(F.col("form") == "plain", F.col("said")).when(F.col("form") == "psm", psm).otherwise(spm_)
    return parts.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text an output was made from."""
    p, s, m = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n, form, the parts' lengths in code points, and hashes of the output and of the text rebuilt from it; as infill() for the rest."""
    made = infill(docs, id_col=id_col, text_col=text_col).withColumn("text_again", restored(F.col("output"), F.col("form")))
    chars = lambda c: F.char_length(c).cast("long")
    return made.select(id_col, "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("text_again", 256).alias("restored_sha256"))
