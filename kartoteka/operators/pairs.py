"""Facts out of cards: "key: value" pairs from lists, lines, tables and shop attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.text import SPACE, html_chunks, is_heading_line, squeeze, strip_html

PAIR_TYPE = "array<struct<key:string,value:string>>"


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def pairs_of_chunks(chunks: Column) -> Column:
    """Chunks of the form "key: value" or "key – value"; headings and chunks without both parts give none."""
    split = f"^(.{{2,80}}?)(?::{SPACE}+|:(?=\\D)|{SPACE}+[–—-]{SPACE}+)(.+)$"
    pair = F.transform(chunks, lambda c: F.when(~is_heading_line(c), _pair(squeeze(F.regexp_extract(c, split, 1)), squeeze(F.regexp_extract(c, split, 2)))))
    return F.filter(pair, lambda p: p.isNotNull() & (p["key"] != "") & (p["value"] != ""))


def pairs_of_table(html: Column) -> Column:
    """Rows of two cells, or of three with the unit in the last."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<tr(?:\\s[^>]*)?>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), strip_html))
    pair = F.transform(F.filter(cells, lambda c: F.size(c).isin(2, 3)), lambda c: _pair(F.get(c, F.lit(0)), F.concat_ws(" ", F.get(c, F.lit(1)), F.get(c, F.lit(2)))))
    return F.filter(pair, lambda p: (p["key"] != "") & (p["value"] != ""))


def pairs_of_definitions(html: Column) -> Column:
    """Terms and descriptions of definition lists."""
    text = F.coalesce(html, F.lit(""))
    part = lambda tag: F.transform(F.regexp_extract_all(text, F.lit(f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), F.lit(1)), strip_html)
    pair = F.zip_with(part("dt"), part("dd"), lambda k, v: _pair(k, v))
    return F.filter(pair, lambda p: p["key"].isNotNull() & p["value"].isNotNull() & (p["key"] != "") & (p["value"] != ""))


def pairs_of_attributes(attributes: Column) -> Column:
    """Shop attributes array<struct<name, value>> with both parts."""
    pair = F.transform(attributes, lambda a: _pair(squeeze(a["name"]), squeeze(a["value"])))
    return F.filter(pair, lambda p: (p["key"] != "") & (p["value"] != ""))


def card_pairs(cards: DataFrame, id_col: str = "id", annotation: str = "annotation", description: str = "description", attributes: str | None = None) -> DataFrame:
    """(id, seq, key, value, source): attributes, then the annotation, then the description; the first of keys equal but for case.

    Positions within a card keep the order in which its sources count.
    """
    parts = [pairs_of_chunks(html_chunks(F.col(annotation))), F.concat(pairs_of_table(F.col(description)), pairs_of_definitions(F.col(description)), pairs_of_chunks(html_chunks(F.col(description))))]
    named = list(zip(("annotation", "description"), parts))
    if attributes:
        named.insert(0, ("attributes", pairs_of_attributes(F.col(attributes))))
    def tagged(name: str, found: Column) -> Column:
        return F.transform(F.coalesce(found, F.array().cast(PAIR_TYPE)), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.lit(name).alias("source")))

    flat = cards.select(F.col(id_col).alias("id"), F.posexplode(F.concat(*[tagged(*n) for n in named])).alias("seq", "p")).select("id", "seq", "p.*")
    others = F.struct("seq", "key", "value", "source")
    return flat.groupBy("id", F.lower("key").alias("_k")).agg(F.min(others).alias("p")).select("id", "p.*")


def two_numbers(value: Column) -> Column:
    """Both numbers of "a / b", as one key for two attributes holds them; null otherwise."""
    text = f"^\\D*(\\d+(?:[.,]\\d+)?)\\D*/\\D*(\\d+(?:[.,]\\d+)?)\\D*$"
    number = lambda i: F.translate(F.regexp_extract(value, text, i), ",", ".").try_cast("double")
    return F.when(value.rlike(text), F.array(number(1), number(2)))


def tag_balance(html: Column, tags: tuple[str, ...] = ("ul", "li", "p", "b", "h1", "table", "tr", "td")) -> Column:
    """Tags that open more often than they close, or the other way round."""
    text = F.lower(F.coalesce(html, F.lit("")))
    off = [F.when(F.regexp_count(text, F.lit(f"<{t}[\\s>]")) != F.regexp_count(text, F.lit(f"</{t}>")), F.lit(t)) for t in tags]
    return F.array_compact(F.array(*off))
