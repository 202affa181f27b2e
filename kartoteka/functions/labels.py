"""Small questions about labels, filters, cards and costs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions.text import fold, html_chunks, let, squeeze

#: Marks of a search page that refuses to answer, and of one that does.
REFUSED, ANSWERED = "(?i)anomaly-modal|anomaly\\.js|unusual traffic|captcha|bots will be banned", "(?i)result__a|result-link|web-result"
#: How opinions of an efficiency class begin.
CLASS_OPINION = "(?iu)\\s*[,—–-]?\\s*(?:что\\s+)?(?:говорит|свидетельствует)\\s+о[^.;<]*"


def has_value(values: Column) -> Column:
    """Whether a filter (array of labels) holds anything."""
    return F.coalesce(F.size(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")) > 0, F.lit(False))


def shown_labels(values: Column) -> Column:
    """A filter's labels in a line; empty without any."""
    return F.array_join(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != ""), ", ")


def is_price_key(name: Column) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))).rlike("(?iu)^(?:цена|price)(?:\\s*,\\s*₽)?$")


def is_strict(kind: Column, flag: Column, aliases: Column) -> Column:
    """Whether an attribute takes only canonical values (aliases: a map by them): by its flag, or else because it has some."""
    return kind.isin("enum", "text") & F.coalesce(flag, F.coalesce(F.size(aliases) > 0, F.lit(False)))


def label_has_unit(label: Column) -> Column:
    """Whether a label ends in a comma and a unit."""
    return F.coalesce(label, F.lit("")).rlike(",\\s*\\S+$")


def singular_type(name: Column) -> Column:
    """A section's name as the type of one product: "Стиральные машины" is "стиральная машина"; null if empty."""
    pair = "^(\\S+?)ые\\s+(\\S+?)ы$"
    soft = "^(\\S+?)ие\\s+(\\S+?)и$"
    part = lambda t, p, i: F.regexp_extract(t, p, i)
    one = lambda t: F.when(t == "", None).when(t.rlike(pair), F.concat(part(t, pair, 1), F.lit("ая "), part(t, pair, 2), F.lit("а"))).when(t.rlike(soft), F.concat(part(t, soft, 1), F.lit("яя "), part(t, soft, 2))).when(t.rlike("^\\S+и$"), F.regexp_replace(t, "и$", "")).otherwise(t)
    return let(squeeze(fold(name)), one)


def texts_empty(*texts: Column) -> Column:
    """Whether a card has no text at all."""
    return squeeze(F.concat_ws(" ", *texts)) == ""


def refused_search(html: Column) -> Column:
    """Whether a search page refused to answer and shows no result."""
    t = F.coalesce(html, F.lit(""))
    return t.rlike(REFUSED) & ~t.rlike(ANSWERED)


def spaced_strong(html: Column) -> Column:
    """Bold words set apart from the words beside them."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), "(?<=[\\p{L}\\d])<strong>", " <strong>")
    return F.regexp_replace(t, "</strong>(?=[\\p{L}\\d—–-])", "</strong> ")


def glued_strong(html: Column) -> Column:
    """How many bold words touch the words beside them."""
    t = F.coalesce(html, F.lit(""))
    return F.regexp_count(t, F.lit("(?<=[\\p{L}\\d])<strong>")) + F.regexp_count(t, F.lit("</strong>(?=[\\p{L}\\d—–-])"))


def annotation_map(html: Column) -> Column:
    """The lines of a card's list as a map of label to value; of lines with one label the last counts."""
    pattern = "^([^::\\-–—]+)[::\\-–—]\\s*(.+)$"
    pairs = F.transform(html_chunks(html), lambda c: F.struct(squeeze(F.regexp_extract(c, pattern, 1)).alias("k"), squeeze(F.regexp_extract(c, pattern, 2)).alias("v")))
    told = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != ""))
    last = lambda ps: F.filter(F.transform(ps, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(ps, p["i"] + 2, F.size(ps)), lambda later: later["k"] == p["k"]))
    return let(told, lambda ps: F.map_from_entries(F.transform(last(ps), lambda p: F.struct(p["k"], p["v"]))))


def without_class_opinion(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CLASS_OPINION, "")


def xml_escaped(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def cost_in(amount: Column, currency: Column, rates: dict[str, float], digits: int = 4) -> Column:
    """An amount in the currency that the rates (currency: factor) lead to, rounded half up; null for unknown currencies."""
    factor = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.upper(currency))
    return F.floor(amount * factor * 10**digits + 0.5) / 10**digits


def done_label(parsed: Column, corrected: Column) -> Column:
    """How a finished card came about."""
    return F.concat_ws("+", F.lit("model"), F.when(parsed, "parser"), F.when(corrected, "corrected"))
