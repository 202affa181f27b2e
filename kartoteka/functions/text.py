"""Text normalisation of catalog cards as Column expressions (no Python per row)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as product cards use it: the JVM's \s knows neither of the last two.
SPACE = "[\\s\\u00A0\\uFEFF]"
#: Entities that cards hold, with what they stand for.
ENTITIES = {"nbsp": " ", "times": "×", "deg": "°", "ndash": "–", "mdash": "–", "laquo": "«", "raquo": "»", "quot": '"', "amp": "&", "lt": "<", "gt": ">"}
#: Cyrillic letters and the Latin letters they are mistaken for.
LOOKALIKES = ("аеорсухкмтнв", "aeopcyxkmthb")
#: Units that may follow a key or stand in brackets after it.
KEY_UNITS = ("кг", "г", "см", "мм", "м", "л", "мл", "дба", "дб", "об/?\\s*мин", "квт·ч/год", "квт\\*?ч/?кг", "квтч/г", "квт", "шт", "%", "кг/сут")
#: Phrases of keys of packed sizes, and the one that says the opposite.
PACKED, UNPACKED = ("в упаковк", "товарной упаковк", "с учетом упаковк", "брутто", "в коробк"), "без упаковк"
_UNITS = "(?:" + "|".join(KEY_UNITS) + ")"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def decode_entities(c: Column) -> Column:
    for name, stands_for in ENTITIES.items():
        c = F.regexp_replace(c, f"(?i)&{name};?", stands_for)
    return c


def decode_numeric_entities(c: Column) -> Column:
    """&#1234; and &#x4D2; as their characters."""
    parts = F.split(F.coalesce(c, F.lit("")), "(?=&#[xX]?[0-9A-Fa-f]{1,6};)")
    code = lambda p: F.coalesce(F.conv(F.nullif(F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]{1,6});", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(p, "^&#([0-9]{1,6});", 1), F.lit(""))).cast("int")
    shown = lambda p: F.when(code(p).isNotNull(), F.concat(_character(code(p)), F.regexp_replace(p, "^&#[xX]?[0-9A-Fa-f]{1,6};", ""))).otherwise(p)
    return F.array_join(F.transform(parts, shown), "")


def _character(code: Column) -> Column:
    """The character of a code point of the basic plane, from its UTF-16 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def strip_html(c: Column) -> Column:
    """Visible text of a fragment: entities decoded, then tags as spaces; null is empty."""
    return squeeze(F.regexp_replace(decode_entities(F.coalesce(c, F.lit(""))), "<[^>]+>", " "))


def fold(c: Column) -> Column:
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")


def fold_lookalikes(c: Column) -> Column:
    return F.translate(fold(c), *LOOKALIKES)


def norm_key(c: Column) -> Column:
    """Normal form of an attribute key: folded, without its unit, qualifiers of size and punctuation."""
    c = F.regexp_replace(F.regexp_replace(fold(c), "&nbsp;?", " "), "[«»„“”\"'`]", "")
    for left, right in (("\\(", "\\)"), ("\\[", "\\]")):
        c = F.regexp_replace(c, f"(?iu){left}{SPACE}*{_UNITS}{SPACE}*{right}", " ")
    c = F.regexp_replace(c, "[()\\[\\]]", " ")
    c = F.regexp_replace(c, f"(?iu)(?:,{SPACE}*|{SPACE}+){_UNITS}$", " ")
    c = F.regexp_replace(c, "(?<![^\\s(,;])[mм]ax(?![^\\s),;.])", " ")
    c = F.regexp_replace(c, "[,.;:!?*/\\\\|+\\-–—]", " ")
    return squeeze(F.translate(c, "×х", "xx"))


def tokens(c: Column) -> Column:
    return F.filter(F.split(norm_key(c), " "), lambda t: t != "")


def token_bag(c: Column) -> Column:
    """Key for matching whatever the order of words."""
    return F.array_join(F.array_sort(F.array_distinct(tokens(c))), " ")


def annotation_format(c: Column) -> Column:
    """LI, BR, OTHER or EMPTY: how a card lists its facts."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike("(?i)<li[\\s>/]"), "LI").when(text.rlike("(?i)<br[\\s>/]"), "BR").when(strip_html(text) != "", "OTHER").otherwise("EMPTY")


def html_chunks(c: Column) -> Column:
    """Visible texts of the list items, or else of the lines between breaks; empty ones dropped."""
    text = F.coalesce(c, F.lit(""))
    items = F.regexp_extract_all(text, F.lit("(?is)<li(?:\\s[^>]*)?>(.*?)</li>"), F.lit(1))
    chunks = F.when(text.rlike("(?i)<li[\\s>/]"), items).otherwise(F.split(text, "(?i)<br\\s*/?>"))
    return F.filter(F.transform(chunks, strip_html), lambda x: x != "")


def value_fold(c: Column) -> Column:
    """Values that differ in case, spaces, hyphens or punctuation fold to one."""
    return F.regexp_replace(fold(c), f"{SPACE}|[-–—.,;:\"'«»()]", "")


def bigrams(c: Column) -> Column:
    """The set of letter pairs of the text between two spaces."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substr(padded, i, F.lit(2))))


def dice(a: Column, b: Column) -> Column:
    """2 |A ∩ B| / (|A| + |B|) over letter pairs."""
    left, right = bigrams(a), bigrams(b)
    return 2 * F.size(F.array_intersect(left, right)) / (F.size(left) + F.size(right))


def is_packing_key(c: Column) -> Column:
    """Keys of gross or packed sizes, which are not the product's own."""
    return let(squeeze(fold(c)), lambda t: ~F.contains(t, F.lit(UNPACKED)) & F.exists(F.array(*map(F.lit, PACKED)), lambda p: F.contains(t, p)))


#: Three capitals or more, and no small letter or digit; a colon at the end, and no "key: value" before it.
SHOUTED, ANNOUNCED = "^(?:[^\\p{Ll}\\d]*\\p{Lu}){3}[^\\p{Ll}\\d]*$", "^(?!.*\\S:\\s*\\S).*:\\s*$"


def is_heading_line(c: Column) -> Column:
    """Empty lines, lines that announce others, and lines all in capitals."""
    return let(squeeze(F.coalesce(c, F.lit(""))), lambda t: (t == "") | t.rlike(ANNOUNCED) | t.rlike(SHOUTED))


def number_label(c: Column, digits: int = 3) -> Column:
    """A number as labels show it: whole numbers bare, others without trailing zeros."""
    exact = F.format_string(f"%.{digits}f", c.cast("double"))
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(exact, "(\\.\\d*?)0+$", "$1"), "\\.$", ""))


def model_token(c: Column) -> Column:
    """The longest word of four or more characters with a letter and two digits; the first of equals."""
    words = F.filter(F.split(squeeze(F.coalesce(c, F.lit(""))), " "), lambda w: (F.length(w) >= 4) & w.rlike("\\p{L}") & (F.regexp_count(w, F.lit("\\d")) >= 2))
    best = F.array_max(F.transform(words, F.length))
    return F.get(F.filter(words, lambda w: F.length(w) == best), F.lit(0))


#: Endings of adjectives.
ADJECTIVE_ENDINGS = ("ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие")


def value_stem(c: Column) -> Column:
    """value_fold without the ending of an adjective and without -ист."""
    return F.regexp_replace(F.regexp_replace(value_fold(c), f"(?:{'|'.join(ADJECTIVE_ENDINGS)})$", ""), "ист$", "")


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, "^(?:https?)://([^/:?#]+)", 1)), "^www\\.", "")


def canonical_url(c: Column) -> Column:
    """Without fragment, tracking parameters and the slash at the end."""
    c = F.regexp_replace(c, "#.*$", "")
    c = F.regexp_replace(c, "(?i)([?&])(?:utm_[a-z]+|gclid|yclid|fbclid)=[^&]*", "$1")
    return F.regexp_replace(F.regexp_replace(c, "[?&]+$", ""), "/$", "")
