"""Values and texts as a shop shows them: spellings, lists, labels, reviews, search phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions.text import SPACE, html_chunks, let, number_label, squeeze, strip_html, value_fold

#: Small and capital Cyrillic letters.
SMALL, CAPITAL = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
#: Words that repeat the attribute's name before or after a value.
ECHO_BEFORE, ECHO_AFTER = "(?:цвет|тип|товара|значение|корпус[аеу]?)", "(?:загрузк[аиеу]|корпуса?|товара|машины?|цвет)"
ECHO_ONLY = "^(?:загрузк[аиеу]?|корпус[аеу]?|товара?|машины?|цвет|тип|значение)$"
#: A shop's legal phrases that stick to the last fact of a card.
LEGAL = (
    "производитель\\s+на\\s+сво[её]\\s+усмотрение", "производитель\\s+оставляет\\s+за\\s+собой\\s+право", "производитель\\s+вправе\\s",
    "внешний\\s+вид\\s+товара\\s+может", "характеристик[аи]\\s+могут\\s+(?:быть\\s+изменены|отличаться)", "информация\\s+о\\s+технических\\s+характеристиках",
)
#: Names of units in snake-case keys.
KEY_UNITS = {
    "мм": "мм", "см": "см", "кг": "кг", "г": "г", "л": "л", "мл": "мл", "вт": "Вт", "дб": "дБ", "мес": "мес", "мин": "мин", "ч": "ч", "м": "м",
    "об_мин": "об/мин", "кг_сут": "кг/сут", "л_цикл": "л/цикл", "л_мин": "л/мин", "м2_л": "м²/л", "кг_м2": "кг/м²",
}


def _cyrillic_only(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?iu){pattern}", "")


def display_value(c: Column) -> Column:
    """One spelling of a value: no echo words, brackets only with Latin letters, Cyrillic words small after a capital; Latin stays."""
    t = squeeze(F.coalesce(c, F.lit("")))
    t = squeeze(F.regexp_replace(t, "\\s*\\((?![^)]*[A-Za-z])[^)]*\\)\\s*", " "))
    t = squeeze(F.regexp_replace(t, "[.;,]+$", ""))
    t = squeeze(_cyrillic_only(_cyrillic_only(t, f"^{ECHO_BEFORE}\\s+"), f"\\s+{ECHO_AFTER}$"))
    t = F.regexp_replace(t, "(?iu)нерж\\.?\\s*стал[ьи]?", "нержавеющая сталь")
    t = F.regexp_replace(t, "[Cc](?=[А-ЯЁа-яё])|(?<=[А-ЯЁа-яё])[Cc]", "с")
    shown = lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.translate(F.substr(x, F.lit(2)), CAPITAL, SMALL))
    return let(t, lambda x: F.when(value_fold(x).rlike(ECHO_ONLY), "").when(x.rlike("[А-ЯЁа-яё]"), shown(x)).otherwise(x))


def split_values(c: Column) -> Column:
    """The values of a list cut at commas, semicolons, slashes, bars and the word "и"."""
    parts = F.split(squeeze(F.coalesce(c, F.lit(""))), "\\s*[,;/|]\\s*|\\s+и\\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def distinct_folded(values: Column) -> Column:
    """The first spelling of each value, in order."""
    indexed = F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.transform(F.filter(indexed, lambda x: ~F.exists(F.slice(values, F.lit(1), x["i"]), lambda before: value_fold(before) == value_fold(x["v"]))), lambda x: x["v"])


def size_text(size: Column, unit: Column | None = None, order: tuple[str, ...] = ("width", "height", "depth")) -> Column:
    """"a×b×c", with the unit if there is one; empty while a measure is missing."""
    whole = F.concat_ws("×", *[number_label(size[a]) for a in order])
    told = whole if unit is None else F.when(unit.isNull(), whole).otherwise(F.concat_ws(" ", whole, unit))
    complete = size[order[0]].isNotNull() & size[order[1]].isNotNull() & size[order[2]].isNotNull()
    return F.coalesce(F.when(complete, told), F.lit(""))


def shown_value(kind: Column, value: Column, unit: Column) -> Column:
    """A value of an attribute as card and filter show it: yes and no as words, numbers with their unit, others by display_value; empty if there is none."""
    number = number_label(value.try_cast("double"))
    yes_no = F.when(value == "true", "Есть").when(value == "false", "Нет")
    counted = F.when(unit.isNull(), number).otherwise(F.concat_ws(" ", number, unit))
    return F.coalesce(F.when(kind == "boolean", yes_no).when(kind.isin("number", "integer"), counted).when(kind == "class_scale", value).otherwise(display_value(value)), F.lit(""))


def annotation_line(name: Column, kind: Column, value: Column, unit: Column) -> Column:
    """"Name: value" of a card's list: as shown_value, but words begin small unless they are Latin or classes; null without a value."""
    shown = shown_value(kind, value, unit)
    small = F.when(kind.isin("class_scale", "number", "integer") | ~shown.rlike("[А-ЯЁа-яё]"), shown).otherwise(F.concat(F.lower(F.left(shown, F.lit(1))), F.substr(shown, F.lit(2))))
    return F.when(shown != "", F.concat(name, F.lit(": "), small))


def without_legal_tail(c: Column) -> Column:
    """The text before a shop's legal phrases."""
    cut = F.split(squeeze(F.coalesce(c, F.lit(""))), f"(?iu)(?:^|\\s)\\*?\\s*(?:{'|'.join(LEGAL)})", 2)
    return F.when(F.size(cut) > 1, F.regexp_replace(F.get(cut, F.lit(0)), "[.,;:*\\s]+$", "")).otherwise(F.get(cut, F.lit(0)))


def plain_parts(c: Column) -> Column:
    """A paragraph's facts: cut at sentences, else semicolons, else double spaces, whichever gives three parts; null otherwise."""
    text = F.coalesce(c, F.lit(""))
    parts = lambda pattern: F.filter(F.transform(F.split(text, pattern), squeeze), lambda x: x != "")
    ways = F.array(*[parts(p) for p in ("\\.\\s+(?=[А-ЯЁA-Z])", "\\s*;\\s*", f"(?<=\\S){SPACE}{{2,}}")])
    return F.get(F.filter(ways, lambda w: F.size(w) >= 3), F.lit(0))


def looks_dumped(html: Column) -> Column:
    """Whether a description is a table of facts: eight chunks or dashes, five lines, or a list."""
    text = F.coalesce(html, F.lit(""))
    chunks, dashes = F.size(html_chunks(text)), F.regexp_count(strip_html(text), F.lit("\\s[-–—]\\s"))
    lines = text.rlike("(?i)<br[\\s>/]") & (chunks >= 5)
    return (strip_html(text) != "") & ((chunks >= 8) | (dashes >= 8) | lines | text.rlike("(?i)<li[\\s>/]"))


def key_label(key: Column) -> Column:
    """struct<label, unit> of a snake-case key whose last one or two words may name a unit."""
    words = F.split(key, "_")
    units = F.create_map(*[F.lit(x) for pair in KEY_UNITS.items() for x in pair])
    tail = lambda n: F.when(F.size(words) > n, F.element_at(units, F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.lit(n)), "_")))
    cut = F.when(tail(2).isNotNull(), 2).when(tail(1).isNotNull(), 1).otherwise(0)
    label = F.array_join(F.slice(words, F.lit(1), F.size(words) - cut), " ")
    return F.struct(F.concat(F.upper(F.left(label, F.lit(1))), F.substr(label, F.lit(2))).alias("label"), F.coalesce(tail(2), tail(1), F.lit("")).alias("unit"))


#: Shortest and longest text of a review that is shown.
REVIEW_LEAST, REVIEW_MOST = 300, 700
#: Marks of a review and of a first person who owns the thing.
REVIEW_MARKS = "(?iu)достоинства|недостатки|плюсы|минусы|отзыв|я\\s+(?:купил|купила|брал|взял|доволен|довольна)|(?<!\\p{L})(?:купили|пользуемся|пользуюсь)(?!\\p{L})"


def review_text(raw: Column, least: int = REVIEW_LEAST, most: int = REVIEW_MOST) -> Column:
    """A review cut at the last sentence that fits; empty unless it is a review of `least` to `most` characters."""
    t = F.regexp_replace(squeeze(F.coalesce(raw, F.lit(""))), "(?iu)^отзыв\\s+(?:о|об|на)[\\s:][^.:!?]{0,80}[.:!?]?\\s*", "")
    t = squeeze(F.regexp_replace(t, "\\s+([,.!?;:])", "$1"))
    cut = lambda x: F.when(F.length(x) <= most, x).otherwise(F.regexp_extract(F.left(x, F.lit(most + 1)), "(?s)^(.*[.!?])(?=\\s|$)", 1))
    return let(let(t, cut), lambda x: F.when(F.length(x).between(least, most) & x.rlike(REVIEW_MARKS), x).otherwise(""))


def search_phrase(brand: Column, model: Column, name: Column, suffix: Column) -> Column:
    """What to look a product up by: brand and model, or else its name, and the suffix."""
    filled = lambda c: F.nullif(squeeze(c), F.lit(""))
    plain = filled(F.regexp_replace(F.coalesce(name, F.lit("")), '["«»]', " "))
    return F.when(filled(model).isNotNull(), F.concat_ws(" ", filled(brand), filled(model), filled(suffix))).otherwise(F.concat_ws(" ", plain, filled(suffix)))
