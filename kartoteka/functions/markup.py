"""Stack automata over texts, as folds over their tokens: markup that is closed in order, JSON that was cut off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions.text import let

#: Tags that a description may hold.
DESCRIPTION_TAGS = ("p", "ul", "li", "strong")
_TAG = "</?[a-zA-Z][a-zA-Z0-9]*\\b[^>]*>"
#: A whole string of JSON, one that is not closed, or a bracket outside strings.
_JSON_TOKEN = '(?s)"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"|"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+\\\\?$|[{}\\[\\]]'
_ERRORS = "array<struct<kind:string,detail:string>>"


def _error(kind: str, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))


def markup_errors(html: Column, allowed: tuple[str, ...] = DESCRIPTION_TAGS) -> Column:
    """array<struct<kind, detail>>: entities, tags not allowed, tags closed out of order or never, and angle brackets without a partner.

    Tags are read in order with a stack of the open ones; a closing tag takes
    the last one off, whatever it is.
    """
    text = F.coalesce(html, F.lit(""))
    state = "struct<open:array<string>,errors:" + _ERRORS + ">"
    entities = F.transform(F.regexp_extract_all(text, F.lit("&[a-zA-Z#][a-zA-Z0-9]*;"), F.lit(0)), lambda e: _error("html_entity", e))
    tag = lambda t: F.lower(F.regexp_extract(t, "^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TAG), F.lit(0)), lambda t: F.struct(tag(t).alias("tag"), F.startswith(t, F.lit("</")).alias("closes"), t.rlike("/>$").alias("single")))
    with_error = lambda s, kind, detail: F.concat(s["errors"], F.array(_error(kind, detail)))
    to = lambda open_, errors: F.struct(open_.alias("open"), errors.alias("errors")).cast(state)

    def step(s: Column, t: Column) -> Column:
        top = F.get(s["open"], F.size(s["open"]) - 1)
        less = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        closed = to(less, F.when(top.eqNullSafe(t["tag"]), s["errors"]).otherwise(with_error(s, "tag_not_closed", t["tag"])))
        return F.when(~t["tag"].isin(*allowed), to(s["open"], with_error(s, "tag_not_allowed", t["tag"]))).when(t["single"], s).when(t["closes"], closed).otherwise(to(F.array_append(s["open"], t["tag"]), s["errors"]))

    read = F.aggregate(tokens, to(F.array().cast("array<string>"), F.array().cast(_ERRORS)), step)
    opens, closes = F.regexp_count(text, F.lit("<")), F.regexp_count(text, F.lit(">"))
    brackets = F.when(opens != closes, F.array(_error("angle_bracket_unbalanced", F.concat_ws("/", opens.cast("string"), closes.cast("string"))))).otherwise(F.array().cast(_ERRORS))
    return let(read, lambda r: F.concat(entities, r["errors"], F.transform(r["open"], lambda t: _error("tag_not_closed", t)), brackets))


def completed_json(text: Column) -> Column:
    """A JSON text, its fences taken off; where it was cut off, its last string and its open brackets are closed. Null for nothing."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)^\\s*```(?:json)?\\s*", ""), "\\s*```\\s*$", "")

    def complete(t: Column) -> Column:
        tokens = F.regexp_extract_all(t, F.lit(_JSON_TOKEN), F.lit(0))
        pair = lambda b: F.translate(b, "{[", "}]")
        step = lambda open_, k: F.when(k.isin("{", "["), F.array_append(open_, pair(k))).when(k.isin("}", "]") & (F.get(open_, F.size(open_) - 1) == k), F.slice(open_, F.lit(1), F.size(open_) - 1)).otherwise(open_)
        opened = F.aggregate(tokens, F.array().cast("array<string>"), step)
        last = F.coalesce(F.element_at(F.when(F.size(tokens) > 0, tokens), -1), F.lit(""))
        unclosed = F.startswith(last, F.lit('"')) & ~last.rlike('(?s)^"[^"\\\\]*+(?:\\\\.[^"\\\\]*+)*+"$')
        ended = F.regexp_replace(F.concat(t, F.when(unclosed, F.lit('"')).otherwise(F.lit(""))), ",\\s*$", "")
        return F.when(F.try_parse_json(t).isNotNull(), t).otherwise(F.concat(ended, F.array_join(F.reverse(opened), "")))

    return let(F.nullif(F.trim(bare), F.lit("")), complete)


def answered_json(text: Column) -> Column:
    """variant: a model's answer, completed if it was cut off, the first of an array; null where nothing parses."""
    return let(F.try_parse_json(completed_json(text)), lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.try_variant_get(v, "$[0]", "variant")).otherwise(v))
