"""Steps and bucket labels of numeric facets as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kartoteka.functions.text import number_label

#: Steps that read well, and how many buckets a range should have about.
NICE_STEPS, BUCKETS_WANTED, NICE_TOLERANCE = (1.0, 2.0, 2.5, 5.0, 10.0), 8, 1.000001
BUCKET_TYPE = "array<struct<label:string,min:double,max:double>>"


def magnitude(c: Column) -> Column:
    """The power of ten at or below a positive number."""
    return F.pow(F.lit(10.0), F.floor(F.log10(c)))


def nice_step(span: Column) -> Column:
    """A round step that cuts the span into about eight; 1 for an empty span."""
    rough = span / BUCKETS_WANTED
    out = F.when(F.coalesce(span, F.lit(0.0)) <= 0, 1.0)
    for n in NICE_STEPS:
        out = out.when(rough <= n * magnitude(rough) * NICE_TOLERANCE, n * magnitude(rough))
    return out.otherwise(10 * magnitude(rough))


def price_step(span: Column) -> Column:
    """About a hundredth of the span, one leading digit, 10 at least; null for an empty span."""
    rough = span / 100
    return F.when(span > 0, F.greatest(F.lit(10.0), F.floor(rough / magnitude(rough) + 0.5) * magnitude(rough)))


def step_label(value: Column, step: Column, origin: Column | float = 0.0) -> Column:
    """"lo-hi" of the step that holds the value."""
    start = F.lit(origin) if isinstance(origin, (int, float)) else origin
    low = F.floor((value - start) / step) * step + start
    return F.concat(number_label(low), F.lit("-"), number_label(low + step))


def buckets_from_breaks(breaks: Column, open_last: Column) -> Column:
    """Neighbouring breaks as buckets, with an open one after the last if asked for."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(breaks) - 1), lambda i: F.struct(F.get(breaks, i - 1).alias("min"), F.get(breaks, i).alias("max")))
    closed = F.transform(pairs, lambda p: F.struct(F.concat(number_label(p["min"]), F.lit("-"), number_label(p["max"])).alias("label"), p["min"].alias("min"), p["max"].alias("max")))
    last = F.get(breaks, F.size(breaks) - 1)
    more = F.array(F.struct(F.concat(number_label(last), F.lit("+")).alias("label"), last.alias("min"), F.lit(float("inf")).alias("max")))
    return F.when(F.coalesce(open_last, F.lit(False)), F.concat(closed, more)).otherwise(closed)


def match_bucket(value: Column, buckets: Column, right_closed: Column | bool = False) -> Column:
    """Label of the bucket that holds the value, the one that starts highest where they overlap.

    Buckets hold their lower end, or the upper one if right_closed; a null end is open.
    """
    rule = F.lit(right_closed) if isinstance(right_closed, bool) else right_closed
    low = lambda b: F.coalesce(b["min"], F.lit(float("-inf")))
    high = lambda b: F.coalesce(b["max"], F.lit(float("inf")))
    inside = F.filter(buckets, lambda b: F.when(rule, (value > low(b)) & (value <= high(b))).otherwise((value >= low(b)) & (value < high(b))))
    return F.array_max(F.transform(inside, lambda b: F.struct(low(b).alias("min"), b["label"].alias("label"))))["label"]


def snap_bucket(value: Column, buckets: Column, open_last: Column | bool = False) -> Column:
    """match_bucket, but values beyond an open last bucket fall into it; below the first one there is none."""
    rule = F.lit(open_last) if isinstance(open_last, bool) else open_last
    last = F.get(buckets, F.size(buckets) - 1)
    return F.coalesce(match_bucket(value, buckets), F.when(rule & (value >= last["min"]), last["label"]))


def int_enum(value: Column, allowed: Column, rounding: str = "ceil") -> Column:
    """The value as a whole number label; null unless it is one of the allowed (all, if there are none)."""
    whole = {"ceil": F.ceil(value), "floor": F.floor(value), "nearest": F.floor(value + 0.5)}[rounding].cast("int")
    return F.when((F.size(allowed) <= 0) | F.array_contains(allowed, whole), whole.cast("string"))


def snap_int_enum(value: Column, allowed: Column, rounding: str = "ceil") -> Column:
    """int_enum, or else the nearest allowed number (the lesser of two as near)."""
    ranked = F.transform(allowed, lambda x: F.struct(F.abs(x - value).alias("d"), x.alias("x")))
    return F.coalesce(int_enum(value, allowed, rounding), F.array_min(ranked)["x"].cast("string"))


def bucket_range(label: Column) -> Column:
    """struct<lo, hi> of a label "a-b", "a+" or "до b"; null for other texts. Both ends count as inside."""
    n = "(\\d+(?:\\.\\d+)?)"
    part = lambda p: F.regexp_extract(label, p, 1).try_cast("double")
    pair, more, less = f"^{n}\\s*-\\s*{n}$", f"^{n}\\+$", f"(?iu)^до\\s+{n}$"
    both = F.struct(part(pair).alias("lo"), F.regexp_extract(label, pair, 2).try_cast("double").alias("hi"))
    inf = float("inf")
    return F.when(label.rlike(pair), both).when(label.rlike(more), F.struct(part(more).alias("lo"), F.lit(inf).alias("hi"))).when(label.rlike(less), F.struct(F.lit(-inf).alias("lo"), part(less).alias("hi")))
