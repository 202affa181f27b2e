"""Reports on how full cards and filters are, where facts come from, and what runs cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kartoteka.functions.text import value_fold
from kartoteka.functions.values import bounds_of
from kartoteka.operators.reports import percent

#: A product with so few filters is reported, and so many of the required ones it must have at least.
FEW_FILTERS, NEED_REQUIRED = 5, 3


def source_stats(facts: DataFrame) -> DataFrame:
    """One row: facts from annotation, description and outside, and products with any from outside."""
    level = F.col("level")
    return facts.agg(F.count_if(level == "S1").alias("from_annotation"), F.count_if(level == "S2").alias("from_description"), F.count_if(level == "S3").alias("from_external"), F.countDistinct(F.when(level == "S3", F.col("id"))).alias("products_with_external"))


def filter_coverage(products: DataFrame, filters: DataFrame, names: DataFrame, threshold: int = 70) -> DataFrame:
    """(code, filled, eligible, coverage, status): in what share of the products of their own category each filter is filled.

    products: id, mismatch. filters: id, code, label. names: code. Products of
    another category do not count; without any other the divisor is one.
    """
    own = products.filter(~F.coalesce("mismatch", F.lit(False))).select("id")
    filled = filters.filter("label is not null").select("id", "code").distinct().join(own, "id", "left_semi").groupBy("code").agg(F.count("*").alias("filled"))
    joined = names.select("code").join(filled, "code", "left").crossJoin(F.broadcast(own.agg(F.count("*").alias("eligible"))))
    n = F.coalesce("filled", F.lit(0)).cast("long")
    share = F.floor(n * 100 / F.greatest(F.col("eligible"), F.lit(1)) + 0.5)
    return joined.select("code", n.alias("filled"), "eligible", share.alias("coverage"), F.when(share >= threshold, "ok").otherwise("below_threshold").alias("status"))


def filter_report(products: DataFrame, filters: DataFrame, names: DataFrame, threshold: int = 70) -> DataFrame:
    """(section, name, n, share, status): kinds of products, moves between categories, filters by how full they are, and totals, from one pass.

    products: id, kind, mismatch, category, suggested. filters: id, code, label.
    names: code. Products without a kind count as of kind `mismatch` where they
    are one, else as `other`. Filters count in products of their own category
    only; all of `names` are listed. Moves ("from>to") are those of products
    with a suggested category. The last step holds one row a kind, move and
    filter in one task.
    """
    wrong = F.coalesce("mismatch", F.lit(False))
    kind = F.coalesce("kind", F.when(wrong, "mismatch").otherwise("other"))
    none = F.lit(None).cast("string")
    heads = products.select(kind.alias("kind"), F.when(F.col("suggested").isNotNull(), F.concat_ws(">", F.col("category").cast("string"), F.col("suggested").cast("string"))).alias("move"), none.alias("code"), F.lit(1).alias("head"), (~wrong).cast("int").alias("own"))
    held = filters.filter("label is not null").select("id", "code").distinct().join(products.filter(~wrong).select("id"), "id", "left_semi")
    filled = held.select(none.alias("kind"), none.alias("move"), "code", F.lit(0).alias("head"), F.lit(1).alias("own"))
    asked = names.select(none.alias("kind"), none.alias("move"), "code", F.lit(0).alias("head"), F.lit(0).alias("own"))
    sets = [[F.col("kind")], [F.col("move")], [F.col("code")], []]
    rows = heads.unionByName(filled.join(names.select("code").distinct(), "code", "left_semi").select(*asked.columns)).unionByName(asked)
    counted = rows.groupingSets(sets, "kind", "move", "code").agg(F.grouping_id().alias("g"), F.sum("head").alias("heads"), F.sum("own").alias("own"), F.sum(F.col("head") * F.col("own")).alias("eligible"))
    # bits of the grouping: kind 4, move 2, code 1; set where the column is not grouped by
    section = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "move").when(F.col("g") == 6, "filter").otherwise("total")
    name = F.coalesce("kind", "move", "code")
    eligible = F.max(F.when(F.col("g") == 7, F.col("eligible"))).over(Window.partitionBy())
    n = F.when(F.col("g") == 6, F.col("own")).otherwise(F.col("heads"))
    share = F.when(F.col("g") == 6, F.floor(F.col("own") * 100 / F.greatest(F.col("all"), F.lit(1)) + 0.5)).when(F.col("g") == 7, F.col("all"))
    told = counted.withColumn("all", F.coalesce(eligible, F.lit(0))).filter(name.isNotNull() | (F.col("g") == 7))
    return told.select(section.alias("section"), F.coalesce(name, F.lit("products")).alias("name"), F.coalesce(n, F.lit(0)).alias("n"), share.alias("share"), F.when(F.col("g") == 6, F.when(share >= threshold, "ok").otherwise("below_threshold")).alias("status"))


def thin_products(products: DataFrame, filters: DataFrame, required: DataFrame) -> DataFrame:
    """(id, n_filters, n_required, few, missing_required) of the products of their own category that have few filters or lack required ones."""
    own = products.filter(~F.coalesce("mismatch", F.lit(False))).select("id")
    marked = filters.filter("label is not null").select("id", "code").distinct().join(required.select("code").distinct().withColumn("needed", F.lit(True)), "code", "left")
    counts = marked.groupBy("id").agg(F.count("*").alias("f"), F.count_if("needed").alias("r"))
    need = F.least(F.lit(NEED_REQUIRED), F.col("all_required"))
    joined = own.join(counts, "id", "left").crossJoin(F.broadcast(required.select("code").distinct().agg(F.count("*").alias("all_required"))))
    n, r = (F.coalesce(c, F.lit(0)).cast("long") for c in ("f", "r"))
    rows = joined.select("id", n.alias("n_filters"), r.alias("n_required"), (n <= FEW_FILTERS).alias("few"), (r < need).alias("missing_required"))
    return rows.filter(F.col("few") | F.col("missing_required"))


def card_coverage(cards: DataFrame, filters: DataFrame, sheet: DataFrame) -> DataFrame:
    """(id, total, filled, coverage, ok): how many of the sheet's filters each card has; optional ones may be missing.

    sheet: code, optional. The sheet's sizes are one row, so cards meet counts, not every line of the sheet.
    """
    sizes = sheet.agg(F.count("*").alias("total"), F.count_if(~F.col("optional")).alias("needed"))
    held = filters.filter("label is not null").select("id", "code").distinct().join(sheet, "code")
    counts = held.groupBy("id").agg(F.count("*").alias("f"), F.count_if(~F.col("optional")).alias("r"))
    joined = cards.select("id").join(counts, "id", "left").crossJoin(F.broadcast(sizes))
    f, r = (F.coalesce(c, F.lit(0)).cast("long") for c in ("f", "r"))
    return joined.select("id", "total", f.alias("filled"), F.coalesce(F.floor(F.try_divide(f * 100, F.col("total")) + 0.5), F.lit(0)).alias("coverage"), (r == F.col("needed")).alias("ok"))


def severity_counts(issues: DataFrame, by: list[str]) -> DataFrame:
    """by..., problems, errors, checked: issues that are not mere information, and errors among them, for each dictionary or pack."""
    s = F.col("severity")
    return issues.groupBy(*by).agg(F.count_if(s != "info").alias("problems"), F.count_if(s == "error").alias("errors"), F.count("*").alias("checked"))


def pack_summary(cards: DataFrame) -> DataFrame:
    """One row of counters over audited cards (status): how many of each status, and the share that is ok."""
    s = F.col("status")
    counts = cards.agg(F.count("*").alias("total"), *[F.count_if(s == name).alias(name) for name in ("ok", "extra", "missing", "issues")])
    return counts.withColumn("ok_share", percent(F.col("ok"), F.col("total")))


def album_stats(items: DataFrame, by: str) -> DataFrame:
    """(by, items, described, errors, pending, bytes): photos of each album by what has become of them."""
    done, failed = F.col("status").isin("described", "ready"), F.col("status") == "error"
    counts = items.groupBy(by).agg(F.count("*").alias("items"), F.count_if(done).alias("described"), F.count_if(failed).alias("errors"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return counts.withColumn("pending", F.col("items") - F.col("described") - F.col("errors"))


def spent(ledger: DataFrame, photos: DataFrame, by: str, cost: str) -> DataFrame:
    """(by, ledger, photos, spent): what either record says was spent; the greater one counts, since either may miss runs."""
    total = lambda df, name: df.groupBy(by).agg(F.coalesce(F.sum(cost), F.lit(0)).alias(name))
    joined = total(ledger, "ledger").join(total(photos, "photos"), by, "full")
    a, b = F.coalesce("ledger", F.lit(0)), F.coalesce("photos", F.lit(0))
    return joined.select(by, a.alias("ledger"), b.alias("photos"), F.greatest(a, b).alias("spent"))


def cost_forecast(runs: DataFrame, catalog_size: Column) -> DataFrame:
    """One row: cost of a finished product, products of the catalog that will be paid for, and what these will cost.

    runs: status, cost. Skipped products cost nothing and stay as frequent as they were.
    """
    s = F.col("status")
    totals = runs.agg(F.count_if(s == "ok").alias("ok"), F.count_if(s == "skipped").alias("skipped"), F.sum(F.when(s == "ok", F.col("cost"))).alias("cost"))
    billable = F.floor(F.try_divide(catalog_size * F.col("ok"), F.col("ok") + F.col("skipped")) + 0.5)
    each = F.try_divide(F.col("cost"), F.col("ok"))
    return totals.select("ok", "skipped", each.alias("each"), billable.alias("billable"), (each * billable).alias("forecast"))


def key_samples(pairs: DataFrame, most: int, longest_key: int = 80) -> DataFrame:
    """(key, cnt, sample): the most frequent keys of cards, under the spelling met first, with the first value met.

    pairs: id, seq, key, value. Spellings that fold to one are one key.
    """
    usable = pairs.filter(F.length("key").between(2, longest_key)).withColumn("folded", value_fold(F.col("key"))).filter("folded <> ''")
    met = F.struct("id", "seq")
    grouped = usable.groupBy("folded").agg(F.min_by("key", met).alias("key"), F.count("*").alias("cnt"), F.min_by(F.when(F.col("value") != "", F.col("value")), F.when(F.col("value") != "", met)).alias("sample"))
    return grouped.select("key", "cnt", "sample").orderBy(F.col("cnt").desc(), "key").limit(most)


def last_cards(cards: DataFrame, order: str, last: int, flags: dict[str, Column]) -> DataFrame:
    """One row: scanned, one count a flag, and ok: faults among the last cards of a run; a bounded top-k."""
    recent = cards.orderBy(F.col(order).desc()).limit(last)
    counted = recent.agg(F.count("*").alias("scanned"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    total = None
    for n in flags:
        total = F.col(n) if total is None else total + F.col(n)
    return counted.withColumn("ok", total == 0)


def attribution(products: DataFrame, attributes: DataFrame, facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id, code, value, level, status) of every attribute of every product: empty, OK, RESOLVED or CONFLICT (to be reviewed)."""
    open_ = conflicts.groupBy("id", "code").agg(F.bool_or("needs_review").alias("review"))
    grid = products.select("id").crossJoin(attributes.filter("coalesce(tier, '') <> 'X'").select("code"))
    joined = grid.join(facts.select("id", "code", "value", "level"), ["id", "code"], "left").join(open_, ["id", "code"], "left")
    status = F.when(F.col("review"), "CONFLICT").when(~F.col("review"), "RESOLVED").when(F.coalesce("value", F.lit("")) != "", "OK").otherwise("empty")
    return joined.select("id", "code", "value", "level", status.alias("status"))


def attribute_facts(pairs: DataFrame) -> DataFrame:
    """(id, code, value, lo, hi): numeric attributes of a shop as facts, or as bounds where the text gives a range.

    pairs: id, code, text.
    """
    b = bounds_of(F.col("text"))
    return pairs.select("id", "code", b.alias("b")).filter("b is not null").select("id", "code", "b.value", "b.lo", "b.hi")


def unsupported_specs(specs: DataFrame, facts: DataFrame, checked: DataFrame) -> DataFrame:
    """specs (id, code, value) with the value emptied, and `stripped`, where the code is to be checked and no fact (value or bounds) backs it."""
    backed = facts.filter("value is not null or lo is not null or hi is not null").select("id", "code").distinct().withColumn("backed", F.lit(True))
    joined = specs.join(checked.select("code").distinct().withColumn("check", F.lit(True)), "code", "left").join(backed, ["id", "code"], "left")
    strip = F.coalesce(F.col("check"), F.lit(False)) & F.col("backed").isNull() & F.col("value").isNotNull()
    return joined.select("id", "code", F.when(~strip, F.col("value")).alias("value"), strip.alias("stripped"))


def bucket_faults(filters: DataFrame, told: DataFrame, eps: float = 0.6) -> DataFrame:
    """(id, code, kind, number, label): exact numbers of the annotation outside the filter's bucket, and descriptions that disagree with it.

    filters: id, code, label ("a-b" or "a+", both ends inside). told: id, code, exact (annotation), claimed (description).
    """
    low = F.regexp_extract("label", "^(\\d+(?:\\.\\d+)?)(?:\\s*-|\\+)", 1).try_cast("double")
    high = F.coalesce(F.regexp_extract("label", "-\\s*(\\d+(?:\\.\\d+)?)$", 1).try_cast("double"), F.lit(float("inf")))
    rows = filters.select("id", "code", "label", low.alias("low"), high.alias("high")).join(told, ["id", "code"])
    inside = lambda c: F.col(c).isNull() | F.col("low").isNull() | F.col(c).between(F.col("low"), F.col("high"))
    differ = F.coalesce(F.abs(F.col("claimed") - F.col("exact")) > eps, F.lit(False))
    fault = lambda kind, n: F.struct(F.lit(kind).alias("kind"), F.col(n).alias("number"))
    found = F.array_compact(F.array(F.when(~inside("exact"), fault("bucket", "exact")), F.when(differ | ~inside("claimed"), fault("cross_field", "claimed"))))
    return rows.select("id", "code", "label", F.explode(found).alias("f")).select("id", "code", "f.kind", "f.number", "label")


def first_cards_with_issues(issues: DataFrame, most: int = 40) -> DataFrame:
    """(id, issues): the cards with most issues, at most `most`; a report's bound."""
    return issues.groupBy("id").agg(F.count("*").alias("issues")).orderBy(F.col("issues").desc(), "id").limit(most)


def annotation_faults(rows: DataFrame) -> DataFrame:
    """(id, code, kind, detail): annotation lines said twice, bucketed numbers, and values other than the fact's.

    rows: id, seq, code, label, value, expected.
    """
    again = F.row_number().over(Window.partitionBy("id", F.lower("label")).orderBy("seq")) > 1
    fault = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    found = F.array_compact(
        F.array(
            F.when(F.col("again"), fault("annotation_duplicate", F.col("label"))),
            F.when(F.col("value").rlike("^\\d+(?:\\.\\d+)?-\\d"), fault("annotation_bucketed", F.col("value"))),
            F.when((F.coalesce("expected", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "") & (F.col("expected") != F.col("value")), fault("annotation_mismatch", F.concat_ws(" / ", "value", "expected"))),
        )
    )
    return rows.withColumn("again", again).select("id", "code", F.explode(found).alias("f")).select("id", "code", "f.kind", "f.detail")
