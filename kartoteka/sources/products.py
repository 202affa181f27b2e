"""Product dumps, listings, ledgers, sheets and feeds as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions.text import decode_entities, decode_numeric_entities, squeeze, strip_html, value_fold
from kartoteka.operators.reports import forward_fill
from kartoteka.operators.resolve import first_per, last_wins
from kartoteka.operators.shape import first_filled

#: Names under which dumps hold the same thing, the first filled one counts.
COLUMN_NAMES = {
    "id": ["id", "product_id", "ID"],
    "sku": ["sku", "article", "vendorCode", "articul"],
    "name": ["name", "title", "product_name"],
    "description": ["description", "description_html", "desc"],
    "annotation": ["annotation", "annotation_html", "short_description"],
}
#: Members of a dump's object that may hold the rows.
WRAPPERS = ("items", "products", "data")
LEDGER = "original struct<sku: string, name: string>, enriched string, skipped string, error string, _meta struct<model: string, input_tokens: long, output_tokens: long, cost_usd: double, source_url: string>"


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """A dump, an array of products or an object that holds one, as id, sku, name, description, annotation."""
    raw = spark.read.json(path, multiLine=True)
    wrapped = next((w for w in WRAPPERS if w in raw.columns), None)
    if wrapped:
        raw = raw.select(F.explode(wrapped).alias("p")).select("p.*")
    return product_columns(raw)


def product_columns(raw: DataFrame) -> DataFrame:
    return raw.select(*[first_filled(raw, names).alias(c) for c, names in COLUMN_NAMES.items()])


def repeated_ids(products: DataFrame) -> DataFrame:
    """(id, cnt) of ids that more than one row has; a dump with any is rejected."""
    return products.groupBy("id").agg(F.count("*").alias("cnt")).filter("cnt > 1")


def by_any_key(products: DataFrame, order: str) -> DataFrame:
    """(key, row...): products under each of their keys, the first row of a key."""
    keys = F.array_compact(F.array_distinct(F.array("id", "sku")))
    return first_per(products.withColumn("key", F.explode(keys)), ["key"], [order])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of runs; broken lines are dropped, the last line of a sku wins, lines without one all stay.

    Lines count in file order within a file, files in order of their names.
    """
    lines = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path)
    rows = lines.select(F.col("original.sku").alias("sku"), F.col("original.name").alias("name"), "enriched", "skipped", "error", "_meta", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return last_wins(rows, "sku", ["file", "line"])


def listing_items(pages: DataFrame, html: str = "html", origin: str = "") -> DataFrame:
    """(page columns, category_id, page_count, place, sku, name, product_url, image, price, available, brand, brand_slug) of listing pages.

    Each schema.org product with a basket button (data-sku) is an item; crumbs
    and other product marks have none. Links without a host get `origin`.
    """
    first = lambda c, pattern: F.nullif(squeeze(decode_numeric_entities(decode_entities(F.regexp_extract(c, f"(?is){pattern}", 1)))), F.lit(""))
    held = lambda name, attribute: F.coalesce(first("block", f"itemprop=[\"']{name}[\"'][^>]*\\s{attribute}=[\"']([^\"']*)"), first("block", f"\\s{attribute}=[\"']([^\"']*)[\"'][^>]*itemprop=[\"']{name}[\"']"))
    whole = lambda url: F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(origin), url))
    parts = F.split(html, "(?i)itemtype=[\"']https?://schema\\.org/Product[\"']")
    blocks = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    numbers = F.transform(F.regexp_extract_all(html, F.lit("[?&]page=(\\d+)"), F.lit(1)), lambda n: n.cast("int"))
    kept = [c for c in pages.columns if c != html]
    about = [first(html, "data-category=[\"'](\\d+)").cast("int").alias("category_id"), F.greatest(F.lit(1), F.coalesce(F.array_max(numbers), F.lit(1))).alias("page_count")]
    rows = pages.select(*kept, *about, F.posexplode(blocks).alias("place", "block"))
    shown = F.nullif(strip_html(F.regexp_extract("block", "(?is)itemprop=[\"']name[\"'][^>]*>([^<]*)<", 1)), F.lit(""))
    slug = first("block", "/kupit/brand-([a-z0-9_-]+)")
    items = rows.select(
        *kept, "category_id", "page_count", "place", first("block", "data-sku=[\"'](\\d+)").alias("sku"), F.coalesce(shown, held("name", "content")).alias("name"),
        whole(held("url", "href")).alias("product_url"), whole(held("image", "src")).alias("image"), F.regexp_replace(held("price", "content"), "[^0-9.,]", "").try_cast("double").alias("price"),
        F.col("block").rlike("(?i)schema\\.org/InStock").alias("available"), F.coalesce(first("block", "class=[\"']mr-brand[\"'][^>]*>([^<]+)<"), held("brand", "content"), slug).alias("brand"), slug.alias("brand_slug"),
    )
    return items.filter("sku is not null")


def product_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page columns, description, attributes, annotation, brand) of shop pages with a section of two-column characteristics."""
    kept = [c for c in pages.columns if c != html]
    section = F.regexp_extract(html, "(?is)Характеристики</h3>(.*?)</section>", 1)
    rows = F.slice(F.split(section, "(?i)<div class=[\"']row"), 2, 100_000_000)
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<div class=[\"']col-sm-[57][^\"']*[\"'][^>]*>(.*?)</div>"), F.lit(1)), strip_html)
    pair = F.transform(F.transform(rows, cells), lambda c: F.struct(F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).alias("value")))
    attributes = F.filter(pair, lambda p: (p["name"] != "") & (p["value"] != ""))
    description = strip_html(F.regexp_extract(html, "(?is)itemprop=[\"']description[\"'][^>]*>(.*?)</div>", 1))
    brand = F.nullif(F.regexp_extract(html, "(?is)itemprop=[\"']brand[\"'][^>]*content=[\"']([^\"']*)", 1), F.lit(""))
    out = pages.select(*kept, description.alias("description"), attributes.alias("attributes"), brand.alias("brand"))
    return out.withColumn("annotation", F.array_join(F.transform("attributes", lambda p: F.concat_ws(" - ", p["name"], p["value"])), "<br>"))


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """An approval sheet with merged category cells: each row has the category last named before it.

    A sheet is one small file, filled in by hand; its order is that of its lines, so it is read as one.
    """
    rows = spark.read.csv(path, header=True).coalesce(1).withColumn("_line", F.monotonically_increasing_id())
    return forward_fill(rows, "category", "_line", []).drop("_line")


#: Feed parameters that say nothing about the product, and the one that holds a synonym.
SERVICE_PARAMS = ("хит", "комплект", "часть комплекта", "code", "codeclean", "vendorcodeclean", "наличие", "totalqty")
SYNONYM_PARAM, MOST_SYNONYMS = "синоним", 12
OFFER = "_id string, vendor string, vendorCode string, name string, description string, url string, picture array<string>, categoryId string, param array<struct<_name: string, _VALUE: string>>"
CATEGORY = "_id string, _parentId string, _VALUE string"


def read_offers(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Offers of an XML feed: id, brand, sku, name, description, category_id, url, image, params, synonyms; splits are Spark's.

    Service parameters and bare true or false are no facts. known: ids (id) to leave out.
    """
    raw = spark.read.format("xml").option("rowTag", "offer").schema(OFFER).load(path)
    named = F.transform(F.coalesce("param", F.array().cast("array<struct<_name: string, _VALUE: string>>")), lambda p: F.struct(squeeze(p["_name"]).alias("name"), squeeze(p["_VALUE"]).alias("value")))
    filled = F.filter(named, lambda p: (F.coalesce(p["name"], F.lit("")) != "") & (F.coalesce(p["value"], F.lit("")) != ""))
    told = F.filter(filled, lambda p: ~F.lower(p["name"]).isin(*SERVICE_PARAMS, SYNONYM_PARAM) & ~F.lower(p["value"]).isin("true", "false"))
    same = F.transform(F.filter(filled, lambda p: F.lower(p["name"]) == SYNONYM_PARAM), lambda p: p["value"])
    offers = raw.select(
        F.col("_id").alias("id"), F.col("vendor").alias("brand"), F.col("vendorCode").alias("sku"), "name", "description", F.col("categoryId").alias("category_id"), "url", F.get("picture", F.lit(0)).alias("image"),
        told.alias("params"), F.slice(F.array_distinct(same), 1, MOST_SYNONYMS).alias("synonyms"),
    )
    return offers if known is None else offers.join(known.select("id").distinct(), "id", "left_anti")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "category").schema(CATEGORY).load(path)
    return raw.select(F.col("_id").alias("id"), F.col("_parentId").alias("parent"), squeeze(F.col("_VALUE")).alias("name"))


def page(df: DataFrame, order: list[str], offset: int, limit: int, most: int = 200) -> DataFrame:
    """A window of rows in order, of 1 to `most` rows; an offset below zero is an error."""
    if offset < 0:
        raise ValueError(f"offset {offset} is below zero")
    return df.orderBy(*order).offset(offset).limit(min(max(1, limit), most))


def preview(products: DataFrame, phrase: str = "", offset: int = 0, limit: int = 40) -> DataFrame:
    """(id, name, annotation_chars): a page of the products whose id or name holds the phrase."""
    needle = phrase.strip().lower()
    found = products.filter(F.contains(F.col("id").cast("string"), F.lit(needle)) | F.contains(F.lower("name"), F.lit(needle))) if needle else products
    return page(found.select("id", "name", F.length(F.coalesce("annotation", F.lit(""))).alias("annotation_chars")), ["id"], offset, limit)


def dump_summary(products: DataFrame) -> DataFrame:
    """One row: products, and those with and without an annotation."""
    filled = squeeze(F.coalesce("annotation", F.lit(""))) != ""
    return products.agg(F.count("*").alias("products"), F.count_if(filled).alias("with_annotation"), F.count_if(~filled).alias("empty_annotation"))


def find_in_dump(wanted: DataFrame, dump: DataFrame, key: str) -> DataFrame:
    """wanted (key) with the dump's row under any of its keys; rows without one keep nulls."""
    keyed = by_any_key(dump, "id").withColumnRenamed("key", "_key")
    return wanted.join(keyed, F.col(key).cast("string") == F.col("_key"), "left").drop("_key")


def category_of_file(path: Column) -> Column:
    """The category number in a file's name: after products_, filters_ or data_, or at its end."""
    named = F.regexp_extract(path, "(?i)(?:products|filters|data)(?:_v2)?_(\\d+)", 1)
    last = F.regexp_extract(path, "(?:^|\\D)(\\d{3,5})(?:\\.[^./]+)?$", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(last, F.lit("")))


def filter_lists(payloads: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, name, values) of uploaded facets: an array of {name, value or values}, or an object of name: values, or either under `filters`."""
    text = F.col(json_col)
    inner = F.coalesce(F.get_json_object(text, "$.filters"), F.get_json_object(text, "$.facets"), F.get_json_object(text, "$.items"), text)
    item = "array<struct<name:string,label:string,code:string,value:string,values:string>>"
    listed = F.from_json(F.when(inner.rlike("^\\s*\\["), inner), item)
    mapped = F.from_json(F.when(inner.rlike("^\\s*\\{"), inner), "map<string,string>")
    one = lambda v: F.when(v.rlike("^\\s*\\["), F.from_json(v, "array<string>")).otherwise(F.array(v))
    shape = lambda n, v: F.struct(F.trim(n).alias("name"), F.filter(F.transform(one(v), lambda x: F.coalesce(F.get_json_object(x, "$.value"), F.get_json_object(x, "$.label"), x)), lambda x: F.coalesce(x, F.lit("")) != "").alias("values"))
    from_list = F.transform(listed, lambda f: shape(F.coalesce(f["name"], f["label"], f["code"]), F.coalesce(f["value"], f["values"])))
    from_map = F.transform(F.map_entries(mapped), lambda e: shape(e["key"], e["value"]))
    facets = F.coalesce(from_list, from_map)
    return payloads.select(F.col(id_col).alias("id"), F.explode(facets).alias("f")).select("id", "f.name", "f.values").filter("coalesce(name, '') <> ''")


def guess_category(names: DataFrame, dictionaries: DataFrame, least: float = 3.0) -> DataFrame:
    """(id, category, score): for each upload the dictionary whose facet names fit best, from a score on.

    names: id, name. dictionaries: category, name, enabled; a facet that is on scores 1, one that is off 0.4.
    """
    asked = names.select("id", value_fold(F.col("name")).alias("folded")).distinct()
    known = dictionaries.select("category", value_fold(F.col("name")).alias("folded"), F.when(F.col("enabled"), 1.0).otherwise(0.4).alias("points")).groupBy("category", "folded").agg(F.max("points").alias("points"))
    scores = asked.join(known, "folded").groupBy("id", "category").agg(F.round(F.sum("points"), 6).alias("score")).filter(F.col("score") >= least)
    return scores.groupBy("id").agg(F.max_by(F.struct("category", "score"), F.struct("score", (-F.col("category")).alias("c"))).alias("b")).select("id", "b.category", "b.score")


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, the first of each key."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def detect_shape(products: DataFrame, rows: int = 40) -> DataFrame:
    """One row (shape): customer, v2 or catalog, by the columns that the first rows fill."""
    vote = lambda *names: F.sum(sum([F.col(n).isNotNull().cast("int") for n in names if n in products.columns], F.lit(0)))
    votes = products.limit(rows).agg(vote("meta_keywords", "description_html", "annotation_html").alias("customer"), vote("specs", "bullets", "h1").alias("v2"), vote("sku", "price", "brand").alias("catalog"))
    best = F.greatest("customer", "v2", "catalog")
    return votes.select(F.when(best == 0, None).when(F.col("customer") == best, "customer").when(F.col("v2") == best, "v2").otherwise("catalog").alias("shape"))
