"""Search results and product pages: links, redirects, host rules, structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartoteka.functions.display import without_legal_tail
from kartoteka.functions.text import canonical_url, is_heading_line, let, squeeze, strip_html, url_host
from kartoteka.operators.resolve import first_per

#: Hosts of search engines and networks, whose pages are no sources.
NOT_SOURCES = ("google", "yandex", "bing", "duckduckgo", "youtube", "vk", "facebook", "instagram", "pinterest", "wikipedia")
PRIVATE_HOST = "^(?:localhost|10\\.|127\\.|169\\.254\\.|192\\.168\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.)"


def unwrap_redirect(url: Column) -> Column:
    """The target of a result link that passes through the engine."""
    inner = F.regexp_extract(url, "[?&](?:uddg|url|q|u)=(https?(?:%3A|:)[^&]*)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(F.regexp_replace(url, "^//", "https://"))


def page_links(pages: DataFrame, html: str) -> DataFrame:
    """(page columns, place, url, title): links of pages in order."""
    kept = [c for c in pages.columns if c != html]
    link = "(?is)<a\\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>"
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("url"), F.regexp_extract_all(html, F.lit(link), F.lit(2)).alias("title"))
    return pages.select(*kept, F.posexplode(zipped).alias("place", "l")).select(*kept, "place", F.col("l.url").alias("url"), strip_html(F.col("l.title")).alias("title"))


def accepted_sources(links: DataFrame, query: str, own_hosts: tuple[str, ...] = ()) -> DataFrame:
    """links that may be sources: http(s), no engine, own or private host, not a root page, the first of each host and query."""
    url = canonical_url(unwrap_redirect(F.col("url")))
    rows = links.withColumn("url", url).withColumn("host", url_host(F.col("url")))
    barred = F.col("host").rlike("(?:^|\\.)(?:" + "|".join(NOT_SOURCES) + ")\\.[a-z.]+$") | F.col("host").rlike(PRIVATE_HOST) | F.col("host").isin(*own_hosts)
    kept = rows.filter(F.col("url").rlike("^https?://[^/]+/.+") & (F.col("host") != "") & ~F.coalesce(barred, F.lit(False)))
    return first_per(kept, [query, "host"], ["place"])


#: A search engine's answer: an error, or groups of found documents. An error of this code means that nothing was found.
ANSWER = "struct<error:struct<_code:string,_VALUE:string>,results:struct<grouping:struct<group:array<struct<doc:array<struct<url:string>>>>>>>"
NOTHING_FOUND = "15"


def search_answer(text: Column) -> Column:
    """struct<error, said, urls> of a search engine's XML, as it is, in base64, or in a JSON envelope; urls in the order of the answer.

    error is the code of a refusal, said its text; an answer that found nothing
    has no error and no urls, nor has a text that is no answer.
    """
    raw = lambda t: F.coalesce(F.get_json_object(t, "$.rawData"), F.get_json_object(t, "$.response.rawData"), t)
    plain = lambda t: F.when(F.trim(t).rlike("^[A-Za-z0-9+/\\s]+=*$"), F.try_to_binary(F.regexp_replace(t, "\\s", ""), F.lit("base64")).cast("string")).otherwise(t)
    body = F.regexp_extract(let(raw(F.coalesce(text, F.lit(""))), plain), "(?s)<response\\b.*</response>", 0)
    # titles and passages hold markup of their own, which no field asks for
    read = F.from_xml(F.when(body != "", F.regexp_replace(body, "(?s)<(title|passages|headline)\\b.*?</\\1>", "")), ANSWER)
    urls = F.transform(F.flatten(F.transform(read["results"]["grouping"]["group"], lambda g: F.coalesce(g["doc"], F.array().cast("array<struct<url:string>>")))), lambda d: F.trim(d["url"]))
    refused = (read["error"]["_code"] != NOTHING_FOUND)
    return F.struct(F.when(refused, read["error"]["_code"]).alias("error"), F.when(refused, F.trim(read["error"]["_VALUE"])).alias("said"), F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull() & (u != "")).alias("urls"))


def ld_blocks(html: Column) -> Column:
    """array<variant>: JSON-LD blocks that parse, without comments or CDATA around them and commas before a closing bracket."""
    block = "(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"
    bare = lambda t: F.trim(F.regexp_replace(t, "(?s)^\\s*(?://)?\\s*(?:<!\\[CDATA\\[|<!--)|(?://)?\\s*(?:\\]\\]>|-->)\\s*$", ""))
    parsed = lambda t: F.coalesce(F.try_parse_json(t), F.try_parse_json(F.regexp_replace(t, ",\\s*([}\\]])", "$1")))
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(block), F.lit(1))
    return F.filter(F.transform(found, lambda t: let(bare(t), parsed)), lambda v: v.isNotNull())


def structured_data(pages: DataFrame, html: str) -> DataFrame:
    """(page columns, data variant): JSON-LD blocks that parse, without comments or CDATA around them and commas before a closing bracket."""
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.explode(ld_blocks(F.col(html))).alias("data"))


#: How deep arrays and graphs may be nested.
DEEPEST = 8
#: Fields of an object and what they are called.
LD_FIELDS = (("color", "Цвет"), ("width", "Ширина"), ("height", "Высота"), ("depth", "Глубина"), ("weight", "Вес"), ("material", "Материал"))
_PAIRS = "array<struct<key:string,value:string,via:string>>"


def _at(data: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(data, path, kind)


def _is(data: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(data), F.lit(kind)), F.lit(False))


def ld_nodes(data: Column) -> Column:
    """array<variant>: the objects of structured data, those inside arrays and @graph too, level by level."""
    none = F.array().cast("array<variant>")
    inside = lambda n: F.when(_is(n, "ARRAY"), _at(n, "$", "array<variant>")).when(_is(n, "OBJECT") & _at(n, "$['@graph']").isNotNull(), F.array(_at(n, "$['@graph']"))).otherwise(none)
    objects = lambda ns: F.filter(ns, lambda n: _is(n, "OBJECT"))
    state = lambda level, found: F.struct(level.alias("level"), found.alias("found"))
    step = lambda s, _: let(F.flatten(F.transform(s["level"], inside)), lambda below: state(below, F.concat(s["found"], objects(below))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(DEEPEST)), state(F.array(data), objects(F.array(data))), step)["found"]


def ld_scalar(data: Column) -> Column:
    """A value as text: a scalar, the first of an array, or an object's value with its unit; null for anything else."""
    plain = lambda v: F.when(~_is(v, "OBJECT") & ~_is(v, "ARRAY"), F.nullif(F.trim(_at(v, "$", "string")), F.lit("")))
    unit = lambda v: F.coalesce(plain(_at(v, "$.unitText")), plain(_at(v, "$.unitCode")))
    one = lambda v: F.when(_is(v, "OBJECT"), F.when(plain(_at(v, "$.value")).isNotNull(), F.concat_ws(" ", plain(_at(v, "$.value")), unit(v)))).otherwise(plain(v))
    return let(F.when(_is(data, "ARRAY"), _at(data, "$[0]")).otherwise(data), one)


def ld_pairs(data: Column) -> Column:
    """array<struct<key, value, via>> of structured data: additional properties, then the fields with a name of their own, then the brand."""
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"), F.lit("jsonld").alias("via"))

    def own(node: Column) -> Column:
        props = F.coalesce(_at(node, "$.additionalProperty"), _at(node, "$.additionalProperties"))
        listed = let(props, lambda p: F.when(_is(p, "ARRAY"), _at(p, "$", "array<variant>")).when(p.isNotNull(), F.array(p)).otherwise(F.array().cast("array<variant>")))
        told = F.transform(listed, lambda p: pair(F.coalesce(_at(p, "$.name", "string"), _at(p, "$.propertyID", "string")), ld_scalar(_at(p, "$.value"))))
        fields = F.array(*[pair(F.lit(label), ld_scalar(_at(node, f"$.{name}"))) for name, label in LD_FIELDS])
        brand = let(_at(node, "$.brand"), lambda b: F.when(_is(b, "OBJECT"), ld_scalar(_at(b, "$.name"))).otherwise(ld_scalar(b)))
        return F.concat(told, fields, F.array(pair(F.lit("Бренд"), brand)))

    return F.filter(F.flatten(F.transform(ld_nodes(data), own)), lambda p: p["key"].isNotNull() & p["value"].isNotNull())


#: Units that stand in a cell of their own.
UNIT_CELL = "(?iu)^(?:кг|г|см|мм|м|л|мл|дба|дб|шт|%|об/?\\s*мин|квт·ч/год)$"


def cells_pair(cells: Column) -> Column:
    """struct<key, value> of a table's row: of its first two filled cells, with a unit in a last cell, without an icon in the first; null for fewer."""
    def read(c: Column) -> Column:
        cell = lambda i: F.get(c, F.lit(i))
        last = F.element_at(c, -1)
        pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
        icon = (F.length(cell(0)) <= 2) & ~cell(0).rlike("(?iu)[а-яёa-z]")
        more = F.when(last.rlike(UNIT_CELL), pair(cell(0), F.concat_ws(" ", cell(1), last))).when(icon, pair(cell(1), cell(2))).otherwise(pair(cell(0), cell(1)))
        return F.when(F.size(c) == 2, pair(cell(0), cell(1))).when(F.size(c) > 2, more)

    return let(F.filter(F.transform(cells, squeeze), lambda x: ~x.isin("", "-", "–")), read)


#: Markup of a key and its value beside each other: named blocks, columns, two spans of a list item, properties.
_BESIDE = (
    ("dl", "(?is)<dt[^>]*>(.*?)</dt>\\s*<dd[^>]*>(.*?)</dd>"),
    ("block", "(?is)<(?:div|span)[^>]*class=[\"'](?:[^\"']*[\\s_-])?(?:name|label|key)(?:[\\s_-][^\"']*)?[\"'][^>]*>([^<]*)</(?:div|span)>\\s*<(?:div|span)[^>]*class=[\"'](?:[^\"']*[\\s_-])?(?:value|val)(?:[\\s_-][^\"']*)?[\"'][^>]*>([^<]*)</(?:div|span)>"),
    ("column", "(?is)<div[^>]*class=[\"'][^\"']*col-[^\"']*[\"'][^>]*>([^<]*)</div>\\s*<div[^>]*class=[\"'][^\"']*col-[^\"']*[\"'][^>]*>([^<]*)</div>"),
    ("item", "(?is)<li[^>]*>\\s*<span[^>]*>([^<]*)</span>\\s*<span[^>]*>([^<]*)</span>\\s*</li>"),
    ("itemprop", "(?is)itemprop=[\"']name[\"'][^>]*>([^<]*)<[^>]*>\\s*<[^>]*itemprop=[\"']value[\"'][^>]*>([^<]*)<"),
)
#: Longest key and value of a page.
LONGEST_KEY, LONGEST_VALUE = 80, 240


def _named(both: Column, via: str, pair) -> Column:
    return F.transform(both, lambda p: pair(strip_html(p["k"]), strip_html(p["v"]), via))


def page_pairs(pages: DataFrame, html: str) -> DataFrame:
    """(page columns, place, key, value, via): facts in a page's structured data, tables and marked-up pairs; the first of keys equal but for case.

    Headings, links, and keys or values longer than such ever are give none.
    """
    kept = [c for c in pages.columns if c != html]
    body = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), "(?is)<(script|style|noscript|svg|template)\\b.*?</\\1>", " ")
    rows = pages.select(*kept, ld_blocks(F.col(html)).alias("_data"), body.alias("_body"))
    pair = lambda k, v, via: F.struct(squeeze(k).alias("key"), without_legal_tail(squeeze(v)).alias("value"), F.lit(via).alias("via"))
    found = [F.transform(F.flatten(F.transform("_data", ld_pairs)), lambda p: pair(p["key"], p["value"], "jsonld"))]
    table = F.transform(F.regexp_extract_all("_body", F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: cells_pair(F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_html)))
    found.append(F.transform(F.filter(table, lambda p: p.isNotNull()), lambda p: pair(p["key"], p["value"], "table")))
    for via, pattern in _BESIDE:
        both = F.arrays_zip(F.regexp_extract_all("_body", F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all("_body", F.lit(pattern), F.lit(2)).alias("v"))
        found.append(_named(both, via, pair))
    sound = lambda p: (p["key"] != "") & (p["value"] != "") & (p["key"] != p["value"]) & (F.length(p["key"]) <= LONGEST_KEY) & (F.length(p["value"]) <= LONGEST_VALUE) & ~p["value"].rlike("(?i)^https?:") & ~is_heading_line(p["key"])
    rows = rows.select(*kept, F.filter(F.concat(*found), sound).alias("_pairs"))
    rows = rows.withColumn("_keys", F.transform("_pairs", lambda p: F.lower(p["key"])))
    first = F.filter("_pairs", lambda p, i: F.array_position("_keys", F.lower(p["key"])) == i + 1)
    return rows.select(*kept, F.posexplode_outer(first).alias("place", "p")).filter("p is not null").select(*kept, "place", "p.*")


def product_data(pages: DataFrame, html: str) -> DataFrame:
    """(page columns, name, sku, brand, price) of JSON-LD products."""
    kept = [c for c in pages.columns if c != html]
    get = lambda path: F.try_variant_get("data", path, "string")
    rows = structured_data(pages, html).filter(F.try_variant_get("data", "$['@type']", "string") == "Product")
    return rows.select(*kept, get("$.name").alias("name"), get("$.sku").alias("sku"), F.coalesce(get("$.brand.name"), get("$.brand")).alias("brand"), get("$.offers.price").try_cast("double").alias("price"))
