"""Queries that read structure out of texts: glued pairs, nested data, markup; each with SQL that computes the rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartoteka.functions import markup
from kartoteka.operators import parsing
from kartoteka.plans.catalog import _table, query
from kartoteka.sources import web

#: A dictionary of keys; the texts hold further keys that it does not know.
_KEYS = [("Вес", "weight", 1), ("Цвет", "colour", 2), ("Разморозка", "defrost", 3), ("Количество полок", "shelves", 4), ("Габариты без упаковки", "size", 5)]


def _glued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card of each part whose pairs run into each other: at a key of the dictionary, a sentence, an answer, under a heading, and after a phrase without a pair."""
    name, brand, size = F.coalesce("p_name", F.lit("нет")), F.coalesce("p_brand", F.lit("нет")), F.coalesce("p_size", F.lit(0)).cast("string")
    text = (
        F.when(F.length(name) % 5 == 0, F.concat(F.lit("Разморозка - капельная Вес - "), size, F.lit(" кг Цвет - "), name))
        .when(F.length(name) % 5 == 1, F.concat(F.lit("<li>Холодильное отделение: Разморозка: "), name, F.lit(". Количество полок: "), size, F.lit("</li>")))
        .when(F.length(name) % 5 == 2, F.concat(F.lit("Марка: "), brand, F.lit(" Цвет: "), name, F.lit(". Срок службы: "), size, F.lit(" лет")))
        .when(F.length(name) % 5 == 3, F.concat(F.lit("Подставка для яиц. Морозильное отделение: "), name, F.lit(". Вес: "), size, F.lit(" кг")))
        .otherwise(F.concat(F.lit("Дверь - да Габариты без упаковки - "), size, F.lit(" см<br>Основное: Марка - "), brand))
    )
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("annotation"))


_GLUED = """SELECT p_partkey AS id, CASE length(coalesce(p_name, 'нет')) % 5
    WHEN 0 THEN 'Разморозка - капельная Вес - ' || coalesce(p_size, 0) || ' кг Цвет - ' || coalesce(p_name, 'нет')
    WHEN 1 THEN '<li>Холодильное отделение: Разморозка: ' || coalesce(p_name, 'нет') || '. Количество полок: ' || coalesce(p_size, 0) || '</li>'
    WHEN 2 THEN 'Марка: ' || coalesce(p_brand, 'нет') || ' Цвет: ' || coalesce(p_name, 'нет') || '. Срок службы: ' || coalesce(p_size, 0) || ' лет'
    WHEN 3 THEN 'Подставка для яиц. Морозильное отделение: ' || coalesce(p_name, 'нет') || '. Вес: ' || coalesce(p_size, 0) || ' кг'
    ELSE 'Дверь - да Габариты без упаковки - ' || coalesce(p_size, 0) || ' см<br>Основное: Марка - ' || coalesce(p_brand, 'нет') END AS t FROM part"""
_SEP = r"(?:\s+[-–—]\s+|\s*:\s+)"
_DICT = "[" + ", ".join(f"'{k}'" for k, _, _ in _KEYS) + "]"


@query(rf"""
WITH RECURSIVE cards AS ({_GLUED}),
chunks AS (SELECT id, unnest(range(len(c))) AS chunk, unnest(c) AS t FROM (SELECT id, string_split_regex(regexp_replace(t, '</?li>', '', 'g'), '<br>') AS c FROM cards)),
left_ AS (
  SELECT id, chunk, 0 AS step, regexp_replace(t, '^[^:–—]{{2,80}}?\.\s+(\pL[^:]{{1,80}}:\s)', '\1') AS rest FROM chunks
  UNION ALL
  SELECT id, chunk, step + 1, cut.tail FROM (
    SELECT id, chunk, step, list_min(list_filter(
      list_transform({_DICT}, lambda k: {{'n': length(regexp_extract(v, '^(.*?)\s+' || k || '{_SEP}', 1)), 'head': regexp_extract(v, '^(.*?)\s+' || k || '{_SEP}', 1), 'tail': regexp_extract(v, '^.*?\s+(' || k || '{_SEP}.*)$', 1)}})
      || [{{'n': length(regexp_extract(v, '^(.*?)\.\s+\pL[^:]{{1,80}}:\s*\S', 1)), 'head': regexp_extract(v, '^(.*?)\.\s+\pL[^:]{{1,80}}:\s*\S', 1), 'tail': regexp_extract(v, '^.*?\.\s+(\pL[^:]{{1,80}}:\s*\S.*)$', 1)}},
          {{'n': length(regexp_extract(v, '^(да|нет|есть|имеется)\s+\pL[^–—:]{{2,70}}\s+[-–—:]\s*\S', 1)), 'head': regexp_extract(v, '^(да|нет|есть|имеется)\s+\pL[^–—:]{{2,70}}\s+[-–—:]\s*\S', 1), 'tail': regexp_extract(v, '^(?:да|нет|есть|имеется)\s+(\pL[^–—:]{{2,70}}\s+[-–—:]\s*\S.*)$', 1)}}],
      lambda x: x.n BETWEEN 2 AND 160)) AS cut
    FROM (SELECT id, chunk, step, regexp_extract(rest, '^.*?{_SEP}(.*)$', 1) AS v FROM left_)) WHERE cut IS NOT NULL),
whole AS (SELECT l.id, l.chunk, l.step, trim(CASE WHEN n.rest IS NULL THEN l.rest ELSE substr(l.rest, 1, length(l.rest) - length(n.rest)) END) AS t, n.rest IS NULL AS last
  FROM left_ l LEFT JOIN left_ n ON n.id = l.id AND n.chunk = l.chunk AND n.step = l.step + 1),
outer_ AS (SELECT id, chunk, step, last, regexp_extract(t, '^(.*?){_SEP}(.*)$', 1) AS key, regexp_replace(regexp_extract(t, '^(.*?){_SEP}(.*)$', 2), '\s*[.;]$', '') AS value FROM whole),
inner_ AS (SELECT *, regexp_extract(value, '^(.*?){_SEP}(.*)$', 1) AS k, regexp_extract(value, '^(.*?){_SEP}(.*)$', 2) AS v FROM outer_)
SELECT id, chunk, step, CASE WHEN nested THEN k ELSE key END AS key, CASE WHEN nested THEN v ELSE value END AS value
FROM (SELECT *, k <> '' AND (NOT last OR list_contains({_DICT}, k) OR (NOT list_contains({_DICT}, key) AND length(v) < length(value))) AS nested FROM inner_)
""")
def glued_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose pairs run into each other, cut at sentences, answers and keys of a dictionary; headings give way to what they hold."""
    synonyms = spark.createDataFrame(_KEYS, "synonym string, code string, order int")
    found = parsing.text_pairs(_glued(spark, sf_dir), {"annotation": "S1"}, synonyms)
    return found.select("id", F.col("seq.line").cast("long").alias("chunk"), F.col("seq.step").alias("step"), "key", "value")


_LD = """'{"@graph":[[{"@type":"Product","brand":{"name":"' || host || '"},"width":{"value":' || n || ',"unitText":"см"},"additionalProperty":[{"name":"Длина страницы","value":' || n || '},{"propertyID":"Пустое","value":""}]}],{"@graph":[[[{"color":["' || lang || '","x"],"width":"1 см","material":{"name":"нет"}}]]]}],}'"""


@query(rf"""
WITH RECURSIVE p AS (SELECT page_id, length(html) AS n, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang FROM pages),
nodes AS (
  SELECT page_id, 0 AS depth, regexp_replace({_LD}, ',\s*([}}\]])', '\1', 'g')::JSON AS x FROM p
  UNION ALL
  SELECT page_id, depth + 1, unnest(CASE json_type(x) WHEN 'ARRAY' THEN from_json(x, '["JSON"]') ELSE [x->'@graph'] END) FROM nodes WHERE depth < 8 AND (json_type(x) = 'ARRAY' OR json_exists(x, '$."@graph"'))),
scalars AS (
  SELECT page_id, depth, label AS key, CASE json_type(v) WHEN 'ARRAY' THEN v->>0 WHEN 'OBJECT' THEN (v->>'value') || coalesce(' ' || (v->>'unitText'), '') ELSE v->>'$' END AS value
  FROM (SELECT page_id, depth, label, x->field AS v FROM nodes, (VALUES ('color', 'Цвет'), ('width', 'Ширина'), ('material', 'Материал')) f(field, label) WHERE json_type(x) = 'OBJECT')
  UNION ALL SELECT page_id, depth, 'Бренд', x->'brand'->>'name' FROM nodes WHERE json_type(x) = 'OBJECT'
  UNION ALL SELECT page_id, depth, coalesce(a->>'name', a->>'propertyID'), a->>'value' FROM (SELECT page_id, depth, unnest(from_json(x->'additionalProperty', '["JSON"]')) AS a FROM nodes WHERE json_type(x) = 'OBJECT' AND json_exists(x, '$.additionalProperty')))
SELECT page_id, key, arg_min(value, depth) AS value, 'jsonld' AS via FROM scalars WHERE value <> '' GROUP BY page_id, key
UNION ALL SELECT page_id, 'Высота', n || ' см', 'table' FROM p
UNION ALL SELECT page_id, 'Хост', host, 'table' FROM p
UNION ALL SELECT page_id, 'Язык', lang, 'dl' FROM p WHERE lang <> ''
UNION ALL SELECT page_id, 'Тип загрузки', 'фронтальная ' || n, 'column' FROM p
UNION ALL SELECT page_id, 'Скорость отжима', n || ' об/мин', 'item' FROM p
""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of shop pages: nested structured data with commas too many, rows of three cells, definitions, columns and list items, the first of equal keys."""
    p = _table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("string").alias("n"), F.regexp_extract("url", "^https?://([^/]+)/", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("lang"))
    data = F.concat(F.lit('<script type="application/ld+json"><!--{"@graph":[[{"@type":"Product","brand":{"name":"'), "host", F.lit('"},"width":{"value":'), "n", F.lit(',"unitText":"см"},"additionalProperty":[{"name":"Длина страницы","value":'), "n", F.lit('},{"propertyID":"Пустое","value":""}]}],{"@graph":[[[{"color":["'), "lang", F.lit('","x"],"width":"1 см","material":{"name":"нет"}}]]]}],}--></script>'))
    table = F.concat(F.lit("<table><tr><td>Высота</td><td>"), "n", F.lit("</td><td>см</td></tr><tr><td>★</td><td>Хост</td><td>"), "host", F.lit("</td></tr></table><dl><dt>Язык</dt><dd>"), "lang", F.lit("</dd></dl>"))
    beside = F.concat(F.lit('<div class="row"><div class="col-sm-5 text-muted">Тип загрузки</div><div class="col-sm-7">фронтальная '), "n", F.lit('</div></div><ul><li><span>Скорость отжима</span><span>'), "n", F.lit(" об/мин</span></li></ul>"))
    return web.page_pairs(p.select("page_id", F.concat(data, table, beside).alias("html")), "html").select("page_id", "key", "value", "via")


_ALLOWED = ("html", "head", "body", "title", "nav", "article", "div", "p", "b", "ul", "li", "a", "h1", "table", "tr", "td")


@query(rf"""
WITH RECURSIVE t AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*\b[^>]*>'), lambda x: {{'tag': lower(regexp_extract(x, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)), 'closes': starts_with(x, '</'), 'single': suffix(x, '/>')}}) AS k FROM pages),
s AS (
  SELECT page_id, 0 AS i, []::VARCHAR[] AS open, []::VARCHAR[] AS errors FROM t
  UNION ALL
  SELECT page_id, i + 1, CASE WHEN NOT listed OR x.single THEN open WHEN x.closes THEN open[:-2] ELSE list_append(open, x.tag) END,
    CASE WHEN NOT listed THEN list_append(errors, 'tag_not_allowed:' || x.tag) WHEN NOT x.single AND x.closes AND open[-1] IS DISTINCT FROM x.tag THEN list_append(errors, 'tag_not_closed:' || x.tag) ELSE errors END
  FROM (SELECT page_id, i, open, errors, k[i + 1] AS x, list_contains({list(_ALLOWED)}, k[i + 1].tag) AS listed FROM s JOIN t USING (page_id) WHERE i < len(k))),
done AS (SELECT page_id, arg_max(open, i) AS open, arg_max(errors, i) AS errors FROM s GROUP BY page_id),
found AS (SELECT page_id, list_transform(regexp_extract_all(html, '&[a-zA-Z#][a-zA-Z0-9]*;'), lambda e: 'html_entity:' || e) || errors || list_transform(open, lambda o: 'tag_not_closed:' || o)
  || CASE WHEN length(replace(html, '<', '')) <> length(replace(html, '>', '')) THEN ['angle_bracket_unbalanced:' || (length(html) - length(replace(html, '<', ''))) || '/' || (length(html) - length(replace(html, '>', '')))] ELSE [] END AS e FROM done JOIN t USING (page_id))
SELECT page_id, len(e) AS faults, split_part(e[1], ':', 1) AS kind, regexp_replace(e[1], '^[^:]*:', '') AS detail FROM found
""")
def markup_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's faults of markup and the first of them, tags read in order with a stack."""
    found = _table(spark, sf_dir, "pages").select("page_id", markup.markup_errors(F.col("html"), _ALLOWED).alias("e"))
    first = F.get("e", F.lit(0))
    return found.select("page_id", F.size("e").cast("long").alias("faults"), first["kind"].alias("kind"), first["detail"].alias("detail"))


@query(r"""
WITH RECURSIVE whole AS (SELECT event_id, '{"id":' || event_id || ',"type":"' || event_type || '","props":' || coalesce(props, 'null') || ',"all":[1,{"user":"\"' || user_id || ']"}]}' AS t FROM events),
t AS (SELECT event_id, trim(left(t, 1 + (event_id * 7 % length(t))::INT)) AS t FROM whole),
s AS (
  SELECT event_id, 0 AS i, false AS inside, false AS esc, '' AS open FROM t
  UNION ALL
  SELECT event_id, i + 1, CASE WHEN inside THEN esc OR c <> '"' ELSE c = '"' END, inside AND NOT esc AND c = '\',
    CASE WHEN inside THEN open WHEN c IN ('{', '[') THEN CASE c WHEN '{' THEN '}' ELSE ']' END || open WHEN c IN ('}', ']') AND left(open, 1) = c THEN substr(open, 2) ELSE open END
  FROM (SELECT event_id, i, inside, esc, open, substr(t, i + 1, 1) AS c, t FROM s JOIN t USING (event_id)) WHERE i < length(t)),
ends AS (SELECT event_id, t, inside, open FROM s JOIN t USING (event_id) WHERE i = length(t)),
done AS (SELECT event_id, regexp_replace(t || CASE WHEN inside THEN '"' ELSE '' END, ',\s*$', '') || open AS c FROM ends)
SELECT event_id, c AS completed, CASE WHEN json_valid(c) THEN (c::JSON)->>'type' END AS type FROM done
""")
def cut_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON cut off anywhere, its last string and its brackets closed, and what can be read of it."""
    e = _table(spark, sf_dir, "events")
    whole = F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('","props":'), F.coalesce("props", F.lit("null")), F.lit(',"all":[1,{"user":"\\"'), F.col("user_id").cast("string"), F.lit(']"}]}'))
    rows = e.select("event_id", whole.alias("t")).select("event_id", F.left("t", (1 + F.col("event_id") * 7 % F.length("t")).cast("int")).alias("t"))
    return rows.select("event_id", markup.completed_json(F.col("t")).alias("completed"), F.try_variant_get(markup.answered_json(F.col("t")), "$.type", "string").alias("type"))
