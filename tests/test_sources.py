import json

import pytest
from pyspark.sql import functions as F

from kartoteka.operators import cards, facets, shape
from kartoteka.sources import dictionary, products, writers
from kartoteka.streaming import imports


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_dumps(spark, tmp_path):
    wrapped = put(tmp_path / "a.json", json.dumps({"items": [{"id": 1, "title": "A", "article": "x1", "desc": "d"}, {"id": 1, "title": "B", "article": None, "desc": " "}]}))
    got = products.read_products(spark, wrapped)
    assert [tuple(r) for r in got.collect()] == [("1", "x1", "A", "d", None), ("1", None, "B", None, None)]
    assert [tuple(r) for r in products.repeated_ids(got).collect()] == [("1", 2)]
    plain = products.read_products(spark, put(tmp_path / "b.json", json.dumps([{"id": 7, "name": "C", "sku": "s"}])))
    keyed = products.by_any_key(plain, "name").collect()
    assert {r.key for r in keyed} == {"7", "s"}
    assert products.page(plain, ["id"], 0, 0).count() == 1
    assert products.new_rows(got, plain, "id").count() == 1
    assert products.detect_shape(plain).first().shape == "catalog"


def test_ledger(spark, tmp_path):
    lines = [{"original": {"sku": "a"}, "error": "x"}, {"original": {"sku": "a"}, "enriched": "{}"}, {"original": {"name": "n"}, "skipped": "s"}, {"original": {"name": "m"}, "skipped": "s"}]
    path = put(tmp_path / "l.jsonl", "\n".join([json.dumps(lines[0]), "{broken", *map(json.dumps, lines[1:])]))
    got = products.read_ledger(spark, path).collect()
    assert sorted((r.sku or "", r.enriched or "") for r in got) == [("", ""), ("", ""), ("a", "{}")]


def test_feed(spark, tmp_path):
    """Service parameters, bare booleans and synonyms are no facts; empty tags and attributes of categories do no harm."""
    xml = """<?xml version="1.0"?><yml_catalog><shop><categories><category id="p1" url="x">Стеклянная тара</category><category id="c1" parentId="p1" url="y">Стеклянные банки</category></categories><offers>
    <offer id="o1" available="true"><vendor>Aviora</vendor><vendorCode>104-127</vendorCode><name>Банка &quot;Твист&quot; 250 мл</name><description></description><url>u1</url><categoryId>c1</categoryId><picture>https://s/1.png</picture><price>5</price>
    <param name="Объем, мл">250</param><param name="Хит">false</param><param name="Code">1</param><param name="Синоним">банка твист</param></offer>
    <offer id="o2"><name>Без фото</name><categoryId>c1</categoryId></offer></offers></shop></yml_catalog>"""
    path = put(tmp_path / "f.xml", xml)
    offers = {r.id: r for r in products.read_offers(spark, path).collect()}
    assert [tuple(p) for p in offers["o1"].params] == [("Объем, мл", "250")] and offers["o1"].synonyms == ["банка твист"] and offers["o2"].params == []
    assert (offers["o1"].name, offers["o1"].image) == ('Банка "Твист" 250 мл', "https://s/1.png")
    paths = {r.id: r.path for r in shape.category_paths(products.read_categories(spark, path)).collect()}
    assert paths == {"p1": "Стеклянная тара", "c1": "Стеклянная тара / Стеклянные банки"}
    assert [r.id for r in products.read_offers(spark, path, spark.createDataFrame([("o1",)], "id string")).collect()] == ["o2"]
    facts = cards.offer_facts(products.read_offers(spark, path).withColumn("category", F.lit("Банки"))).filter("id = 'o1'").first()
    assert facts.specs == {"Объем, мл": "250"} and facts.article == "104-127"


def test_listing(spark):
    block = '<div itemscope itemtype="http://schema.org/Product"><img itemprop="image" src="/i/{0}.jpg"><a itemprop="url" href="/shop/{0}"><span itemprop="name">Холодильник {0}</span></a><a href="/shop/kupit/brand-lg" class="mr-brand"> LG </a><meta itemprop="price" content="43790.00"><link itemprop="availability" href="http://schema.org/{1}"><button class="js" data-sku="{0}"></button></div>'
    html = '<div data-category="523"></div><a href="?page=2">2</a><a href="?x=1&page=13">13</a>' + block.format(296646, "InStock") + block.format(315460, "OutOfStock") + '<div itemtype="http://schema.org/Product"><span itemprop="name">Крошка</span></div>'
    df = spark.createDataFrame([(5, html), (6, "<html></html>"), (7, '<div data-category="1"></div><div itemtype="http://schema.org/Product"><span itemprop="name">Крошка</span></div>')], "page_id int, html string")
    got = sorted(products.listing_items(df, origin="https://shop").collect(), key=lambda r: r.place)
    assert [(r.page_id, r.category_id, r.page_count, r.sku, r.name, r.product_url, r.image, r.price, r.available, r.brand, r.brand_slug) for r in got] == [
        (5, 523, 13, n, f"Холодильник {n}", f"https://shop/shop/{n}", f"https://shop/i/{n}.jpg", 43790.0, there, "LG", "lg") for n, there in (("296646", True), ("315460", False))
    ]


def test_product_page(spark):
    html = """<h3>Описание</h3><div itemprop="description" class="p-2"><p>Машина с загрузкой 6&nbsp;кг.</p></div></section><section><h3 class="b">Характеристики</h3><div class="p-2">
    <div class="row py-1"><div class="col-sm-5 muted">Тип загрузки</div><div class="col-sm-7"> фронтальная </div></div>
    <div class="row py-1"><div class="col-sm-5 muted">Мax загрузка белья, (кг)</div><div class="col-sm-7"> 6 </div></div></div></section>"""
    got = products.product_page(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert got.description == "Машина с загрузкой 6 кг." and got.annotation == "Тип загрузки - фронтальная<br>Мax загрузка белья, (кг) - 6"
    assert [tuple(a) for a in got.attributes] == [("Тип загрузки", "фронтальная"), ("Мax загрузка белья, (кг)", "6")]


def test_uploads(spark):
    payloads = [(1, '[{"name": "Цвет", "value": ["Белый", "Серый"]}, {"label": "Вес", "values": [{"value": "5-6"}]}]'), (2, '{"filters": {"Цвет": ["Белый"], "Шум": "40"}}'), (3, "[]"), (4, None)]
    got = {(r.id, r.name): r["values"] for r in products.filter_lists(spark.createDataFrame(payloads, "id int, body string"), "id", "body").collect()}
    assert got == {(1, "Цвет"): ["Белый", "Серый"], (1, "Вес"): ["5-6"], (2, "Цвет"): ["Белый"], (2, "Шум"): ["40"]}
    names = spark.createDataFrame([("/x/products_v2_467.json",), ("data_929.json",), ("list-523.csv",), ("a.json",)], "f string")
    assert [r[0] for r in names.select(products.category_of_file(F.col("f"))).collect()] == ["467", "929", "523", None]
    dump = spark.createDataFrame([("1", "s1", "Плита", "a", " "), ("2", None, "Печь", "b", "x")], "id string, sku string, name string, description string, annotation string")
    assert tuple(products.dump_summary(dump).first()) == (2, 1, 1)
    assert [r.id for r in products.preview(dump, "ПЕЧ").collect()] == ["2"]
    assert [(r.k, r.name) for r in products.find_in_dump(spark.createDataFrame([("s1",), ("9",)], "k string"), dump, "k").orderBy("k").collect()] == [("9", None), ("s1", "Плита")]
    with pytest.raises(ValueError):
        products.page(dump, ["id"], -1, 5)


def test_sheet(spark, tmp_path):
    path = put(tmp_path / "s.csv", "category,characteristic\nA,x\n,y\nB,z\n")
    assert [tuple(r) for r in products.read_sheet(spark, path).collect()] == [("A", "x"), ("A", "y"), ("B", "z")]


def test_dictionary_to_facets(spark, tmp_path):
    attributes = [
        {"code": "w", "name": "Вес", "type": "number", "unit": "кг", "order": 1, "synonyms": ["Масса"], "blacklist": ["брутто"], "facet": {"enabled": True, "kind": "range", "breaks": [0, 5, 10], "open_last": True}},
        {"code": "c", "name": "Цвет", "type": "enum", "order": 2, "value_aliases": {"Белый": ["white", "бел."]}, "facet": {"enabled": True, "kind": "enum"}},
        {"code": "n", "name": "Камеры", "type": "integer", "order": 3, "facet": {"enabled": False, "kind": "range"}},
    ]
    for body in (attributes, {"attributes": attributes}):
        a = dictionary.read_attributes(spark, put(tmp_path / "d.json", json.dumps(body, ensure_ascii=False)))
        assert a.count() == 3
    assert {(r.synonym, r.code) for r in dictionary.synonyms(a).collect()} >= {("Масса", "w"), ("Цвет", "c")}
    assert [r.phrase for r in dictionary.blacklist(a).collect()] == ["брутто"]
    facts = spark.createDataFrame([(1, "w", "7"), (1, "c", "White"), (2, "w", "50"), (2, "c", "синий")], "id int, code string, value string")
    known = dictionary.canonical_values(facts, dictionary.value_aliases(a))
    assert {(r.id, r.value) for r in known.filter("known").collect()} == {(1, "Белый")}
    out = {r.id: r.filters for r in facets.assign_filters(known.drop("known"), dictionary.facet_attributes(a)).collect()}
    assert out == {1: {"w": ["5-10"], "c": ["Белый"]}, 2: {"w": ["10+"], "c": ["синий"]}}
    spec = spark.createDataFrame([("c", "not_a_filter", None, None)], "code string, kind string, step double, buckets array<struct<label:string,min:double,max:double>>")
    assert [r.code for r in dictionary.facet_attributes(dictionary.overlay_filters(a, spec)).collect()] == ["w"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "a")], "id int, name string, filter string")
    for kind, back in (("json", "json"), ("parquet", "parquet"), ("csv", "csv"), ("xml", "xml")):
        writers.export_rows(df, f"{tmp_path}/{kind}", kind)
        reader = spark.read.option("header", True).option("rowTag", "item").format(back)
        assert reader.load(f"{tmp_path}/{kind}").count() == 1
    writers.write_category(df, df, str(tmp_path / "cat"), 5)
    assert writers.write_artefacts({"products": df, "filters": df, "report": df}, str(tmp_path / "art"), 5) == ["filters", "products", "report"]
    assert writers.write_artefacts({"products": df, "filters": df}, str(tmp_path / "art2"), 5, df) == ["filters_reject", "products"]
    writers.write_missing(df, f"{tmp_path}/missing")
    writers.append_ledger(df, f"{tmp_path}/ledger")
    for v in (1, 2):
        writers.save_version(df.withColumn("v", F.lit(v)), f"{tmp_path}/dump", v)
    assert writers.latest_version(spark, f"{tmp_path}/dump").first().v == 2
    writers.restore_version(spark, f"{tmp_path}/dump", 1, 3)
    assert writers.latest_version(spark, f"{tmp_path}/dump").first().v == 1
    writers.save_version(df, f"{tmp_path}/dump", 4, keep=2)
    assert sorted(p.name for p in (tmp_path / "dump").iterdir() if p.is_dir()) == ["version=3", "version=4"]


def test_incremental_import(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.json", '{"sku": "a", "n": 1}\n{"sku": "a", "n": 2}\n{"sku": "b", "n": 3}')
    run = lambda: imports.import_new(spark, str(folder), "sku string, n int", "sku", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    run()
    put(folder / "2.json", '{"sku": "b", "n": 4}\n{"sku": "c", "n": 5}')
    run()
    assert sorted(r.sku for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c"]
    stream = spark.readStream.schema("sku string, n int").json(str(folder))
    imports.ledger_of(stream, f"{tmp_path}/ledger", f"{tmp_path}/ck2", lambda d: d.withColumn("ok", F.lit(True))).awaitTermination()
    assert spark.read.json(f"{tmp_path}/ledger").count() == 5
    timed = stream.select("sku", F.lit("2024-01-01").cast("timestamp").alias("t"))
    assert imports.facet_counts(timed, "sku", "t").isStreaming


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder / "1.json", '{"sku": "a", "n": 1}\n{"sku": "b", "n": 3}')
    for attempt in (1, 2):
        stream = spark.readStream.schema("sku string, n int").json(str(folder))
        imports.ledger_of(stream, f"{tmp_path}/ledger", f"{tmp_path}/ck{attempt}", lambda d: d).awaitTermination()
    assert sorted((r.sku, r.batch) for r in spark.read.json(f"{tmp_path}/ledger").collect()) == [("a", 0), ("b", 0)]


def test_import_takes_up_where_it_ended(spark, tmp_path):
    rows = [(0, "a", "u1"), (1, "b", None), (2, "a", "u2"), (3, "c", "u3"), (4, "d", "u4"), (5, "c", "u5"), (6, "e", "u6")]
    offers = spark.createDataFrame(rows, "place long, id string, image_url string")
    album = f"{tmp_path}/album"
    steps = [imports.import_offers(offers, album, 3) for _ in range(4)]
    assert [(s["next_offset"], s["last_added"], s["exhausted"]) for s in steps] == [(3, 1, False), (6, 2, False), (7, 1, True), (7, 0, True)]
    items = spark.read.parquet(f"{album}/items")
    assert sorted((r.id, r.image_url) for r in items.collect()) == [("a", "u1"), ("c", "u3"), ("d", "u4"), ("e", "u6")]
    import shutil

    shutil.rmtree(f"{album}/cursor/at=4")  # the run ended before its cursor was written
    shutil.rmtree(f"{album}/cursor/at=3")
    again = imports.import_offers(offers, album, 3)
    assert (again["run"], again["last_added"]) == (3, 1) and sorted(r.id for r in spark.read.parquet(f"{album}/items").collect()) == ["a", "c", "d", "e"]
