from pyspark.sql import functions as F

from kartoteka import plans
from kartoteka.operators import audit, derive, identity
from kartoteka.sources import web
from kartoteka.sources.products import listing_items


def test_links_and_hosts(spark):
    html = '<a class="r" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fshop.ru%2Fp%2F1%3Futm_source%3Dx&amp;rut=1">LG <b>GA</b></a><a href="https://www.google.com/x">g</a><a href="https://shop.ru/p/2">two</a><a href="https://b.ru/">root</a><a href="http://192.168.0.1/x">local</a>'
    links = web.page_links(spark.createDataFrame([(1, html)], "q int, html string"), "html")
    assert [r.title for r in links.orderBy("place").collect()] == ["LG GA", "g", "two", "root", "local"]
    got = web.accepted_sources(links, "q", own_hosts=("mine.ru",)).collect()
    assert [(r.host, r.url, r.place) for r in got] == [("shop.ru", "https://shop.ru/p/1", 0)]


def test_structured_data(spark):
    html = '<script type="application/ld+json">{"@type": "Product", "name": "N", "sku": "s", "brand": {"name": "LG"}, "offers": {"price": "12.5"}}</script><script type="application/ld+json">{broken</script>'
    got = web.product_data(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"), "html").collect()
    assert [tuple(r) for r in got] == [(1, "N", "s", "LG", 12.5)]


def test_pages_of_products(spark):
    pages = spark.createDataFrame([(1, "обзор"), (2, "холодильник LG GA-509 (купить)"), (3, "артикул: X-77 и GA-509")], "page_id int, text string")
    products = spark.createDataFrame([(10, "ga-509", None), (11, None, "X-77"), (12, "zz-99", None)], "product_id int, model string, article string")
    assert sorted(tuple(r) for r in derive.pages_of_products(pages, products).collect()) == [(10, 2, "identity"), (11, 3, "article")]
    said = spark.createDataFrame([("Side by Side холодильник", "side by side"), ("side холодильник by side", "side by side"), ("x", "")], "t string, p string")
    assert [r.y for r in said.select(derive.says_in_order(F.col("t"), F.col("p")).alias("y")).collect()] == [True, False, False]


def test_filter_maps_and_sizes(spark):
    cards = spark.createDataFrame([(1, {"a": ["x"], "b": ["y"]}), (2, {"b": ["z"]})], "id int, filters map<string, array<string>>")
    got = {r.id: r.filters for r in audit.known_filters_only(cards, "filters", spark.createDataFrame([("a",)], "code string")).collect()}
    assert got == {1: {"a": ["x"]}, 2: None}
    sizes = spark.range(1).select(derive.size_of_axes(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("a"), derive.size_of_axes(F.lit(1.0), F.lit(None).cast("double"), F.lit(3.0)).alias("b")).first()
    assert tuple(sizes.a) == (1.0, 2.0, 3.0) and sizes.b is None


def test_mobile_hosts_are_judged(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    mobile = {r.page_id for r in pages.filter("url rlike '^https?://m[.]'").select("page_id").collect()}
    got = {r.place for r in plans.QUERIES["accepted_sources_of_all_hosts"](spark, "/root/testdata/sf0.001").collect()}
    assert mobile & got


def test_nothing_ends_at_a_bound(spark):
    defaults = spark.range(1200).select(F.col("id").cast("string").alias("code"), F.lit("d").alias("value"))
    facts = spark.createDataFrame([(1, "0", "f")], "id long, code string, value string")
    assert derive.fill_defaults(facts, spark.range(1, 3), defaults).count() == 2400
    texts = spark.createDataFrame([(1, "a b c d e f g")], "id int, text string")
    aliases = spark.createDataFrame([("k", "b c d e f", "long")], "code string, alias string, canon string")
    assert [tuple(r) for r in audit.value_claims(texts, "id", "text", aliases).collect()] == [(1, "k", "long")]
    page = "<html>" + '<p itemtype="https://schema.org/Product" data-sku="7">' * 100_002
    assert listing_items(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, html string")).select("place").count() == 100_002


def test_facts_of_pages(spark):
    pages = [
        """<script type="application/ld+json">{"@type": "Product", "additionalProperty": [{"name": "Максимальная загрузка", "value": "7 кг"}], "width": {"value": 60, "unitText": "см"}}</script>
        <div class="chars__name">Скорость отжима</div>
        <div class="chars__value">1200 об/мин</div>""",
        """<h3>Характеристики</h3><div class="row"><div class="col-sm-5 text-muted">Тип загрузки</div><div class="col-sm-7">фронтальная</div></div>
        <div class="row"><div class="col-sm-5">Макс. загрузка</div><div class="col-sm-7">6 кг</div></div><ul><li><span>Скорость отжима</span><span>1200 об/мин</span></li></ul>""",
        '<div class="name">Цвет</div><div class="value">белый</div>',
        '<script type="application/ld+json"><!--{"@type":"Product","additionalProperty":[{"name":"Загрузка","value":"6 кг"}]}--></script>',
        "<table><tr><th>Вес</th><td>5</td></tr><tr><td>вес</td><td>6</td></tr><tr><td>одна</td></tr></table>",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page int, html string")
    got = web.page_pairs(df, "html").collect()
    assert [(r.page, r.key, r.value, r.via) for r in sorted(got, key=lambda r: (r.page, r.place))] == [
        (0, "Максимальная загрузка", "7 кг", "jsonld"), (0, "Ширина", "60 см", "jsonld"), (0, "Скорость отжима", "1200 об/мин", "block"),
        (1, "Тип загрузки", "фронтальная", "column"), (1, "Макс. загрузка", "6 кг", "column"), (1, "Скорость отжима", "1200 об/мин", "item"),
        (2, "Цвет", "белый", "block"), (3, "Загрузка", "6 кг", "jsonld"), (4, "Вес", "5", "table"),
    ]
    cells = [["Ширина", "60 см"], ["★", "Ширина", "60 см"], ["Высота", "85", "см"], ["a"], ["Вес", "-", "5"]]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c array<string>").select("i", web.cells_pair(F.col("c")).alias("p")).orderBy("i").collect()
    assert [r.p and tuple(r.p) for r in rows] == [("Ширина", "60 см"), ("Ширина", "60 см"), ("Высота", "85 см"), None, ("Вес", "5")]


def test_pages_of_a_product(spark):
    cases = [
        ("WW80AG6S28AELP Indesit", None, "Indesit", "WW80AG6S28AELP", None, True),
        ("WW80AGAS26AXLP Indesit", None, "Indesit", "WW80AG6S28AELP", None, False),
        ("Бирюса M418", None, "Бирюса", "418", None, False),
        ("Indesit BWSE 7129X WSV RU", None, "Indesit", "BWSE 7129X WSV RU", None, True),
        ("Стиральная машина Индезит BWSE 7129X WSV RU", None, "Indesit", "BWSE 7129X WSV RU", ["Индезит"], True),
        ("Стиральная машина BWSE 7129X WSV RU", None, "Indesit", "BWSE 7129X WSV RU", ["Индезит"], False),
        ("Холодильник DON R 290 G объём 310", "Холодильник DON R 290 G", None, None, None, True),
        ("Холодильник DON R 291 G", "Холодильник DON R 290 G", None, None, None, False),
        ("Холодильник белый", "Холодильник белый", None, None, None, False),
        ("Стиральная машина ATLANT SMA 60C1010 белая", None, "ATLANT", "60С1010", None, True),
        ("Вытяжка Integra-60, чёрная", None, None, "Integra-50", None, False),
        ("Вытяжка Integra 50 и Integra-60", None, None, "Integra-50", None, True),
        ("Вытяжка Integra Glass 50", None, None, "Integra-50", None, False),
        ("Модель R290, белая", None, None, "R 290", None, True),
    ]
    for text, name, brand, model, names, want in cases:
        pages = spark.createDataFrame([(1, text)], "page_id int, text string")
        product = spark.createDataFrame([(7, name, brand, model, names)], "product_id int, name string, brand string, model string, brand_names array<string>")
        assert (identity.product_pages(pages, product).count() > 0) == want, (text, model)
    words = spark.createDataFrame([("Холодильник белый",), ("Холодильник DON R 290 G",)], "n string").select(identity.key_words(F.col("n")).alias("w")).collect()
    assert [r.w for r in words] == [[], ["DON", "290"]]


def test_answers_of_a_search_engine(spark):
    import base64

    xml = """<?xml version="1.0" encoding="utf-8"?><yandexsearch version="1.0"><response date="1"><results><grouping>
        <group><doc><url>https://shop.example/card</url><title>A <hlword>model</hlword></title><saved-copy-url>https://copy.example</saved-copy-url></doc></group>
        <group><doc><url><![CDATA[https://other.example/tovar?a=1&b=2]]></url><title>B</title></doc><doc><url>https://third.example/x?a=1&amp;b=2</url></doc></group>
        </grouping></results></response></yandexsearch>"""
    coded = base64.b64encode(xml.encode()).decode()
    want = ["https://shop.example/card", "https://other.example/tovar?a=1&b=2", "https://third.example/x?a=1&b=2"]
    cases = [(xml, None, want), (coded, None, want), (f'{{"rawData":"{coded}"}}', None, want), (f'{{"response":{{"rawData":"  {coded}  "}}}}', None, want), ('<response><error code="15">not found</error></response>', None, []), ('<response><error code="32">quota</error></response>', "32", []), ("no answer", None, []), (None, None, [])]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string")
    got = df.select("i", web.search_answer(F.col("x")).alias("a")).orderBy("i").collect()
    assert [(r.a.error, r.a.urls) for r in got] == [(e, u) for _, e, u in cases]
