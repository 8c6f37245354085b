import datetime

import pytest
from pyspark.sql import functions as F

from pagelens.operators import citability, jsonld, page, quick
from pagelens.plans.audit import complete_records
from pagelens.sources import tables
from pagelens.streaming.pages import stream_records

def one(spark, column, html, url="https://s.example/d/p"):
    return spark.createDataFrame([(html, url)], "html string, url string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n,ok", [(29, False), (30, True), (60, True), (61, False)])
def test_title_lengths(spark, n, ok):
    t = one(spark, page.title(F.col("html")), f"<TITLE lang=x> {'t' * n} </title>")
    assert (t["length"], t["ok"]) == (n, ok)


def test_titles(spark):
    get = lambda h: one(spark, page.title(F.col("html")), h)
    assert get("<p>") == (None, 0, False) and get("<title></title>") == ("", 0, False)
    assert get("<title>&amp;lt; &#039;&copy; 😀</title>") == ("< '&copy; 😀", 12, False)


@pytest.mark.parametrize("n,ok", [(119, False), (120, True), (160, True), (161, False)])
def test_description(spark, n, ok):
    d = one(spark, page.description(page.meta_tags(F.col("html"))), f"<meta content='{'d' * n}' name='description'>")
    assert (d["length"], d["ok"]) == (n, ok)
    assert one(spark, page.meta(page.meta_tags(F.col("html")), "description"), '<meta name="description" content="it\'s">') == "it"


def test_images(spark):
    x = one(spark, page.images(page.image_facts(F.col("html")), F.col("url")), '<img alt=x src="a"><img src="b c" alt=" "><img alt="ok"><IMG src="//h/p" alt="y">')
    assert (x["total"], x["without_alt"], x["without_src"], x["samples_without_alt"]) == (4, 2, 1, ["https://s.example/d/a", "https://s.example/d/b%20c"])


def test_links(spark):
    html = '<a href="MAILTO:a@b">1</a><a href=" #a">2</a><a href="//h/p">3 &amp; <b>x</b></a><a href="?q">4</a><article x href="/art">5</a><a href="tel:1">6</a><a href="/unclosed">'
    x = one(spark, page.links(page.raw_links(F.col("html")), F.col("url")), html)
    assert [(r["href"], r["anchor"]) for r in x] == [("mailto:a@b", "1"), ("https://h/p", "3 & x"), ("https://s.example/d/p?q", "4"), ("https://s.example/art", "5")]


def test_unclosed_script_is_no_trouble(spark):
    assert one(spark, page.word_count(F.col("html")), "<script>" + "a b " * 50_000) == 100_000


def blocks(spark, *scripts):
    html = "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts)
    df = spark.createDataFrame([(html, "blog")], "html string, page_type string")
    return jsonld.with_structured_data(df).first()


def test_flatten(spark):
    r = blocks(spark, '{"@context":"https://schema.org","@type":"WebPage","name":"n","@graph":[{"@type":["Product","Thing"],"name":" "},[{"@graph":[{"@type":"Person","@context":"c2"}]}],{"no":"type"}]}', '{"@type":"A","@type":"Event","x":NaN}', '{"@type":"A","@type":"Event"}', "null", '"str"')
    assert [(b["type"], b["context"], b["invalid"]) for b in r["parsed"]["blocks"]] == [("WebPage", "https://schema.org", False), ("Product", "https://schema.org", False), ("Person", "c2", False), (None, None, True), ("Event", None, False)]
    assert r["schema"]["types"] == ["WebPage", "Product", "Thing", "Person", "Event"] and r["schema"]["count"] == 5
    product = r["verdicts"][1]
    assert product["errors"] == ['Falta campo requerido "name" en Product'] and product["score"] == 0.0
    assert r["verdicts"][2]["errors"][0] == "@context no apunta a schema.org (encontrado: c2)"
    assert r["verdicts"][4]["errors"][0] == "Falta @context"


def test_rules(spark):
    r = blocks(spark, '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"","acceptedAnswer":{"@type":"X"}},{"@type":"Question","name":"q","acceptedAnswer":{"@type":"Answer","text":"t"}},null]}', '{"@context":"https://schema.org","@type":"HowTo","name":"n","step":[]}')
    faq, howto = r["verdicts"]
    assert faq["errors"] == ['FAQPage: Question[0] sin "name" (la pregunta)', 'FAQPage: Question[0].acceptedAnswer sin "text"', "FAQPage: mainEntity[2] debe ser @type=Question"]
    assert faq["warnings"] == ["FAQPage: Question[0].acceptedAnswer debería ser @type=Answer"]
    assert howto["errors"] == ['Falta campo requerido "step" en HowTo', 'HowTo: "step" vacío']
    assert [m["type"] for m in r["schema_validation"]["missing_schemas"]] == ["Organization", "WebSite", "BreadcrumbList", "Article (o BlogPosting / NewsArticle)"]
    assert [x["category"] for x in r["schema_validation"]["recommendations"]][:5] == ["fix_existing"] * 5


def test_dates(spark):
    found = one(spark, citability.dates(F.col("html")), "2024-02-31, 2024-13-01 x31-12/2023 31-12/2023 año2020 in 2021.")
    assert found == [datetime.date(2024, 3, 2), datetime.date(2023, 12, 31), *[datetime.date(y, 1, 1) for y in (2024, 2024, 2023, 2023, 2021)]]


def test_recent(spark):
    as_of = F.lit("2024-06-30").cast("timestamp")
    get = lambda d, n: one(spark, citability.recent(citability.dates(F.col("html")), as_of, n), d)
    assert get("2024-04-01", 90) and not get("2024-03-31", 90) and not get("2025-07-01", 365)


def test_quick_title(spark):
    q = one(spark, quick.quick_html(F.col("html"), F.col("url")), '<title> ten chars!</title><meta name="description" id="x" content="y"><img alt="" src="a"><img  ALT = x>')
    assert q["title"]["ok"] and q["meta_description"]["value"] is None and q["images"]["ok"] and q["images"]["total"] == 2


SNAPSHOT = [
    ("https://s.example", 1, "https://s.example/", "https://s.example/", 200, "text/html", None, 5, None, "<html lang='de'><title>T</title><a href='/x'>x</a></html>"),
    (None, 2, "https://s.example/x?utm_a=1", "https://s.example/y", 404, "text/html", 10, 5, None, "<p>gone</p>"),
    ("https://s.example", 3, "https://s.example/f", "https://s.example/f", 200, "application/pdf", 0, 5, None, "%PDF"),
    ("https://s.example", 4, "https://s.example/t", None, None, None, None, 5, "timeout", None),
]


def test_snapshot(spark):
    rows = {r["seq"]: r for r in complete_records(spark.createDataFrame(SNAPSHOT, tables.PAGES), F.lit("2024-06-30").cast("timestamp")).collect()}
    assert [rows[i]["ok"] for i in (1, 2, 3, 4)] == [True, False, False, False] and rows[3]["error"] == "not_html" and rows[3]["title"] is None and rows[3]["size_bytes"] is None
    assert rows[1]["size_bytes"] == len(SNAPSHOT[0][-1]) and rows[2]["site"] == "https://s.example" and rows[2]["redirected"] and rows[4]["url_params"] is None
    assert rows[1]["links"]["internal"][0]["href"] == "https://s.example/x" and rows[1]["citability"]["rating"] == "poor" and rows[3]["citability"] is None


def test_sources_sinks_and_stream(spark, tmp_path):
    df = spark.createDataFrame(SNAPSHOT, tables.PAGES)
    df.write.parquet(str(tmp_path / "in"))
    back = tables.read_table(spark, str(tmp_path / "in"), tables.PAGES)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    tables.write_report(back.drop("html"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    tables.write_report(back.drop("html").fillna({"site": "none"}), str(tmp_path / "by"), "parquet", by_site=True)
    assert spark.read.parquet(str(tmp_path / "by")).where("site = 'none'").count() == 1
    tables.write_texts(spark.createDataFrame([("a", "x\ny\n"), ("b", "z")], "site string, content string"), str(tmp_path / "txt"))
    assert {(r["site"], r["value"]) for r in spark.read.text(str(tmp_path / "txt"), wholetext=True).collect()} == {("a", "x\ny\n"), ("b", "z\n")}
    as_of = F.lit("2024-06-30").cast("timestamp")
    stream = spark.readStream.schema(tables.PAGES).parquet(str(tmp_path / "in"))
    stream_records(stream, as_of, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["seq"]: r["title"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["seq"]: r["title"] for r in complete_records(back, as_of).collect()}
