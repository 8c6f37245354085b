import random

import pytest
from pyspark.sql import functions as F

from pagelens.functions import urls

BASE = "http://h.com/a/b/c?q#f"


@pytest.mark.parametrize(
    "href,want",
    [
        ("g", "http://h.com/a/b/g"), ("../x", "http://h.com/a/x"), ("../../../x", "http://h.com/x"), (".", "http://h.com/a/b/"), ("..", "http://h.com/a/"), ("%2e%2E/x", "http://h.com/a/x"),
        ("..\\x", "http://h.com/a/x"), ("/für", "http://h.com/f%C3%BCr"), ("a b", "http://h.com/a/b/a%20b"), ("//H2.COM/p", "http://h2.com/p"), ("?y", "http://h.com/a/b/c?y"), ("", "http://h.com/a/b/c?q"),
        ("#z", "http://h.com/a/b/c?q#z"), ("http://H:80/", "http://h/"), ("https://ex.com", "https://ex.com/"), ("http://a.com:443/x", "http://a.com:443/x"), ("http:g", "http://h.com/a/b/g"), ("https:g", "https://g/"),
        ("http:/x", "http://h.com/x"), ("http:///x", "http://x/"), ("mailto:a@b.c", "mailto:a@b.c"), ("JAVASCRIPT:x(1)", "javascript:x(1)"), ("http://user:pw@H.com/p", "http://user:pw@h.com/p"),
        ("http://[::1]:8080/", "http://[::1]:8080/"), ("http://0x7f.1/", "http://127.0.0.1/"), ("http://bücher.de/", "http://xn--bcher-kva.de/"), (" \n/x\t", "http://h.com/x"), ("/a?b c#d e", "http://h.com/a?b%20c#d%20e"),
        ("/De%%%", "http://h.com/De%%%"), ("?x'y", "http://h.com/a/b/c?x%27y"), ("http://a b/", None), ("http://h:99999/", None), ("http://", None), ("http://1.2.3.256/", None),
        ("http://straße.de/", "http://xn--strae-oqa.de/"), ("http://FAẞ.de/", "http://xn--fa-hia.de/"), ("http://βόλος.com/", "http://xn--nxasmm1c.com/"), ("http://ＧＯ。com/", "http://go.com/"), ("http://xn--bcher-kva.de/", "http://xn--bcher-kva.de/"),
        ("http://☃.net/", "http://xn--n3h.net/"), ("http://a\u00adb.c/", "http://ab.c/"), ("http://a:\u0663/", None), ("http://xn--a/", None), ("http://xn--/", None), ("http://xn--fa-hia.de/", "http://xn--fa-hia.de/"), ("http://xn--BCHER-KVA.de/", "http://xn--bcher-kva.de/"), ("http://\u05e0a.com/", None), ("http://1\u05d0.com/", None),
        ("http://\u05d01.com/", "http://xn--1-zhc.com/"), ("http://a\u200cb.com/", None), ("http://\u0915\u094d\u200d\u0937.com/", "http://xn--11b2ezcw70k.com/"), ("file:///C|/x", "file:///C:/x"), ("file:///C:/../x", "file:///C:/x"), ("file://C|/x", "file:///C:/x"), ("http://\u0301a.de/", None),
    ],
)
def test_resolve(href, want):
    assert urls.resolve_one(href, BASE) == want


def test_columns(spark):
    rows = [("http://h.com/p/?ref=1&reference=2&sidebar=3&a=1&a=2&&=#",), ("https://h.com/Blog/x.CSS?utm_source=a%20b#t",), ("file:///x",), (None,)]
    df = spark.createDataFrame(rows, "url string").select(urls.params(F.col("url")).alias("p"), urls.origin(F.col("url")).alias("o"), urls.page_type(F.col("url")).alias("t"), urls.is_asset(F.col("url")).alias("a"))
    a, b, c, d = df.collect()
    assert a["p"]["params"] == ["ref", "reference", "sidebar", "a", "a", ""] and a["p"]["tracking_params"] == ["ref", "reference", "sidebar"] and not a["p"]["has_fragment"] and a["p"]["depth"] == 1
    assert b["p"]["tracking_params"] == ["utm_source"] and b["p"]["has_fragment"] and b["t"] == "blog" and b["a"]
    assert (a["o"], c["o"], d["o"], d["p"], d["t"]) == ("http://h.com", "null", None, None, "unknown")


def test_target_and_category(spark):
    df = spark.createDataFrame([("example.com",), ("HTTP://x.y/",), ("no spaces here",)], "u string")
    assert [r[0] for r in df.select(urls.normalize(urls.target(F.col("u")))).collect()] == ["https://example.com/", "http://x.y/", None]
    cases = [("https://a.b/", 0, "main"), ("https://a.b/newsletter", 0, "blog"), ("https://a.b/x", 0, "main"), ("https://a.b/x/y", 300, "optional"), ("https://a.b/x/y", 301, "blog"), ("https://a.b/privacy/blog", 0, "optional"), ("https://a.b/team/services", 0, "about"), ("https://a.b/q/pricing", 0, "products")]
    df = spark.createDataFrame(cases, "u string, n int, want string")
    assert all(r[0] == r[1] for r in df.select(urls.category(F.col("u"), F.col("n")), "want").collect())


PIECES = ["http://", "https://", "HTTP://", "//", "/", "/", "h.com", "a.b", "sub.x-y.org", "1.2.3.4", "0x7", "12", "xn--a", "xn--bcher-kva", ".", "..", "-", "_", "%2e", "%2E", "%41", "a", "b", "index.html", "?", "q=1", "&", "#", "f", "'", '"', "<", "`", "{", "}", "|", "^", "[", "]", "\\", "@", ":", ":80", ";", "=", "é", " ", "\t", "\n", "~", "!", "$", "(", ")", "*", "+", ",", "mailto:", "ftp://"]
BASES = ["http://h.com/a/b/c?q#f", "https://h.com", "http://h.com?x", "https://a.b/", "http://1.2.3.4/x", "http://H.com/", "http://h.com/p%20q/", "http://h.com#z", "https://a.b/x/../y", None, "nope"]


def test_expressions_agree_with_the_helper(spark):
    """Whatever is resolved without Python is what the standard's rules give, and Python sees only the rest."""
    rnd = random.Random(2)
    some = lambda k: "".join(rnd.choices(PIECES, k=rnd.randint(0, k)))
    href = lambda: some(7) if rnd.random() < 0.6 else rnd.choice(["http://h.com", "https://a.b"]) + rnd.choice(["", "/"]) + some(6)
    rows = [(rnd.choice(BASES) if rnd.random() < 0.7 else "http://" + some(6), [href() for _ in range(rnd.randint(0, 8))] + [None] * (rnd.random() < 0.05)) for _ in range(4000)] + [("http://h.com/", None)]
    df = spark.createDataFrame(rows, "b string, h array<string>").repartition(4)
    easy = 0
    for r in df.select("b", "h", urls.resolve_all("b", "h").alias("r"), urls.normalize("b").alias("n"), F.transform("h", lambda x: urls._plain(x, F.col("b"))).alias("p")).collect():
        assert r["n"] == urls.resolve_one(r["b"])
        assert r["r"] == (None if r["h"] is None else [urls.resolve_one(x, r["b"] if r["b"] is not None else "") for x in r["h"]]), r
        easy += sum(x is not None for x in r["p"] or [])
    assert easy > 1000


def test_plain_links_do_not_reach_python(spark):
    odd = spark.createDataFrame([("https://h.com/a/b", ["/x", "y/z.html?q=1", "https://o.org", "#t", "?p", "../up", "a b"])], "b string, h array<string>")
    seen = odd.select(F.filter(F.transform("h", lambda x: urls._plain(x, F.col("b"))), lambda x: x.isNotNull()).alias("x")).first()["x"]
    assert seen == ["https://h.com/x", "https://h.com/a/y/z.html?q=1", "https://o.org/", "https://h.com/a/b#t", "https://h.com/a/b?p"]
