"""Pages that never close what they open: the same results as the plain patterns, in time that follows their length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagelens.functions import tags
from pagelens.functions.text import closed, every, first, strip_tags, trim
from pagelens.operators import citability, discovery, jsonld, page, quick

PIECES = ["<title>", "</title>", "<TITLE x>", "<h1>", "</H1>", "<h2 a>", "</h2>", "<script>", "</script>", "<script type='application/ld+json'>{}", "<style>", "</style>", "<noscript>", "</noscript>", "<a href='x'>", "<a>", "</a>", "</A>", "<", ">", " ", "\u00a0", "\n", "word", "x&amp;y", "<p>", "</p>"]


def plain(html):
    """What the extractions were before they stopped at the last closing tag."""

    def cut(names):
        text = html
        for n in names:
            text = F.regexp_replace(text, page.ELEMENTS[n], " ")
        return F.regexp_replace(text, "<[^>]+>", " ")

    return {
        "title": first(html, r"(?i)<title[^>]*>([\s\S]*?)</title>"),
        "h1": every(html, r"(?i)<h1[^>]*>([\s\S]*?)</h1>", 1),
        "hrefs": every(html, f"(?i)<a{page.LINK}", 1),
        "scripts": every(html, f"(?i)<script{jsonld.SCRIPT}", 1),
        "words": F.regexp_count(cut(["script", "style"]), F.lit("[^\\s\u00a0]+")),
        "visible": F.regexp_replace(F.regexp_replace(cut(["script", "style", "noscript"]), "[\\s\u00a0]+", " "), "^ | $", ""),
        "stripped": F.regexp_replace(html, "<[^>]+>", ""),
    }


def test_same_as_the_plain_patterns(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choices(PIECES, k=rnd.randint(0, 14))),) for _ in range(3000)] + [(None,), ("",)]
    html = F.col("html")
    new = {
        "title": tags.first_body(closed(html, "title"), "<title", page.BODY["title"]),
        "h1": tags.bodies(closed(html, "h1"), "<h1", page.BODY["h1"]),
        "hrefs": tags.matches(closed(html, "a"), "<a", page.LINK, 1),
        "scripts": jsonld.scripts(html),
        "words": page.word_count(html),
        "visible": page.visible_text(html),
        "stripped": strip_tags(html),
    }
    old = plain(html)
    df = spark.createDataFrame(rows, "html string")
    for name in new:
        differ = df.where(~new[name].eqNullSafe(old[name])).select("html", new[name], old[name]).head(3)
        assert not differ, (name, differ)


Q = "[\"']"
ATTRIBUTES = ["<meta ", "<META\n", "<meta", "<link ", "<link", "<a ", "<a", "<article ", "<img ", "<img", "<html ", "<h2", "<p ", "<li>", "<div ", "name='description' ", "name=\"og:title\"", "property='og:title' ", "name=viewport", "name='viewport'", "charset=", "content='c1'", " content=\"a > b\" ", "content='", "content=''", "data-content=\"z\" ", "rel='canonical' ", "rel=\"alternate\" ", "rel='author'", "rel='x nofollow'", "href='h1' ", "href=\"h2\"", "href=''", "href='p>q' ", "hreflang='de' ", "hreflang=\"f>r\" ", "lang='en'", "lang=''", "alt='x' ", "src='s' ", "class='my author'", "id=\"byline", ">", ">", ">", "/>", "'", "\"", "text? ", "</h2>", "</p>", "</li>", "</a>", " "]


def plain_attributes(html):
    """The patterns as they read, tried at every opener."""
    meta = lambda n: F.coalesce(first(html, f"(?i)<meta[^>]+(?:name|property)={Q}{n}{Q}[^>]*content={Q}([^\"']*){Q}"), first(html, f"(?i)<meta[^>]+content={Q}([^\"']*){Q}[^>]*(?:name|property)={Q}{n}{Q}"))
    return {
        "description": trim(page.decode(meta("description"))),
        "og": trim(page.decode(meta("og:title"))),
        "canonical": F.coalesce(first(html, f"(?i)<link[^>]+rel={Q}canonical{Q}[^>]*href={Q}([^\"']+){Q}"), first(html, f"(?i)<link[^>]+href={Q}([^\"']+){Q}[^>]*rel={Q}canonical{Q}")),
        **{f"lang{i}": every(html, f"(?i)<link{p}", 1) for i, p in enumerate(page.HREFLANG)},
        **{f"href{i}": every(html, f"(?i)<link{p}", 2) for i, p in enumerate(page.HREFLANG)},
        "images": every(html, "(?i)<img[^>]*>"),
        "viewport": html.rlike(f"(?i)<meta[^>]+name={Q}viewport{Q}"),
        "charset": html.rlike("(?i)<meta[^>]+charset="),
        "lang": first(html, f"(?i)<html[^>]+lang={Q}([^\"']+){Q}"),
        "langs": every(html, f"(?i)<link[^>]+hreflang={Q}([^\"']+){Q}[^>]*>", 1),
        "hrefs": every(html, f"(?i)<a\\s[^>]*href={Q}([^\"']+){Q}", 1),
        "crawl": every(html, f"(?i)<a[^>]+href={Q}([^\"']+){Q}", 1),
        "author": html.rlike(f"(?i)<[^>]+(?:class|id)={Q}[^\"']*(?:author|byline|writer)[^\"']*{Q}"),
        "rel": html.rlike(f"(?i)<a[^>]+rel={Q}author{Q}"),
        "nofollow": html.rlike(f"(?i)<a[^>]+rel={Q}[^\"']*nofollow"),
        "question": html.rlike(r"(?i)<h[2-4][^>]*>[^<]*\?[^<]*</h[2-4]>"),
        "paragraphs": every(html, r"(?i)<p(?![A-Za-z0-9_])[^>]*>[\s\S]*?</p>"),
    }


def read_attributes(html):
    metas = page.meta_tags(html)
    sides = [tags.pairs(html, "<link", p, ("lang", "href")) for p in page.HREFLANG]
    return {
        "description": page.meta(metas, "description"),
        "og": page.meta(metas, "og:title"),
        "canonical": page.canonical(html)["value"],
        **{f"lang{i}": F.transform(p, lambda x: x["lang"]) for i, p in enumerate(sides)},
        **{f"href{i}": F.transform(p, lambda x: x["href"]) for i, p in enumerate(sides)},
        "images": tags.matches(html, "<img", "[^>]*>"),
        "viewport": page.technical(html, metas)["has_viewport"],
        "charset": page.technical(html, metas)["has_charset"],
        "lang": page.technical(html, metas)["lang"],
        "langs": tags.matches(html, "<link", f"[^>]+hreflang={Q}([^\"']+){Q}[^>]*>", 1),
        "hrefs": tags.matches(html, "<a\\s", f"[^>]*href={Q}([^\"']+){Q}", 1),
        "crawl": tags.matches(html, "<a", discovery.CRAWL_LINK, 1),
        "author": tags.has(html, "<", f"[^>]+(?:class|id)={Q}[^\"']*(?:author|byline|writer)[^\"']*{Q}"),
        "rel": tags.has(html, "<a", f"[^>]+rel={Q}author{Q}"),
        "nofollow": tags.has(html, "<a", f"[^>]+rel={Q}[^\"']*nofollow"),
        "question": F.exists(tags.matches(html, "<h[2-4]", "[^>]*>([^<]*+)</h[2-4]>", 1), lambda x: x.contains("?")),
        "paragraphs": tags.matches(closed(html, "p"), "<p(?![A-Za-z0-9_])", r"[^>]*>[\s\S]*?</p>"),
    }


def test_attributes_as_by_the_plain_patterns(spark):
    rnd = random.Random(11)
    rows = [("".join(rnd.choices(ATTRIBUTES, k=rnd.randint(1, 18))),) for _ in range(12_000)] + [("",)]
    rows += [("".join(rnd.choices(["<meta ", "name='description' ", "content='c' ", "content=\"a>b\" ", ">", "'", " x "], k=rnd.randint(2, 9))),) for _ in range(8_000)]
    rows += [("".join(rnd.choices(["<link ", "rel='alternate' ", "hreflang='x' ", "href='y' ", "href='", "rel='canonical' ", "hreflang='", ">", "'"], k=rnd.randint(2, 12))),) for _ in range(8_000)]
    rows += [("".join(rnd.choices(["<h2", "<h3>", "<H2 a>", "what? ", "x", "</h2>", "</h4>", "<", ">", "<p>", "</p>"], k=rnd.randint(2, 9))),) for _ in range(4_000)]
    html = F.col("html")
    df = spark.createDataFrame(rows, "html string").repartition(4).cache()
    new, old = read_attributes(html), plain_attributes(html)
    both = df.select("html", F.struct(*[c.alias(n) for n, c in new.items()]).alias("new"), F.struct(*[c.alias(n) for n, c in old.items()]).alias("old"))
    hits = {n: 0 for n in new}
    for r in both.collect():
        for n in new:
            assert r["new"][n] == r["old"][n], (n, r["html"], r["new"][n], r["old"][n])
            hits[n] += bool(r["old"][n])
    assert min(hits.values()) > 50, hits


def test_locations(spark):
    rnd = random.Random(5)
    plain = "(?i)<loc>[\\s\u00a0]*([^<]+?)[\\s\u00a0]*</loc>"
    rows = [("".join(rnd.choices(["<loc>", "</loc>", "</LOC>", " ", "\n", "\u00a0", "u", "<x>"], k=rnd.randint(0, 12))),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "xml string").select("xml", F.transform(every(F.col("xml"), discovery.LOC, 1), discovery._location).alias("a"), every(F.col("xml"), plain, 1).alias("b"))
    assert not df.where("not a <=> b").head(3) and df.where("size(a) > 0").count() > 100


SOUP = ["<title><script><a href='x'>", "<h1><h2><style><noscript>", "<p><li><dl>", "<script type='application/ld+json'>", "<", " x", "<title ", "\u00a0"]
OPENERS = ["<meta x ", "<meta name='description' ", "<link rel=canonical ", "<link rel='alternate' ", "<img ", "<html ", "<a ", "<a href='", "<h1 ", "<h2>?", "<p ", "<li ", "<dl ", "<div class='", "<meta content=\"><", "<script ", "<loc> "]


@pytest.mark.parametrize("piece", SOUP)
def test_a_page_of_a_million_characters(spark, piece):
    text = piece * (1_000_000 // len(piece)) + "end"
    df = spark.createDataFrame([(text,)], "html string").repartition(1).cache()
    df.count()
    html = F.col("html")
    begin = time.time()
    df.select(page.title(html), page.headings(html), page.raw_links(html), page.word_count(html), page.visible_text(html), jsonld.scripts(html), trim(html)).collect()
    assert time.time() - begin < 30


@pytest.mark.parametrize("piece", OPENERS)
def test_a_million_characters_of_openers(spark, piece):
    """Nothing closed, and all closed at the end only."""
    rows = [(piece * (1_000_000 // len(piece)) + end,) for end in ("end", "</title></h1></h2></a></p></li></script></dl>")]
    df = spark.createDataFrame(rows, "html string").repartition(2).cache()
    df.count()
    html, no = F.col("html"), F.expr("cast(array() as array<string>)")
    metas = page.meta_tags(html)
    heads = F.struct(*[F.lit(0).alias(f"h{i}_count") for i in (1, 2, 3)])
    shown = [page.title(html), page.headings(html), page.raw_links(html), jsonld.scripts(html), page.description(metas), page.technical(html, metas), page.canonical(html), page.hreflang(html), page.image_facts(html)]
    shown += [quick.quick_html(html, F.lit("https://a.b/")), tags.matches(html, "<a", discovery.CRAWL_LINK, 1), every(html, discovery.LOC, 1)]
    shown += [citability.authorship(html, F.lit(""), no), citability.structure(html, heads), citability.citations(html, F.expr("cast(array() as array<struct<href:string>>)")), citability.answer_format(html, no)]
    begin = time.time()
    df.select(*[c.alias(f"c{i}") for i, c in enumerate(shown)]).collect()
    assert time.time() - begin < 30
    df.unpersist()
