"""Page records: signals of a fetched page as columns, strict profile. Every operator is a projection; nothing shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, urls
from ..functions.text import WS, closed, count, decode, filled, first, let, strip_tags, trim, units, without_elements

Q = tags.Q
#: What follows the openers of elements, see tags.matches().
BODY = {name: rf"[^>]*>([\s\S]*?)</{name}>" for name in ("title", *(f"h{i}" for i in range(1, 7)))}
LINK = rf"[^>]+href={Q}([^\"']+){Q}[^>]*>([\s\S]*?)</a>"
HREFLANG = [  # a tag without the attribute isn't searched for the others
    rf"(?=[^>]+hreflang=)[^>]+rel={Q}alternate{Q}[^>]+hreflang={Q}([^\"']+){Q}[^>]+href={Q}([^\"']+){Q}",
    rf"(?=[^>]+rel={Q}alternate{Q})[^>]+hreflang={Q}([^\"']+){Q}[^>]+rel={Q}alternate{Q}[^>]+href={Q}([^\"']+){Q}",
]
ELEMENTS = {name: rf"(?i)<{name}[\s\S]*?</{name}>" for name in ("script", "style", "noscript")}
SKIPPED = ("#", "mailto:", "tel:", "javascript:")


def title(html: Column) -> Column:
    """``{value,length,ok}``; ok from 30 to 60 units; null without the tag, empty for an empty one."""
    return measured(trim(decode(tags.first_body(closed(html, "title"), "<title", BODY["title"]))), 30, 60)


def measured(value: Column, least: int, most: int) -> Column:
    """``{value,length,ok}``; the value is looked for once."""

    def record(v: Column) -> Column:
        length = F.coalesce(units(v), F.lit(0))
        return F.struct(v.alias("value"), length.alias("length"), (filled(v) & length.between(least, most)).alias("ok"))

    return let(value, record)


def meta_tags(html: Column) -> Column:
    """The page's meta tags, which meta() reads."""
    return tags.stretches(html, "<meta")


def meta(found: Column, name: str) -> Column:
    """Content of the first of meta_tags() of that name or property, name first or else content first; null without one."""
    return trim(decode(tags.value_beside(found, "content", f"(?:name|property)={Q}{name}{Q}")))


def description(found: Column) -> Column:
    return measured(meta(found, "description"), 120, 160)


def headings(html: Column) -> Column:
    """Texts of h1 to h6, empty ones dropped, and counts; ok with a single h1."""
    found = {f"h{i}": F.filter(F.transform(tags.matches(closed(html, f"h{i}"), f"<h{i}", BODY[f"h{i}"], 1), lambda x: trim(decode(strip_tags(x)))), lambda x: x != "") for i in range(1, 7)}
    counted = lambda h: F.struct(*[h[n].alias(n) for n in found], *[F.size(h[f"h{i}"]).alias(f"h{i}_count") for i in (1, 2, 3)], (F.size(h["h1"]) == 1).alias("ok"))
    return let(F.struct(*[c.alias(n) for n, c in found.items()]), counted)


def canonical(html: Column) -> Column:
    found = let(tags.stretches(html, "<link"), lambda x: tags.value_beside(x, "href", f"rel={Q}canonical{Q}", 1))
    return let(found, lambda v: F.struct(v.alias("value"), v.isNotNull().alias("ok")))


def hreflang(html: Column) -> Column:
    """``{values,count}``: alternates with rel first, then those with hreflang first."""
    pairs = [tags.pairs(html, "<link", p, ("lang", "href")) for p in HREFLANG]
    return let(F.concat(*pairs), lambda v: F.struct(v.alias("values"), F.size(v).alias("count")))


def open_graph(found: Column) -> Column:
    names = ("title", "description", "image", "type", "url")
    return let(F.struct(*[meta(found, f"og:{n}").alias(n) for n in names]), lambda p: F.struct(*[p[n].alias(n) for n in names], (filled(p["title"]) & filled(p["description"])).alias("ok")))


def image_tags(html: Column) -> Column:
    """``array<struct<no_alt,src>>`` of the page's images; src is null where it has none."""

    def one(tag: Column) -> Column:
        alt = first(tag, f"(?i)[{WS}]alt=[\"']([^\"']*)[\"']")
        return F.struct((trim(F.coalesce(alt, F.lit(""))) == "").alias("no_alt"), first(tag, f"(?i)[{WS}]src=[\"']([^\"']+)[\"']").alias("src"))

    return F.transform(tags.matches(html, "<img", "[^>]*>"), one)


def image_facts(html: Column) -> Column:
    """Totals, images without alt text or source, and sources as written of the first five that lack alt text."""

    def facts(tags: Column) -> Column:
        bare = F.filter(tags, lambda t: t["no_alt"])
        samples = F.slice(F.filter(F.transform(bare, lambda t: t["src"]), lambda s: s.isNotNull()), 1, 5)
        return F.struct(F.size(tags).alias("total"), F.size(bare).alias("without_alt"), F.size(F.filter(tags, lambda t: t["src"].isNull())).alias("without_src"), samples.alias("samples"))

    return let(image_tags(html), facts)


def images(facts: Column, url: Column) -> Column:
    """image_facts() with the samples resolved against the page's URL."""
    return F.struct(facts["total"].alias("total"), facts["without_alt"].alias("without_alt"), facts["without_src"].alias("without_src"), urls.resolve_all(url, facts["samples"]).alias("samples_without_alt"), (facts["without_alt"] == 0).alias("ok"))


def raw_links(html: Column) -> Column:
    """``array<struct<href,anchor>>`` of links as written, without fragments of this page and non-web schemes."""
    text = lambda t: F.substring(trim(decode(strip_tags(t))), 1, 100)
    pairs = lambda head: F.transform(tags.pairs(head, "<a", LINK, ("href", "inner")), lambda p: F.struct(trim(p["href"]).alias("href"), text(p["inner"]).alias("anchor")))
    keep = lambda p: (p["href"] != "") & ~p["href"].rlike("^(?:" + "|".join(SKIPPED) + ")")
    return F.filter(let(closed(html, "a"), pairs), keep)


def links(raw: Column, url: Column) -> Column:
    """raw_links() resolved against the page's URL, in order, repeats kept; those that can't be are left out."""
    pairs = F.zip_with(urls.resolve_all(url, F.transform(raw, lambda p: p["href"])), raw, lambda h, p: F.struct(h.alias("href"), p["anchor"].alias("anchor")))
    return F.filter(pairs, lambda p: p["href"].isNotNull())


def split_links(found: Column, home: Column) -> Column:
    """Links by whether their origin is the page's, and their numbers."""
    marked = F.transform(found, lambda p: F.struct(p.alias("link"), F.coalesce(urls.origin(p["href"]) == home, F.lit(False)).alias("inside")))
    side = lambda rows, inside: F.transform(F.filter(rows, lambda r: r["inside"] == inside), lambda r: r["link"])
    both = let(marked, lambda rows: F.struct(side(rows, True).alias("internal"), side(rows, False).alias("external")))
    return let(both, lambda s: F.struct(s["internal"].alias("internal"), s["external"].alias("external"), F.size(s["internal"]).alias("internal_count"), F.size(s["external"]).alias("external_count")))


def word_count(html: Column) -> Column:
    """Words outside tags, scripts and styles."""
    for name in ("script", "style"):
        html = without_elements(html, name, ELEMENTS[name])
    return count(strip_tags(html, " "), f"[^{WS}]+")


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and noscript, white space collapsed."""
    for name, pattern in ELEMENTS.items():
        html = without_elements(html, name, pattern)
    return trim(F.regexp_replace(F.replace(strip_tags(html, " "), F.lit("&nbsp;"), F.lit(" ")), f"[{WS}]+", " "))


def technical(html: Column, found: Column) -> Column:
    """Viewport, charset, language and robots of a page whose meta_tags() are ``found``."""
    return F.struct(
        tags.marked(found, f"name={Q}viewport{Q}").alias("has_viewport"),
        tags.marked(found, "charset=").alias("has_charset"),
        tags.value(tags.stretches(html, "<html"), "lang", 1).alias("lang"),
        meta(found, "robots").alias("robots_meta"),
    )


def read_pages(pages: DataFrame) -> DataFrame:
    """The snapshot ``pages(site, seq, url, final_url, status, content_type, size_bytes, fetch_ms, error, html)`` with
    ``ok``, ``redirected`` and sizes filled in.

    A page is ok if it came with a 2xx status as HTML and without error; other content gets the error ``not_html`` and
    loses its html. A null site is the origin of the URL.
    """
    is_html = F.coalesce(F.col("content_type").contains("html"), F.lit(False))
    failed = F.col("error").isNotNull()
    p = pages.withColumn("url_std", urls.normalize("url"))
    return p.select(
        F.coalesce("site", urls.origin(F.col("url_std"))).alias("site"),
        "seq",
        "url",
        "final_url",
        F.coalesce(F.col("status").between(200, 299) & is_html & ~failed, F.lit(False)).alias("ok"),
        "status",
        F.coalesce(is_html & ~failed & (F.col("final_url") != F.col("url")), F.lit(False)).alias("redirected"),
        "fetch_ms",
        F.when(failed, None).when(is_html, F.coalesce(F.nullif("size_bytes", F.lit(0)), units(F.col("html")).cast("long"))).otherwise(F.nullif("size_bytes", F.lit(0))).alias("size_bytes"),
        "content_type",
        F.when(failed, F.col("error")).when(~is_html, "not_html").alias("error"),
        F.when(~failed, urls.params(F.col("url_std"))).alias("url_params"),
        urls.origin(F.col("url_std")).alias("own_origin"),
        F.when(is_html & ~failed, F.col("html")).alias("html"),
    )


def page_records(snapshot: DataFrame) -> DataFrame:
    """read_pages() with the parsed record in place of html; fields of pages without html are null.

    ``html`` stays as the last column, for the scores that read it; drop it before anything shuffles.
    """
    html, url = F.col("html"), F.col("url")
    there = F.coalesce(html, F.lit("")) != ""
    raw = snapshot.withColumns({"raw": F.when(there, raw_links(html)), "image_facts": F.when(there, image_facts(html)), "meta_list": F.when(there, meta_tags(html))})
    found = F.col("meta_list")
    linked = raw.withColumn("link_list", links(F.col("raw"), url))
    signal = {
        "title": title(html),
        "meta": description(found),
        "headings": headings(html),
        "canonical": canonical(html),
        "hreflang": hreflang(html),
        "open_graph": open_graph(found),
        "twitter_card": meta(found, "twitter:card"),
        "images": images(F.col("image_facts"), url),
        "links": split_links(F.col("link_list"), F.col("own_origin")),
        "word_count": word_count(html),
        "html_length": units(html),
        "technical": technical(html, found),
    }
    keep = [c for c in snapshot.columns if c not in ("html", "own_origin")]
    return linked.select(*keep, urls.page_type(url).alias("page_type"), *[F.when(there, c).alias(n) for n, c in signal.items()], "html")


def link_edges(records: DataFrame) -> DataFrame:
    """A row ``(site, seq, src_url, pos, href, anchor, kind)`` for each link of each record, internal ones first."""
    each = lambda kind: F.transform(f"links.{kind}", lambda x: F.struct(x["href"].alias("href"), x["anchor"].alias("anchor"), F.lit(kind).alias("kind")))
    rows = records.select("site", "seq", F.col("url").alias("src_url"), F.posexplode(F.concat(each("internal"), each("external"))).alias("pos", "l"))
    return rows.select("site", "seq", "src_url", "pos", "l.href", "l.anchor", "l.kind")
