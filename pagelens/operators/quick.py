"""The quick audit of single URLs: a lenient page profile and facts of auxiliary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags, urls
from ..functions.text import WS, closed, every, filled, first, let, strip_tags, trim, units
from .page import BODY, Q, measured


def _text(s: Column) -> Column:
    return F.regexp_replace(strip_tags(s), f"[{WS}]+", " ")


def _meta(html: Column, key: str, name: str) -> Column:
    """Content of a meta tag whose attributes stand side by side, key first."""
    return first(html, f"(?i)<meta[{WS}]+{key}=[\"']{name}[\"'][{WS}]+content=[\"']([^\"']*)[\"']")


def quick_html(html: Column, url: Column) -> Column:
    """The lenient record of a page, but for links and structured data; null without html."""
    found = {
        "title": trim(tags.first_body(html, "<title", "[^>]*>([^<]*)</title>")),
        "description": trim(_meta(html, "name", "description")),
        "canonical": trim(first(html, f"(?i)<link[{WS}]+rel=[\"']canonical[\"'][{WS}]+href=[\"']([^\"']*)[\"']")),
        **{f"h{i}": F.filter(F.transform(tags.matches(closed(html, f"h{i}"), f"<h{i}", BODY[f"h{i}"], 1), lambda x: trim(_text(x))), lambda x: x != "") for i in (1, 2, 3)},
        "langs": tags.matches(html, "<link", rf"[^>]+hreflang={Q}([^\"']+){Q}[^>]*>", 1),
        **{f"og_{n}": F.nullif(_meta(html, "property", f"og:{n}"), F.lit("")) for n in ("title", "description", "image", "type")},
        "card": F.nullif(_meta(html, "name", "twitter:card"), F.lit("")),
        "images": tags.matches(html, f"<img[{WS}]", "[^>]*>"),
    }
    technical = F.struct(
        url.startswith("https://").alias("https"),
        html.rlike(f"(?i)<meta[{WS}]+name=[\"']viewport[\"']").alias("has_viewport"),
        html.rlike(f"(?i)<meta[{WS}]+charset=").alias("has_charset"),
        tags.value(tags.stretches(html, "<html"), "lang", 1).alias("lang"),
        _meta(html, "name", "robots").alias("robots_meta"),
    )

    def record(f: Column) -> Column:
        heads, og = {f"h{i}": f[f"h{i}"] for i in (1, 2, 3)}, {n: f[f"og_{n}"] for n in ("title", "description", "image", "type")}
        total, bare = F.size(f["images"]), F.size(F.filter(f["images"], lambda t: ~t.rlike(f"(?i)[{WS}]alt[{WS}]*=")))
        return F.struct(
            measured(f["title"], 10, 70).alias("title"),
            measured(f["description"], 50, 165).alias("meta_description"),
            F.struct(f["canonical"].alias("value"), filled(f["canonical"]).alias("ok")).alias("canonical"),
            F.struct(*[c.alias(n) for n, c in heads.items()], *[F.size(c).alias(f"{n}_count") for n, c in heads.items()], (F.size(heads["h1"]) == 1).alias("ok")).alias("headings"),
            F.struct(f["langs"].alias("values"), F.size(f["langs"]).alias("count"), (F.size(f["langs"]) >= 1).alias("ok")).alias("hreflang"),
            F.struct(*[c.alias(n) for n, c in og.items()], (filled(og["title"]) & filled(og["description"]) & filled(og["image"])).alias("ok")).alias("open_graph"),
            F.struct(f["card"].alias("value"), filled(f["card"]).alias("ok")).alias("twitter_card"),
            F.struct(total.alias("total"), bare.alias("without_alt"), ((total > 0) & (bare == 0)).alias("ok")).alias("images"),
            technical.alias("technical"),
            units(html).alias("html_length"),
        )

    return F.when(filled(html), let(F.struct(*[c.alias(n) for n, c in found.items()]), record))


def quick_links(html: Column, url: Column, home: Column) -> Column:
    """Numbers of internal and external links; all zero where ``home``, the origin of the page's URL, is null."""
    hrefs = F.filter(tags.matches(html, f"<a[{WS}]", rf"[^>]*href={Q}([^\"']+){Q}", 1), lambda h: ~h.rlike("^(?:#|mailto:|tel:|javascript:)"))
    there = F.filter(urls.resolve_all(url, hrefs), lambda h: h.isNotNull())
    internal = F.when(home.isNull(), 0).otherwise(F.size(F.filter(there, lambda h: urls.origin(h) == home)))
    total = F.when(home.isNull(), 0).otherwise(F.size(there))
    return F.when(filled(html), F.struct(internal.alias("internal"), (total - internal).alias("external"), total.alias("total")))


def robots_facts(exists: Column, content: Column) -> Column:
    """Whether robots.txt names a sitemap, the first one, and its length; only ``exists`` where there is none."""
    site = first(content, f"(?i)sitemap:[{WS}]*([^{WS}]+)")
    return _facts(exists, site.isNotNull().alias("has_sitemap"), site.alias("sitemap_url"), units(content).alias("length"))


def sitemap_facts(exists: Column, content: Column) -> Column:
    locs = every(content, "(?i)<loc>([^<]+)</loc>", 1)
    return _facts(exists, F.size(locs).alias("url_count"), F.slice(locs, 1, 5).alias("sample"))


def llms_facts(exists: Column, content: Column) -> Column:
    return _facts(exists, units(content).alias("length"), content.alias("content"))


def _facts(exists: Column, *columns: Column) -> Column:
    return F.struct(F.coalesce(exists, F.lit(False)).alias("exists"), F.when(exists, F.struct(*columns)).alias("facts"))


def aux_facts(files: DataFrame) -> DataFrame:
    """One row per site from ``files(site, kind, status, content)`` with kinds robots, sitemap and llms.

    A file exists with a 2xx status; null content counts as empty. Of repeated files the one of the least status stays.
    """
    one = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct(F.coalesce("status", F.lit(999)).alias("status"), F.coalesce("content", F.lit("")).alias("content")))).alias(kind)
    f = files.groupBy("site").agg(*[one(k) for k in ("robots", "sitemap", "llms")])
    made = {"robots": robots_facts, "sitemap": sitemap_facts, "llms": llms_facts}
    return f.select("site", *[g(F.coalesce(F.col(k)["status"].between(200, 299), F.lit(False)), F.col(k)["content"]).alias(k) for k, g in made.items()])


def quick_audit(pages: DataFrame, files: DataFrame, speed: DataFrame) -> DataFrame:
    """One row per page of ``pages(site, url, html, schema)``: its record, its site's files and its speed report.

    ``speed(url, pagespeed, errors)``; equi-joins on url and site. What is missing is named in ``errors``, in the order
    speed, html.
    """
    no_html = F.when(~filled(F.col("html")), F.array(F.lit("HTML fetch: failed"))).otherwise(F.expr("cast(array() as array<string>)"))
    p = pages.withColumn("home", urls.origin(urls.normalize("url")))
    p = p.select("site", "url", quick_html(F.col("html"), F.col("url")).alias("html_analysis"), quick_links(F.col("html"), F.col("url"), F.col("home")).alias("links"), "schema", no_html.alias("no_html"))
    timeout = F.array(F.lit("PageSpeed mobile: timeout"), F.lit("PageSpeed desktop: timeout"))
    rows = p.join(speed.select("url", "pagespeed", "errors"), "url", "left").join(aux_facts(files), "site", "left")
    return rows.select("site", "url", "html_analysis", "links", "schema", "pagespeed", "robots", "sitemap", "llms", F.concat(F.coalesce("errors", timeout), "no_html").alias("errors"))
