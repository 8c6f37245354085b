"""URL discovery over stored documents: sitemaps, sitemap indexes and link crawls, for all sites at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.lineage import settled
from ..functions.order import numbered
from ..functions.text import every, let, trim
from ..functions.urls import is_asset, normalize, origin, resolve_all, strip_hash

LOC = "(?i)<loc>([^<]++)</loc>"
CRAWL_LINK = rf"[^>]+href={tags.Q}([^\"']+){tags.Q}"
CHILDREN, INDEX_DEPTH, CRAWL_DEPTH, ENOUGH, MAX_URLS = 10, 2, 2, 3, 100


def _location(inside: Column) -> Column:
    """Text of a location without white space around it; of nothing but white space the last character."""
    return let(trim(inside), lambda t: F.when(t == "", F.right(inside, F.lit(1))).otherwise(t))


def sitemap_locs(sitemaps: DataFrame) -> DataFrame:
    """``(site, url, is_index, pos, loc)``: the locations that each document of ``sitemaps(site, url, xml)`` lists.

    A document is read once: its rows are made of the list of its locations, not beside its text.
    """
    docs = sitemaps.select("site", "url", F.col("xml").rlike("(?i)<sitemap>").alias("is_index"), F.transform(every(F.col("xml"), LOC, 1), _location).alias("locs"))
    return docs.select("site", "url", "is_index", F.posexplode("locs").alias("pos", "loc"))


def expand(sitemaps: DataFrame, name: str, max_urls: int = MAX_URLS) -> DataFrame:
    """``(site, ord, loc)``: URLs of a site's document ``/<name>``, indexes followed, in document order.

    An index gives those of its first CHILDREN documents, down to INDEX_DEPTH; after a child that brings its index to
    twice ``max_urls``, no further child of that index is read. Documents that are missing give none.
    """
    return expand_all(sitemaps, [name], max_urls).select("site", "ord", "loc")


def expand_all(sitemaps: DataFrame, names: list[str], max_urls: int = MAX_URLS) -> DataFrame:
    """``(site, name, ord, loc)``: expand() of each of the documents ``names``. All documents are read once."""
    docs = sitemap_locs(sitemaps.dropDuplicates(["site", "url"]))
    docs = settled(docs.where(~F.col("is_index") | (F.col("pos") < CHILDREN)))
    named = [docs.where(F.col("url") == F.concat("site", F.lit(f"/{n}"))).select("site", F.lit(n).alias("name"), F.array("pos").alias("ord"), "is_index", "loc") for n in names]
    at = reduce(DataFrame.unionByName, named)
    leaves = at.where("not is_index")
    for _ in range(INDEX_DEPTH):
        at = at.where("is_index").select("site", "name", "ord", F.col("loc").alias("url")).join(docs, ["site", "url"]).select("site", "name", F.concat("ord", F.array("pos")).alias("ord"), "is_index", "loc")
        leaves = leaves.unionByName(at.where("not is_index"))
    leaves = settled(leaves.select("site", "name", "ord", "loc"))
    for level in range(INDEX_DEPTH, 0, -1):  # inner indexes stop first
        child, parent = F.slice("ord", 1, level), F.slice("ord", 1, level - 1)
        inside = F.size("ord") > level
        sizes = leaves.where(inside).groupBy("site", "name", child.alias("child")).agg(F.count(F.lit(1)).alias("n"), F.any_value(parent).alias("parent"))
        before = F.sum("n").over(W.partitionBy("site", "name", "parent").orderBy("child").rowsBetween(W.unboundedPreceding, -1))
        stopped = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") >= 2 * max_urls).select("site", "name", "child")
        leaves = settled(leaves.withColumn("child", F.when(inside, child)).join(stopped, ["site", "name", "child"], "left_anti").drop("child"))
    return leaves


def crawlable(snapshot: DataFrame) -> DataFrame:
    """Pages of read_pages() as a crawl sees them: standard URLs, each site's start, html of ok pages only."""
    url = F.coalesce(strip_hash(normalize("url")), F.col("url"))
    return snapshot.select("site", url.alias("url"), F.concat("site", F.lit("/")).alias("start_url"), F.when(F.col("ok"), F.col("html")).alias("html"))


def crawl(pages: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """``(site, ord, url)``: URLs found from each site's start, breadth first, of the same origin and no assets.

    ``pages(site, url, start_url, html)``: html of pages that came with a 2xx status. A page's links are followed while
    fewer than ``max_urls`` URLs were found before it; pages deeper than CRAWL_DEPTH aren't read. ``ord`` is the order
    of finding. Each round joins the new URLs with the links of their pages and leaves out those known; a running sum
    over the order of finding tells which pages were still read. What a round follows of a site, and so what its sums
    run over, is at most ``max_urls`` URLs and those of one page more.
    """
    return _walked(pages, pages.select("site", "start_url").distinct(), max_urls)


def _walked(pages: DataFrame, starts: DataFrame, max_urls: int) -> DataFrame:
    """crawl() from ``starts(site, start_url)``, the distinct ones of the pages."""
    base = pages.select("site", "url", F.when(F.coalesce("html", F.lit("")) != "", tags.matches(F.col("html"), "<a", CRAWL_LINK, 1)).alias("hrefs")).dropDuplicates(["site", "url"])
    links = base.select("site", "url", F.posexplode(resolve_all("url", "hrefs")).alias("pos", "href")).where("href is not null")
    links = links.select("site", F.col("url").alias("src"), "pos", strip_hash(F.col("href")).alias("href"), origin(F.col("href")).alias("o")).where((F.col("o") == F.col("site")) & ~is_asset(F.col("href"))).drop("o")
    links = settled(links)  # narrow; html isn't parsed again
    found = settled(starts.select("site", F.col("start_url").alias("url"), F.expr("cast(array() as array<int>)").alias("ord")).where("url is not null"))
    frontier = found
    for _ in range(CRAWL_DEPTH + 1):
        reach = frontier.join(links, (frontier.site == links.site) & (frontier.url == links.src)).select(frontier.site, F.concat("ord", F.array("pos")).alias("ord"), "href", "src")
        first = reach.groupBy("site", "href").agg(F.min(F.struct("ord", "src")).alias("f")).select("site", F.col("href").alias("url"), "f.ord", "f.src")
        new = settled(first.join(found.select("site", "url"), ["site", "url"], "left_anti"))
        seen = found.groupBy("site").agg(F.count(F.lit(1)).alias("known"))
        per_page = new.groupBy("site", "src").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("page_ord"))
        earlier = F.coalesce(F.sum("n").over(W.partitionBy("site").orderBy("page_ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        read = per_page.withColumn("earlier", earlier).join(seen, "site").where(F.col("earlier") + F.col("known") < max_urls).select("site", "src")
        frontier = settled(new.join(read, ["site", "src"], "left_semi").select("site", "url", "ord"))
        found = found.unionByName(frontier)
    order = W.partitionBy("site").orderBy(F.size("ord"), "ord")
    return found.select("site", (F.row_number().over(order) - 1).alias("ord"), "url")


def discover(pages: DataFrame, sitemaps: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """``(site, source, ord, url)``: each site's URLs from its sitemap, else its sitemap index, else a crawl.

    A sitemap counts from ENOUGH URLs on, repeats included; then URLs are cleaned of fragments and repeats, the first kept.
    URLs of a site are numbered over the cluster, so a site of millions of locations isn't one task's.
    """
    starts = settled(pages.select("site", "start_url").distinct())  # URLs are brought to their form but twice, here and to crawl
    names = {"sitemap.xml": "sitemap", "sitemap_index.xml": "sitemap_index"}
    parts = expand_all(sitemaps, list(names), max_urls)
    sizes = parts.groupBy("site").agg(*[F.count_if(F.col("name") == n).alias(f"n_{s}") for n, s in names.items()])
    enough = lambda s: F.when(F.col(f"n_{s}") >= ENOUGH, s)
    chosen = starts.select("site").distinct().join(sizes, "site", "left").select("site", F.coalesce(*map(enough, names.values()), F.lit("crawl")).alias("source"))
    chosen = settled(chosen)  # a row a site
    source = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("name"))
    listed = parts.withColumn("source", source).join(chosen, ["site", "source"]).select("site", "source", "ord", F.col("loc").alias("url"))
    crawled = chosen.where("source = 'crawl'").select("site")
    walked = _walked(pages.join(crawled, "site", "left_semi"), starts.join(crawled, "site", "left_semi"), max_urls).select("site", F.lit("crawl").alias("source"), F.array("ord").alias("ord"), "url")
    rows = listed.unionByName(walked)
    rows = rows.withColumn("url", F.coalesce(strip_hash(normalize("url")), F.col("url")))
    first = rows.groupBy("site", "source", "url").agg(F.min("ord").alias("found_at"))
    return numbered(first, "site", "found_at", "ord").select("site", "source", F.col("ord").cast("int").alias("ord"), "url")


def cap(discovered: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """The URLs to analyse: the first ``max_urls`` of each site."""
    return discovered.where(F.col("ord") < max_urls)


def discovery_report(discovered: DataFrame, max_urls: int = MAX_URLS) -> DataFrame:
    """``(site, source, total_discovered, analyzed, truncated)``."""
    n = discovered.groupBy("site", "source").agg(F.count(F.lit(1)).alias("total_discovered"))
    return n.select("site", "source", "total_discovered", F.least("total_discovered", F.lit(max_urls)).alias("analyzed"), (F.col("total_discovered") > max_urls).alias("truncated"))
