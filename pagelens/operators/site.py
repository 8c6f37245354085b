"""Site reports: issue counts, duplicates, the link graph and samples, one row or one small table per site.

Records are narrow here: html is gone before anything shuffles. First seen means by ``seq``, then URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import filled, half_up
from ..functions.urls import normalize, strip_hash

HEAVY_BYTES, DEEP, LOW_SCORE, SAMPLES, BROKEN_SAMPLES, TOP_LINKED = 500_000, 4, 40, 5, 10, 10


def slim(records: DataFrame) -> DataFrame:
    """What site reports need of complete records, without html."""
    return records.select(
        "site", "seq", "url", "final_url", "ok", "status", "redirected", "size_bytes", "error",
        F.col("url_params.tracking_params").alias("tracking"), F.col("url_params.depth").alias("depth"),
        F.col("title.value").alias("title"), F.col("title.length").alias("title_length"), F.col("meta.value").alias("description"), F.col("meta.length").alias("description_length"),
        F.col("headings.h1_count").alias("h1_count"), F.col("canonical.value").alias("canonical"), F.col("schema.count").alias("schema_count"), F.col("schema.types").alias("types"),
        F.col("images.total").alias("images"), F.col("images.without_alt").alias("images_without_alt"),
        F.col("citability.score").alias("score"), F.col("citability.gaps")[0]["message"].alias("top_gap"),
        F.col("open_graph.description").alias("og_description"), "word_count",
        F.transform("links.internal", lambda x: x["href"]).alias("internal"),
    )


def issues_of(p: DataFrame) -> dict[str, Column]:
    """Conditions, by issue, under which a page of slim() has it; null counts as false."""
    ok = F.col("ok")
    size = F.coalesce("size_bytes", F.lit(0))
    return {
        "missing_title": ok & ~filled(F.col("title")),
        "title_too_short": ok & filled(F.col("title")) & (F.col("title_length") < 30),
        "title_too_long": ok & (F.col("title_length") > 60),
        "missing_meta_description": ok & ~filled(F.col("description")),
        "meta_too_short": ok & filled(F.col("description")) & (F.col("description_length") < 120),
        "meta_too_long": ok & (F.col("description_length") > 160),
        "no_h1": ok & (F.col("h1_count") == 0),
        "multiple_h1": ok & (F.col("h1_count") > 1),
        "missing_canonical": ok & ~filled(F.col("canonical")),
        "missing_schema": ok & (F.col("schema_count") == 0),
        "broken_internal_links": broken(),
        "heavy_pages": ok & (size > HEAVY_BYTES),
        "redirected_pages": F.col("redirected"),
        "urls_with_tracking_params": F.size(F.coalesce("tracking", F.expr("cast(array() as array<string>)"))) > 0,
        "deep_urls": F.col("depth") > DEEP,
        "low_citability_pages": ok & (F.col("score") < LOW_SCORE),
    }


def broken() -> Column:
    return ~F.col("ok") & ((F.coalesce("status", F.lit(0)) >= 400) | filled(F.col("error")))


def summary(p: DataFrame) -> DataFrame:
    """Pages, bytes and average citability by site; averages are rounded, 0 where no page is ok."""
    return p.groupBy("site").agg(*_totals())


def _totals() -> list[Column]:
    ok = F.col("ok")
    size = F.when(ok, F.coalesce("size_bytes", F.lit(0)))
    return [
        F.count(F.lit(1)).alias("pages_analyzed"),
        F.count_if(ok).alias("pages_ok"),
        F.count_if(~ok).alias("pages_failed"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(half_up(F.avg(size)), F.lit(0)).cast("long").alias("avg_bytes_per_page"),
        F.coalesce(half_up(F.avg(F.when(ok, F.col("score")))), F.lit(0)).cast("long").alias("avg_citability_score"),
    ]


def _status() -> Column:
    return F.coalesce(F.nullif("status", F.lit(0)).cast("string"), F.lit("error"))


def status_breakdown(p: DataFrame) -> DataFrame:
    """``(site, status, pages)``; a missing status or 0 is ``error``."""
    return p.groupBy("site", _status().alias("status")).agg(F.count(F.lit(1)).alias("pages"))


def facts(p: DataFrame) -> DataFrame:
    """``(site, fact, key, n, first)``: how often a site's pages say something, and where first (``seq``, ``pos``).

    Of every page its ``status``; of ok pages each ``type`` of structured data, the ``title`` and ``description`` unless
    empty, and each internal ``link`` without fragment, repeats counted. One shuffle serves all reports, and rows are
    counted by task before it, so a title or link that is on every page costs a row a task.
    """
    fact = lambda kind, key, pos: F.struct(F.lit(kind).alias("fact"), key.alias("key"), pos.alias("pos"))
    none = F.expr("cast(array() as array<struct<fact:string,key:string,pos:int>>)")
    texts = F.filter(F.array(fact("title", F.col("title"), F.lit(0)), fact("description", F.col("description"), F.lit(0))), lambda x: filled(x["key"]))
    types = F.coalesce(F.transform("types", lambda t: fact("type", t, F.lit(0))), none)
    links = F.coalesce(F.transform("internal", lambda href, i: fact("link", strip_hash(href), i)), none)
    said = F.concat(F.array(fact("status", _status(), F.lit(0))), F.when(F.col("ok"), F.concat(texts, types, links)).otherwise(none))
    rows = p.select("site", "seq", F.inline(said))
    return rows.groupBy("site", "fact", "key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "pos")).alias("first"))


def issue_counts(p: DataFrame) -> DataFrame:
    """Pages with each issue by site, and image totals, in one pass; duplicates come from duplicates()."""
    return p.groupBy("site").agg(*_issues(p))


def summary_and_issues(p: DataFrame) -> DataFrame:
    """summary() and issue_counts() in one aggregation."""
    return p.groupBy("site").agg(*_totals(), *_issues(p))


def _issues(p: DataFrame) -> list[Column]:
    counts = [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in issues_of(p).items()]
    total = lambda n: F.coalesce(F.sum(F.when(F.col("ok"), F.col(n))), F.lit(0)).cast("long")
    return [*counts, total("images_without_alt").alias("images_without_alt"), total("images").alias("images_total")]


def duplicates(p: DataFrame, value: Column, members: int | None = None) -> DataFrame:
    """``(site, value, count, urls, first_seq)`` of values that several ok pages share, their URLs in order.

    All members are listed unless ``members`` bounds the list to the first ones (at least one); ``count`` is exact either
    way. With a bound no row and no task grows with a value that very many pages share: counts are summed by task, and
    of members each task sends its first ones.
    """
    rows = p.where(F.col("ok")).select("site", "seq", "url", value.alias("value")).where(filled(F.col("value")))
    listed = F.array_sort(F.collect_list(F.struct("seq", "url"))).alias("m")
    if members is None:
        groups = rows.groupBy("site", "value").agg(F.count(F.lit(1)).alias("count"), listed)
    else:
        ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("site", "value").orderBy("seq", "url")))
        counts = rows.groupBy("site", "value").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
        groups = counts.join(ranked.where(F.col("rank") <= members).groupBy("site", "value").agg(listed), ["site", "value"])
    return groups.where("count > 1").select("site", "value", "count", F.transform("m", lambda x: x["url"]).alias("urls"), F.col("m")[0]["seq"].alias("first_seq"))


def duplicate_counts(p: DataFrame, **values: Column) -> DataFrame:
    """Numbers of values by site that several ok pages share: a column for each name, all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("value")) for n, v in values.items()]))
    rows = p.where(F.col("ok")).select("site", each.alias("x")).select("site", "x.*").where(filled(F.col("value")))
    shared = rows.groupBy("site", "kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.groupBy("site").agg(*[F.count_if(F.col("kind") == n).alias(n) for n in values])


def inbound_links(p: DataFrame) -> DataFrame:
    """``(site, url, inbound_count, first)``: internal links of ok pages by target, fragments off, repeats counted."""
    edges = p.where(F.col("ok")).select("site", "seq", F.posexplode("internal").alias("pos", "href"))
    return edges.groupBy("site", strip_hash(F.col("href")).alias("url")).agg(F.count(F.lit(1)).alias("inbound_count"), F.min(F.struct("seq", "pos")).alias("first"))


def most_linked(inbound: DataFrame, n: int = TOP_LINKED) -> DataFrame:
    """The ``n`` targets of each site with the most links; ties by first sight."""
    order = W.partitionBy("site").orderBy(F.desc("inbound_count"), "first", "url")
    return inbound.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("site", "rank", "url", "inbound_count")


def orphans(p: DataFrame, inbound: DataFrame) -> DataFrame:
    """Ok pages but the site's root that no internal link leads to."""
    pages = p.where(F.col("ok") & (F.col("url") != F.col("site")) & (F.col("url") != F.concat("site", F.lit("/")))).select("site", "seq", "url")
    return pages.join(inbound.select("site", "url"), ["site", "url"], "left_anti")


def schema_types(p: DataFrame) -> DataFrame:
    """``(site, type, pages)``: ok pages by type of structured data."""
    return p.where(F.col("ok")).select("site", F.explode("types").alias("type")).groupBy("site", "type").agg(F.count(F.lit(1)).alias("pages"))


def issue_samples(p: DataFrame, orphan_pages: DataFrame, n: int = SAMPLES, n_broken: int = BROKEN_SAMPLES) -> DataFrame:
    """``(site, issue, rank, url, detail)``: the first pages of each site with each issue, at most ``n``."""
    details = {
        "multiple_h1": F.col("h1_count").cast("string"),
        "broken_internal_links": F.concat_ws(" ", F.nullif("status", F.lit(0)).cast("string"), "error"),
        "heavy_pages": half_up(F.col("size_bytes") / 1024).cast("string"),
        "redirected_pages": F.col("final_url"),
        "urls_with_tracking_params": F.array_join("tracking", ","),
        "low_citability_pages": F.concat_ws(": ", F.col("score").cast("string"), "top_gap"),
    }
    sampled = ("missing_title", "no_h1", "multiple_h1", "missing_meta_description", "missing_canonical", "missing_schema", *[k for k in details if k != "multiple_h1"])
    conditions = issues_of(p)
    found = F.array_compact(F.array(*[F.when(F.coalesce(conditions[i], F.lit(False)), F.struct(F.lit(i).alias("issue"), F.coalesce(details.get(i, F.lit("")), F.lit("")).alias("detail"))) for i in sampled]))
    rows = p.select("site", "seq", "url", F.explode(found).alias("i")).select("site", "i.issue", "seq", "url", "i.detail")
    rows = rows.unionByName(orphan_pages.select("site", F.lit("orphan_pages").alias("issue"), "seq", "url", F.lit("").alias("detail")))
    most = F.when(F.col("issue") == "broken_internal_links", n_broken).otherwise(n)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("site", "issue").orderBy("seq", "url")))
    return ranked.where(F.col("rank") <= max(n, n_broken)).where(F.col("rank") <= most).select("site", "issue", "rank", "url", "detail")


def dedupe(pages: DataFrame) -> DataFrame:
    """The first page of each site and URL, fragments off; URLs that are invalid count as they stand."""
    clean = F.coalesce(strip_hash(normalize("url")), F.col("url"))
    narrow = pages.select("site", "seq", "url").withColumn("clean_url", clean)
    order = W.partitionBy("site", "clean_url").orderBy("seq", "url")
    return narrow.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
