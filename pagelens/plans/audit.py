"""Whole audits: complete page records, site reports and crawl reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import settled
from ..operators import citability, discovery, jsonld, llmstxt, page, site


def complete_records(pages: DataFrame, as_of: Column) -> DataFrame:
    """A snapshot's pages with record, structured data and citability. Projections only; html is dropped at the end."""
    r = page.page_records(page.read_pages(pages))
    return citability.with_citability(jsonld.with_structured_data(r), as_of).drop("html", "parsed", "verdicts")


def site_report(p: DataFrame) -> DataFrame:
    """One row per site from slim records, persisted: summary, issues, samples, link graph and schema types.

    What pages say is counted by site, fact and key in one shuffle. Numbers, maps and lists are read off these counts and
    gathered in one aggregation by site, which gets a row a site of each number and the few rows of each list.
    """
    facts = settled(site.facts(p))  # counts; every part below reads them
    inbound = facts.where("fact = 'link'").select("site", F.col("key").alias("url"), F.col("n").alias("inbound_count"), "first")
    lost = site.orphans(p, inbound)
    shared = lambda kind: F.count_if((F.col("fact") == kind) & (F.col("n") > 1))
    parts = [
        facts.where("fact != 'status' and fact != 'type'").groupBy("site").agg(shared("title").alias("titles"), shared("description").alias("metas"), F.sum(F.when(F.col("fact") == "link", F.col("n"))).alias("links")),
        facts.where("fact = 'status'").select("site", F.struct("key", "n").alias("status")),
        facts.where("fact = 'type'").select("site", F.struct("key", "n").alias("type")),
        lost.groupBy("site").agg(F.count(F.lit(1)).alias("lost")),
        site.most_linked(inbound).select("site", F.struct("rank", "url", "inbound_count").alias("linked")),
        site.issue_samples(p, lost).select("site", F.struct("issue", "rank", "url", "detail").alias("sample")),
    ]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    listed = lambda c: F.when(F.count(c) > 0, F.array_sort(F.collect_list(c)))
    number = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    gathered = rows.groupBy("site").agg(
        F.map_from_entries(listed("status")).alias("status_breakdown"),
        number("titles", "duplicate_titles"),
        number("metas", "duplicate_metas"),
        number("links", "total_internal_links"),
        number("lost", "orphan_pages_count"),
        F.transform(listed("linked"), lambda x: F.struct(x["url"].alias("url"), x["inbound_count"].alias("inbound_count"))).alias("most_linked_pages"),
        F.map_from_entries(listed("type")).alias("schema_types_found"),
        listed("sample").alias("samples"),
    )
    return site.summary_and_issues(p).join(gathered, "site", "left")  # each page has a status, so no site lacks a row


def crawl_report(pages: DataFrame, sitemaps: DataFrame, as_of: Column, max_urls: int = discovery.MAX_URLS) -> DataFrame:
    """Discovery facts, site report and suggested llms.txt of each site, over the discovered pages that were fetched."""
    found = settled(discovery.discover(discovery.crawlable(page.read_pages(pages)), sitemaps, max_urls))
    chosen = discovery.cap(found, max_urls).select("site", "url", F.col("ord").cast("bigint").alias("place"))
    kept = site.dedupe(pages).select("site", "seq", F.col("url").alias("own_url"), F.col("clean_url").alias("url")).join(chosen, ["site", "url"])
    snapshot = pages.join(kept.select("site", F.col("own_url").alias("url"), "seq"), ["site", "url", "seq"], "left_semi")
    p = settled(site.slim(complete_records(snapshot, as_of)))  # narrow; every branch reads it
    return discovery.discovery_report(found, max_urls).join(site_report(p), "site", "left").join(llmstxt.render(p).select("site", F.struct("content", "total_pages_categorized", "sections").alias("llms_txt_suggested")), "site", "left")
