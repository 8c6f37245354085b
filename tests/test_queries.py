"""Queries against DuckDB on the smallest tables; the driver compares all of them on larger ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import audit_fixture
import audit_oracles
import audit_queries
from pagelens.operators import discovery, site
from pagelens.plans import audit

ORACLES = audit_oracles.oracle_sql()
CHECKED = [
    "page_source", "page_title", "page_meta", "page_headings", "page_images", "page_links", "link_edges", "url_params", "quick_html", "quick_links", "aux_file_facts", "jsonld_validation", "recommendations",
    "citability_score", "site_issues", "most_linked", "orphan_pages", "issue_samples", "site_report", "sitemap_expand", "bfs_crawl", "llms_txt", "ps_opportunities", "ps_summary",
    "missing_schemas", "citability_gaps", "duplicate_titles", "discovery_source", "discovery_cap", "crawl_report", "ps_metrics", "ps_field",
]


def plain(v):
    return format(v, ".9g") if isinstance(v, float) else str(v)


def agree(df, sf_dir, sql):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    r = c.execute(sql)
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(plain(x[c]) for c in sorted(cols)) for x in df.collect())
    assert got == sorted(tuple(plain(v) for _, v in sorted(zip(cols, x))) for x in r.fetchall()) and got


@pytest.mark.parametrize("name", CHECKED)
def test_agrees_with_sql(spark, sf_dir, name):
    agree(audit_queries.QUERIES[name](spark, sf_dir), sf_dir, ORACLES[name])
    spark.catalog.clearCache()


@pytest.mark.parametrize("most", [1, 3])
def test_discovery_stops_as_in_sql(spark, sf_dir, most):
    sql = audit_oracles.discovery_sql(most)
    found = discovery.discover(audit_queries.crawlable(spark, sf_dir), audit_queries.sitemaps(spark, sf_dir), most)
    agree(found.groupBy("site", "source").agg(F.count(F.lit(1)).alias("n")), sf_dir, sql["discovery_source"])
    agree(discovery.discovery_report(found, most), sf_dir, sql["discovery_cap"])
    report = audit.crawl_report(audit_queries.pages(spark, sf_dir), audit_queries.sitemaps(spark, sf_dir), audit_queries.as_of(), most)
    columns = ["site", "source", "total_discovered", "analyzed", "truncated", "pages_analyzed", "pages_ok"]
    agree(report.select(*columns, F.col("llms_txt_suggested.total_pages_categorized").alias("categorized")), sf_dir, sql["crawl_report"])


@pytest.mark.parametrize("members", [None, 1, 3, 50])
def test_duplicates_count_all_and_list_the_first(spark, members):
    rows = [("s", i, f"u{i:02}", True, "a" if i % 2 else "b") for i in range(20)] + [("s", 20, "x", True, "alone"), ("s", 21, "y", False, "alone"), ("s", 22, "z", True, ""), ("s", 23, "z", True, None), ("t", 1, "w", True, "a")]
    p = spark.createDataFrame(rows, "site string, seq long, url string, ok boolean, title string")
    got = {(r["site"], r["value"]): (r["count"], r["urls"], r["first_seq"]) for r in site.duplicates(p, F.col("title"), members).collect()}
    odd, even = [f"u{i:02}" for i in range(1, 20, 2)], [f"u{i:02}" for i in range(0, 20, 2)]
    assert got == {("s", "a"): (10, odd[:members], 1), ("s", "b"): (10, even[:members], 0)}
    counts = site.duplicate_counts(p, titles=F.col("title"), urls=F.col("url")).collect()
    assert [tuple(r) for r in counts] == [("s", 2, 1)]


def test_registry():
    found = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(found) and set(CHECKED) <= set(found)


def test_partitioning_changes_nothing(spark, sf_dir):
    pages = audit_queries.pages(spark, sf_dir)
    as_of = F.lit(audit_fixture.AS_OF).cast("timestamp")
    report = lambda p: sorted(map(str, audit.site_report(site.slim(audit.complete_records(p, as_of)).persist()).collect()))
    assert report(pages.coalesce(1)) == report(pages.repartition(13))


def graph(spark, links, n):
    html = lambda i: "".join(f"<a href='/{j or ''}'>" for j in links.get(i, []))
    return spark.createDataFrame([("https://s.x", f"https://s.x/{i or ''}", "https://s.x/", html(i)) for i in range(n)], "site string, url string, start_url string, html string")


def plain_crawl(links, most):
    found, queue = [0], [(0, 0)]
    while queue and len(found) < most:
        at, depth = queue.pop(0)
        if depth > 2:
            continue
        for j in links.get(at, []):
            if j not in found:
                found.append(j)
                queue.append((j, depth + 1))
    return found


@pytest.mark.parametrize("most", [1, 2, 4, 6, 9, 100])
def test_crawl_stops_like_a_queue(spark, most):
    links = {0: [1, 2, 1, 3], 1: [4, 0, 5], 2: [6, 4], 3: [7], 4: [8, 9], 6: [10], 7: [11, 3], 8: [12], 12: [13]}
    got = [int(r["url"].rsplit("/", 1)[1] or 0) for r in discovery.crawl(graph(spark, links, 14), most).orderBy("ord").collect()]
    assert got == plain_crawl(links, most)


def test_sites_are_cut_at_the_library_s_cap(spark, monkeypatch):
    links = {0: list(range(1, 121))}
    monkeypatch.setattr(audit_queries, "crawlable", lambda spark, _: graph(spark, links, 121))
    monkeypatch.setattr(audit_queries, "sitemaps", lambda spark, _: spark.createDataFrame([], "site string, url string, xml string"))
    r = audit_queries.discovery_cap(spark, "").collect()
    assert [(x["total_discovered"], x["analyzed"], x["truncated"]) for x in r] == [(121, 100, True)]
