"""Sites of any size: numbers over the cluster, one count of facts for a report, texts read once."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import audit_queries
from pagelens.functions.order import numbered
from pagelens.functions.text import END, START
from pagelens.operators import citability, discovery, site
from pagelens.plans import audit


def test_numbers_of_groups(spark):
    rows = [("a", [i]) for i in range(500)] + [("b", [0, i]) for i in range(3)] + [(None, [7]), (None, [8])]
    random.Random(1).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "g string, at array<int>").repartition(4), "g", "at", "place").collect()
    want = {(g, tuple(at)): at[-1] for g, at in rows if g} | {(None, (7,)): 0, (None, (8,)): 1}
    assert {(r["g"], tuple(r["at"])): r["place"] for r in got} == want and len(got) == len(rows)
    assert numbered(spark.createDataFrame([], "g string, at array<int>"), "g", "at", "place").columns == ["g", "at", "place"]
    assert not numbered(spark.createDataFrame([], "g string, at array<int>"), "g", "at", "place").collect()


def test_a_site_of_many_locations(spark):
    """An index of ten indexes of ten documents of 500 locations: all are found, in order."""
    index = lambda names: "<sitemap></sitemap>" + "".join(f"<loc>{n}</loc>" for n in names)
    home = "https://big.example"
    top = [(home, f"{home}/sitemap.xml", index(f"{home}/i{i}.xml" for i in range(10)))]
    top += [(home, f"{home}/i{i}.xml", index(f"{home}/d{i}{j}.xml" for j in range(10))) for i in range(10)]
    leaves = spark.range(100, numPartitions=8).select(
        F.lit(home).alias("site"),
        F.format_string(f"{home}/d%02d.xml", "id").alias("url"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda k: F.concat(F.lit(f"<loc>{home}/p"), (F.col("id") * 500 + k).cast("string"), F.lit("</loc>"))), "").alias("xml"),
    )
    small = [("https://s.example", "https://s.example/sitemap.xml", "".join(f"<loc>https://s.example/{i}</loc>" for i in (3, 1, 2, 3)))]
    sitemaps = spark.createDataFrame(top + small, "site string, url string, xml string").unionByName(leaves)
    pages = spark.createDataFrame([(s, f"{s}/", f"{s}/", "") for s in (home, "https://s.example")], "site string, url string, start_url string, html string")
    found = discovery.discover(pages, sitemaps, 50_000).persist()
    big = found.where(F.col("site") == home)
    assert big.count() == 50_000 and not big.where(F.col("url") != F.concat(F.lit(f"{home}/p"), F.col("ord").cast("string"))).count()
    assert [(r["ord"], r["url"][-1]) for r in found.where("site like '%s.example'").orderBy("ord").collect()] == [(0, "3"), (1, "1"), (2, "2")]
    found.unpersist()


def test_one_group_lies_in_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be merged again
    try:
        rows = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").alias("at"))
        got = numbered(rows, "g", "at", "place").persist()
        assert got.where("place = at").count() == 20_000
        assert max(r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect()) < 20_000
        got.unpersist()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_report_equals_its_parts(spark, sf_dir):
    p = audit_queries.slim(spark, sf_dir)
    got = {r["site"]: r.asDict() for r in audit.site_report(p).collect()}
    inbound = site.inbound_links(p)
    lost = site.orphans(p, inbound)
    want = {s: {"status_breakdown": None, "duplicate_titles": 0, "duplicate_metas": 0, "total_internal_links": 0, "orphan_pages_count": 0, "most_linked_pages": None, "schema_types_found": None, "samples": None} for s in got}
    for r in site.status_breakdown(p).collect():
        want[r["site"]]["status_breakdown"] = {**(want[r["site"]]["status_breakdown"] or {}), r["status"]: r["pages"]}
    for r in site.schema_types(p).collect():
        want[r["site"]]["schema_types_found"] = {**(want[r["site"]]["schema_types_found"] or {}), r["type"]: r["pages"]}
    for r in site.duplicate_counts(p, duplicate_titles=F.col("title"), duplicate_metas=F.col("description")).collect():
        want[r["site"]] |= r.asDict()
    for r in inbound.collect():
        want[r["site"]]["total_internal_links"] += r["inbound_count"]
    for r in lost.collect():
        want[r["site"]]["orphan_pages_count"] += 1
    for r in sorted(site.most_linked(inbound).collect(), key=lambda r: r["rank"]):
        want[r["site"]]["most_linked_pages"] = [*(want[r["site"]]["most_linked_pages"] or []), (r["url"], r["inbound_count"])]
    for r in sorted(site.issue_samples(p, lost).collect(), key=lambda r: (r["issue"], r["rank"])):
        want[r["site"]]["samples"] = [*(want[r["site"]]["samples"] or []), (r["issue"], r["rank"], r["url"], r["detail"])]
    spark.catalog.clearCache()
    assert len(got) > 10 and any(w["schema_types_found"] for w in want.values())
    for s, w in want.items():
        have = {k: got[s][k] for k in w if k != "site"}
        for k in ("most_linked_pages", "samples"):
            have[k] = have[k] and [tuple(x) for x in have[k]]
        assert have == {k: v for k, v in w.items() if k != "site"}, s


@pytest.mark.parametrize("seed", range(3))
def test_dates_as_plain_patterns_find_them(spark, seed):
    """Dates from stretches of digits are those that the three patterns find in the whole text."""
    r = random.Random(seed)
    parts = ["2024", "2023-11-05", "5/6/2021", "31-12-2020", "20", "1", "-", "/", " ", "_", "a", "é", ".", "99", "2019-1", "12/12/2012/2013", "2024-02-31"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(0, 14))) for _ in range(3000)]
    iso, dmy, year = (re.compile(START + x + END) for x in (r"(20[0-9][0-9])-([0-9][0-9])-([0-9][0-9])", r"([0-9]{1,2})[/-]([0-9]{1,2})[/-](20[0-9][0-9])", r"(20[0-9][0-9])"))

    def plain(t):
        found = [(y, m, d) for y, m, d in iso.findall(t)] + [(y, m, d) for d, m, y in dmy.findall(t)] + [(y, "1", "1") for y in year.findall(t)]
        return [tuple(map(int, x)) for x in found if 1 <= int(x[1]) <= 12 and 1 <= int(x[2]) <= 31]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", citability.dates(F.col("t")).alias("d")).collect()
    for row in rows:
        want = [date(y, m, 1) + timedelta(d - 1) for y, m, d in plain(texts[row["i"]])]
        assert row["d"] == want, texts[row["i"]]


def test_paragraphs_are_measured_as_one_by_one(spark):
    """The average length of paragraphs is that of each one's own text, whatever stands between brackets."""
    r = random.Random(5)
    parts = ["<p>", "</p>", "<P class=x>", "<>", "<", ">", "a < b", "<b>", "text ", "😀", "<p", "</P>", "x" * 250]
    pages = ["".join(r.choice(parts) for _ in range(r.randrange(0, 24))) for _ in range(2000)]
    own = re.compile(rf"<p{END}[^>]*>[\s\S]*?</p>", re.I)
    heads = F.expr("named_struct('h1_count', 1, 'h2_count', 2, 'h3_count', 2)")
    got = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string").select("i", citability.structure(F.col("html"), heads).alias("s")).collect()
    for row in got:
        found = own.findall(pages[row["i"]])
        lengths = [len(re.sub("<[^>]+>", "", p).encode("utf-16-le")) // 2 for p in found]
        average = sum(lengths) / len(lengths) if lengths else None
        assert ("Párrafos cortos (escaneables)" in row["s"]["signals"]) == (average is not None and average < 300), pages[row["i"]]
        assert any(g["priority"] == "low" for g in row["s"]["gaps"]) == (average is not None and average > 600)
