"""Discovery over large sites: work that grows with a document's or a site's size, not with its square."""

from pyspark.sql import functions as F

from pagelens.operators import discovery

HOME = "https://big.example"


def test_locations_are_listed_without_their_text(spark):
    """The rows of a document's locations don't carry its text, which would be copied and searched for each of them."""
    n = 30_000
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.concat(F.lit(f"<loc> {HOME}/p"), k.cast("string"), F.lit("\n</loc>"))), ""), F.lit("</urlset>"))
    docs = spark.range(1).select(F.lit(HOME).alias("site"), F.lit(f"{HOME}/sitemap.xml").alias("url"), xml.alias("xml")).localCheckpoint()
    locs = discovery.sitemap_locs(docs)
    made, _, below = locs._jdf.queryExecution().optimizedPlan().toString().partition("Generate")
    assert below and "xml#" not in made + below.split("\n")[0]
    assert locs.where(~F.col("is_index") & (F.col("loc") == F.concat(F.lit(f"{HOME}/p"), F.col("pos").cast("string")))).count() == n == locs.count()


def test_sitemaps_and_starts_are_read_once(spark):
    """Both kinds of sitemap are followed over one reading of the documents; pages are read for their sites once and to crawl."""
    sitemaps = spark.createDataFrame([(HOME, f"{HOME}/sitemap.xml", "<loc>/1</loc>"), (HOME, f"{HOME}/sitemap_index.xml", "".join(f"<loc>{HOME}/{i}</loc>" for i in (3, 1, 2, 3)))], "site string, url string, xml string")
    pages = spark.createDataFrame([(s, f"{s}/", f"{s}/", '<a href="/a">a</a>') for s in (HOME, "https://c.example")], "site string, url string, start_url string, html string")
    read = {name: spark.sparkContext.accumulator(0) for name in ("sitemaps", "pages")}

    def counted(df, name):
        def run(batches):
            for b in batches:
                read[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    found = discovery.discover(counted(pages, "pages"), counted(sitemaps, "sitemaps")).orderBy("site", "ord").collect()
    assert [tuple(r) for r in found] == [(HOME, "sitemap_index", i, f"{HOME}/{n}") for i, n in enumerate((3, 1, 2))] + [("https://c.example", "crawl", i, f"https://c.example/{n}") for i, n in enumerate(("", "a"))]
    assert read["sitemaps"].value == 2 and read["pages"].value <= 4
