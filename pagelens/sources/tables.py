"""Sources with fixed schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "site string, seq bigint, url string, final_url string, status int, content_type string, size_bytes bigint, fetch_ms bigint, error string, html string"
SITEMAPS = "site string, url string, xml string"
AUX_FILES = "site string, kind string, status int, content string"
REPORTS = "url string, strategy string, client string, run_id string, raw string"
#: Files that a report partitioned by site may have; beyond it sites share files by hash.
MAX_PARTITIONS = 1000


def read_table(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A stored table (parquet, json or orc) with its schema given, so nothing is inferred; missing columns are null."""
    return spark.read.format(form).schema(schema).load(path)


def write_report(report: DataFrame, path: str, form: str = "json", by_site: bool = False) -> None:
    """A report table as json or parquet; ``by_site`` lays out a folder for each site, for few sites only."""
    if by_site and report.select("site").distinct().limit(MAX_PARTITIONS + 1).count() > MAX_PARTITIONS:
        by_site = False
    writer = report.repartition("site").write if by_site else report.write
    (writer.partitionBy("site") if by_site else writer).format(form).save(path)


def write_texts(files: DataFrame, path: str) -> None:
    """``files(site, content)`` as one text file a site, in a folder of the site's name, each ending in one line feed."""
    files.select("site", F.regexp_replace("content", "\n$", "").alias("content")).repartition("site").write.partitionBy("site").text(path)
