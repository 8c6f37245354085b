"""Suggested llms.txt files: pages by section, capped and rendered, one text per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WS, filled, trim
from ..functions.urls import category, normalize, path

# Sections in order, with their headings and caps.
SECTIONS = [("main", "## Páginas principales", 10), ("products", "## Productos y servicios", 15), ("blog", "## Blog y recursos", 20), ("about", "## Información corporativa", None), ("optional", "## Optional", None)]


def clean_title(title: Column) -> Column:
    """A title without the brand after a bar or dash, at most 80 characters."""
    return F.substring(trim(F.regexp_extract(title, rf"^([\s\S]*?)(?:[{WS}]*[|—–][\s\S]*)?$", 1)), 1, 80)


def home_pages(p: DataFrame) -> DataFrame:
    """The page of each site that is its start, or else its first."""
    is_home = F.col("url").isin(F.col("site")) | (F.col("url") == F.concat("site", F.lit("/")))
    order = W.partitionBy("site").orderBy(F.desc(is_home), "seq", "url")
    return p.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def site_names(home: DataFrame) -> DataFrame:
    """``(site, name, description)`` from each site's home page."""
    host = F.regexp_extract("site", r"^[a-z]+://(?:www\.)?([^/:.]+)", 1)
    organization = F.when(F.array_contains(F.coalesce("types", F.expr("cast(array() as array<string>)")), "Organization"), F.col("title"))
    head = trim(F.regexp_extract("title", r"^([^—|–:-]*)", 1))
    name = F.coalesce(F.nullif(organization, F.lit("")), F.nullif(head, F.lit("")), F.concat(F.upper(F.substring(host, 1, 1)), F.substring(host, 2, 1000)))
    return home.select("site", name.alias("name"), F.coalesce(F.nullif("description", F.lit("")), F.nullif("og_description", F.lit("")), F.lit("")).alias("description"))


def categorized(p: DataFrame) -> DataFrame:
    """Ok pages with a title and their section; ``rank`` is the place in it, home pages first and last seen first."""
    std = normalize("url")
    rows = p.where(F.col("ok") & filled(F.col("title"))).select("site", "seq", "url", "title", "description", F.coalesce(category(std, F.col("word_count")), F.lit("main")).alias("section"), F.coalesce(path(std), F.lit("")).isin("", "/").alias("is_home"))
    order = W.partitionBy("site", "section").orderBy(F.desc("is_home"), F.when(F.col("is_home"), -F.col("seq")).otherwise(F.col("seq")), "url")
    return rows.withColumn("rank", F.row_number().over(order))


def sections(pages: DataFrame) -> DataFrame:
    """The pages that a file lists: categorized() within the sections' caps."""
    cap = F.lit(None).cast("int")
    for name, _, n in SECTIONS:
        cap = F.when(F.col("section") == name, n).otherwise(cap)
    return pages.where(cap.isNull() | (F.col("rank") <= cap))


def render(p: DataFrame) -> DataFrame:
    """``(site, content, total_pages_categorized, sections)``: a row for each site."""
    pages = categorized(p)
    listed = sections(pages)
    order = F.array_position(F.array(*[F.lit(n) for n, *_ in SECTIONS]), F.col("section")).cast("int")
    link = F.concat(F.lit("- ["), clean_title(F.col("title")), F.lit("]("), F.col("url"), F.lit(")"), F.when((F.col("section") != "optional") & filled(F.col("description")), F.concat(F.lit(": "), F.col("description"))).otherwise(""))
    lines = listed.groupBy("site", order.alias("o"), "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", link.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    heading = F.create_map(*[F.lit(x) for n, h, _ in SECTIONS for x in (n, h)])
    body = lines.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("o", F.concat(heading[F.col("section")], F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("text")))).alias("parts"))
    stats = pages.groupBy("site", "section").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.sum("n").alias("total"), F.collect_set("section").alias("there"))
    rows = site_names(home_pages(p)).join(body, "site", "left").join(stats, "site", "left")
    head = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.when(filled(F.col("description")), F.concat(F.lit("> "), "description", F.lit("\n\n"))).otherwise(""), F.concat(F.lit("URL: "), "site", F.lit("\n\n")))
    content = F.concat(trim(F.concat(head, F.coalesce(F.array_join(F.transform("parts", lambda x: x["text"]), "\n"), F.lit("")))), F.lit("\n"))
    named = F.filter(F.array(*[F.lit(n) for n, *_ in SECTIONS]), lambda s: F.coalesce(F.array_contains("there", s), F.lit(False)))
    return rows.select("site", content.alias("content"), F.coalesce("total", F.lit(0)).alias("total_pages_categorized"), named.alias("sections"))
