"""Page-speed reports reduced to what can be acted on: scores, metrics, field data, opportunities and failed audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up

_ITEM = "struct<url:string,totalBytes:double,wastedBytes:double,wastedMs:double,source:string,duration:double>"
_AUDIT = f"struct<title:string,score:double,numericValue:double,numericUnit:string,displayValue:string,details:struct<overallSavingsMs:double,overallSavingsBytes:double,items:array<{_ITEM}>>>"
RAW = (
    "lighthouseResult struct<finalUrl:string,categories:map<string,struct<score:double>>,audits:map<string," + _AUDIT + ">>, "
    "loadingExperience struct<overall_category:string,metrics:map<string,struct<percentile:double,category:string>>>, error struct<message:string>"
)
# Names of categories, metrics, field data and audits in the reports.
CATEGORIES = [("performance", "performance"), ("accessibility", "accessibility"), ("best_practices", "best-practices"), ("seo", "seo")]
METRICS = [("lcp", "largest-contentful-paint"), ("fcp", "first-contentful-paint"), ("cls", "cumulative-layout-shift"), ("tbt", "total-blocking-time"), ("si", "speed-index"), ("tti", "interactive"), ("ttfb", "server-response-time")]
DIAGNOSTICS = [("total_byte_weight", "total-byte-weight"), ("dom_size", "dom-size"), ("main_thread_work", "mainthread-work-breakdown"), ("bootup_time", "bootup-time")]
FIELD = [("lcp", "LARGEST_CONTENTFUL_PAINT_MS"), ("fcp", "FIRST_CONTENTFUL_PAINT_MS"), ("cls", "CUMULATIVE_LAYOUT_SHIFT_SCORE"), ("inp", "INTERACTION_TO_NEXT_PAINT"), ("ttfb", "EXPERIMENTAL_TIME_TO_FIRST_BYTE")]
OPPORTUNITIES = [
    "render-blocking-resources", "unused-javascript", "unused-css-rules", "unminified-javascript", "unminified-css", "modern-image-formats", "uses-optimized-images",
    "uses-responsive-images", "efficient-animated-content", "duplicated-javascript", "legacy-javascript", "redirects", "server-response-time", "uses-text-compression",
    "uses-long-cache-ttl", "uses-rel-preconnect", "font-display", "preload-lcp-image", "lcp-lazy-loaded", "third-party-summary",
]
SEO = ["meta-description", "document-title", "http-status-code", "link-text", "crawlable-anchors", "is-crawlable", "robots-txt", "image-alt", "hreflang", "canonical", "structured-data", "viewport"]
ACCESSIBILITY = ["color-contrast", "image-alt", "label", "link-name", "button-name", "document-title", "html-has-lang", "meta-viewport", "heading-order", "landmark-one-main", "duplicate-id-aria", "aria-required-attr", "aria-valid-attr"]
GOOD, FAIR = 0.9, 0.5


def read_reports(reports: DataFrame) -> DataFrame:
    """``reports(url, strategy, client, run_id, raw)`` with ``report`` parsed and ``failed`` telling why there is none."""
    r = reports.withColumn("report", F.from_json("raw", RAW))
    failed = F.when(F.col("report").isNull(), "timeout").when(F.col("report.error").isNotNull(), F.coalesce("report.error.message", F.lit("timeout")))
    return r.withColumn("failed", failed).withColumn("report", F.when(F.col("failed").isNull(), F.col("report"))).drop("raw")


def percent(score: Column) -> Column:
    return half_up(score * 100).cast("int")


def rating(score: Column) -> Column:
    return F.when(score >= GOOD, "good").when(score >= FAIR, "needs_improvement").when(score.isNotNull(), "poor")


def scores(report: Column) -> Column:
    return F.struct(*[percent(F.try_element_at(report["lighthouseResult"]["categories"], F.lit(key))["score"]).alias(name) for name, key in CATEGORIES])


def _audit(report: Column, key: str) -> Column:
    return F.try_element_at(report["lighthouseResult"]["audits"], F.lit(key))


def metric(a: Column) -> Column:
    return F.when(a.isNotNull(), F.struct(a["numericValue"].alias("value"), a["numericUnit"].alias("unit"), a["displayValue"].alias("display"), a["score"].alias("score"), rating(a["score"]).alias("rating")))


def lab_metrics(report: Column) -> Column:
    return F.struct(*[metric(_audit(report, key)).alias(name) for name, key in METRICS])


def diagnostics(report: Column) -> Column:
    items = _audit(report, "network-requests")["details"]["items"]
    return F.struct(*[metric(_audit(report, key)).alias(name) for name, key in DIAGNOSTICS], F.when(items.isNotNull(), F.size(items)).alias("network_requests_count"))


def field_data(report: Column) -> Column:
    m = report["loadingExperience"]["metrics"]
    one = lambda key: F.try_element_at(m, F.lit(key))
    parts = [F.when(one(key).isNotNull(), F.struct(one(key)["percentile"].alias("p75"), one(key)["category"].alias("category"))).alias(name) for name, key in FIELD]
    return F.when(m.isNotNull(), F.struct(*parts, report["loadingExperience"]["overall_category"].alias("overall")))


def _items(a: Column) -> Column:
    return F.coalesce(a["details"]["items"], F.expr(f"cast(array() as array<{_ITEM}>)"))


def opportunities(report: Column) -> Column:
    """Audits under GOOD, by time saved, then bytes, then their fixed order; at most five resources each."""

    def one(i: int, key: str) -> Column:
        a = _audit(report, key)
        resource = lambda x: F.struct(x["url"].alias("url"), x["totalBytes"].alias("total_bytes"), x["wastedBytes"].alias("wasted_bytes"), x["wastedMs"].alias("wasted_ms"), x["source"].alias("source"), x["duration"].alias("duration"))
        ms, size = a["details"]["overallSavingsMs"], a["details"]["overallSavingsBytes"]
        facts = F.struct(F.lit(key).alias("id"), a["title"].alias("title"), a["score"].alias("score"), rating(a["score"]).alias("rating"), ms.alias("savings_ms"), size.alias("savings_bytes"), a["displayValue"].alias("display"), F.transform(F.slice(_items(a), 1, 5), resource).alias("affected_resources"), F.size(_items(a)).alias("affected_count"))
        return F.when(a["score"] < GOOD, F.struct((-F.coalesce(ms, F.lit(0.0))).alias("ms"), (-F.coalesce(size, F.lit(0.0))).alias("bytes"), F.lit(i).alias("i"), facts.alias("o")))

    return F.transform(F.array_sort(F.array_compact(F.array(*[one(i, k) for i, k in enumerate(OPPORTUNITIES)]))), lambda x: x["o"])


def failed_audits(report: Column, keys: list[str]) -> Column:
    def one(key: str) -> Column:
        a = _audit(report, key)
        return F.when(a["score"] != 1, F.struct(F.lit(key).alias("id"), a["title"].alias("title"), a["score"].alias("score"), rating(a["score"]).alias("rating"), F.size(_items(a)).alias("affected_count"), F.slice(_items(a), 1, 3).alias("sample")))

    return F.array_compact(F.array(*[one(k) for k in keys]))


def strategy_record(report: Column) -> Column:
    """All of one strategy; null without a result."""
    parts = {"scores": scores(report), "field_data": field_data(report), "lab_metrics": lab_metrics(report), "opportunities": opportunities(report), "diagnostics": diagnostics(report), "seo_issues": failed_audits(report, SEO), "a11y_issues": failed_audits(report, ACCESSIBILITY)}
    return F.when(report["lighthouseResult"].isNotNull(), F.struct(*[c.alias(n) for n, c in parts.items()]))


def reduced_reports(reports: DataFrame) -> DataFrame:
    """``(url, client, run_id, mobile, desktop, summary, errors)``: one row per run from read_reports().

    The strategies of a run meet by grouping on its key; of repeated reports any one that came counts.
    """
    r = reports.select("url", "client", "run_id", "strategy", "failed", strategy_record(F.col("report")).alias("record"), F.col("report.loadingExperience.overall_category").alias("cwv"))
    pick = lambda s, c: F.any_value(F.when(F.col("strategy") == s, F.col(c)), ignoreNulls=True)
    there = lambda s: F.count_if((F.col("strategy") == s) & F.col("failed").isNull())
    g = r.groupBy("url", "client", "run_id").agg(*[f(s, c).alias(f"{s}_{c}") for s in ("mobile", "desktop") for f, c in ((pick, "record"), (pick, "cwv"), (pick, "failed"))], *[there(s).alias(f"{s}_n") for s in ("mobile", "desktop")])
    both = lambda f: F.struct(f("mobile").alias("mobile"), f("desktop").alias("desktop"))
    diff = F.struct(*[both(lambda s: F.col(f"{s}_record.scores.{n}")).alias(n) for n in ("performance", "seo", "accessibility", "best_practices")])  # noqa: B023
    summary = F.struct(diff.alias("scores_diff"), both(lambda s: F.col(f"{s}_cwv")).alias("cwv_status"), both(lambda s: F.coalesce(F.col(f"{s}_cwv") == "FAST", F.lit(False))).alias("passes_cwv"))
    error = lambda s: F.when(F.col(f"{s}_n") == 0, F.concat(F.lit(f"PageSpeed {s}: "), F.coalesce(f"{s}_failed", F.lit("timeout"))))
    return g.select("url", "client", "run_id", F.col("mobile_record").alias("mobile"), F.col("desktop_record").alias("desktop"), summary.alias("summary"), F.array_compact(F.array(error("mobile"), error("desktop"))).alias("errors"))
