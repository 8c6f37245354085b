"""Queries of the site-audit operators over the fixture, by name, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import audit_fixture as fixture
from pagelens.functions import urls
from pagelens.functions.text import half_up
from pagelens.operators import citability, discovery, jsonld, llmstxt, page, pagespeed, quick, site
from pagelens.plans import audit

Query = Callable[[SparkSession, str], DataFrame]


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.spark_table(spark, sf_dir, fixture.PAGES)


def as_of():
    return F.lit(fixture.AS_OF).cast("timestamp")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page.page_records(page.read_pages(pages(spark, sf_dir)))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonld.with_structured_data(records(spark, sf_dir)).where(F.col("html").isNotNull())


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.complete_records(pages(spark, sf_dir), as_of()).persist()


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow records, kept: html is parsed once for all the branches of a report, and no filter slips under the scores."""
    return site.slim(audit.complete_records(pages(spark, sf_dir), as_of())).persist()


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.spark_table(spark, sf_dir, fixture.SITEMAPS)


def aux_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture.spark_table(spark, sf_dir, fixture.AUX_FILES)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagespeed.read_reports(fixture.spark_table(spark, sf_dir, fixture.REPORTS))


def _join(column, by: str = "|"):
    return F.array_join(column, by)


def _select(df: DataFrame, **columns) -> DataFrame:
    return df.select("seq", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- pages ----


@query
def page_source(spark, sf_dir):
    return page.read_pages(pages(spark, sf_dir)).select("site", "seq", "ok", "status", "redirected", "size_bytes", "error", "fetch_ms")


@query
def page_title(spark, sf_dir):
    return _select(records(spark, sf_dir), title="title.value", length="title.length", is_ok="title.ok")


@query
def page_meta(spark, sf_dir):
    return _select(records(spark, sf_dir), description="meta.value", length="meta.length", is_ok="meta.ok", robots="technical.robots_meta", card="twitter_card")


@query
def page_headings(spark, sf_dir):
    return _select(records(spark, sf_dir), h1=_join("headings.h1"), h2=_join("headings.h2"), h3=_join("headings.h3"), h4=_join("headings.h4"), h1_count="headings.h1_count", h2_count="headings.h2_count", h3_count="headings.h3_count", is_ok="headings.ok")


@query
def page_canonical(spark, sf_dir):
    return _select(records(spark, sf_dir), canonical="canonical.value", is_ok="canonical.ok")


@query
def page_hreflang(spark, sf_dir):
    pairs = F.transform("hreflang.values", lambda x: F.concat(x["lang"], F.lit("="), x["href"]))
    return _select(records(spark, sf_dir), langs=_join(pairs), n="hreflang.count")


@query
def page_open_graph(spark, sf_dir):
    return _select(records(spark, sf_dir), og_title="open_graph.title", og_description="open_graph.description", og_image="open_graph.image", og_type="open_graph.type", is_ok="open_graph.ok")


@query
def page_images(spark, sf_dir):
    return _select(records(spark, sf_dir), total="images.total", without_alt="images.without_alt", without_src="images.without_src", samples=F.size("images.samples_without_alt"), is_ok="images.ok")


@query
def page_technical(spark, sf_dir):
    return _select(records(spark, sf_dir), viewport="technical.has_viewport", charset="technical.has_charset", lang="technical.lang", html_length="html_length")


@query
def page_word_count(spark, sf_dir):
    return _select(records(spark, sf_dir), words="word_count")


@query
def page_visible_text(spark, sf_dir):
    return _select(records(spark, sf_dir), visible=page.visible_text(F.col("html")))


@query
def page_record(spark, sf_dir):
    r = structured(spark, sf_dir)
    return _select(r, page_type="page_type", title="title.value", description_length="meta.length", h1_count="headings.h1_count", canonical="canonical.value", images="images.total", internal="links.internal_count", external="links.external_count", words="word_count", blocks="schema.count")


@query
def page_links(spark, sf_dir):
    return _select(records(spark, sf_dir), internal="links.internal_count", external="links.external_count", hrefs=_join(F.transform("links.internal", lambda x: x["href"])), anchors=_join(F.transform("links.external", lambda x: x["anchor"])))


@query
def link_edges(spark, sf_dir):
    return page.link_edges(records(spark, sf_dir)).select("site", "seq", "src_url", "pos", "href", "anchor", "kind")


# ---- URLs ----


@query
def url_dedupe(spark, sf_dir):
    raw = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("'all' AS site", "page_id AS seq", "url")
    again = raw.selectExpr("site", "seq + 1000000 AS seq", "concat(url, '#again') AS url")
    return site.dedupe(raw.unionByName(again)).select("seq", "clean_url")


@query
def url_target(spark, sf_dir):
    p = pages(spark, sf_dir).select("seq", F.when(F.col("seq") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url")).alias("typed"))
    return p.select("seq", urls.target(F.col("typed")).alias("target"), urls.origin(urls.normalize(urls.target(F.col("typed")))).alias("origin"))


@query
def url_params(spark, sf_dir):
    p = page.read_pages(pages(spark, sf_dir))
    return _select(p, has_params="url_params.has_params", n="url_params.param_count", params=_join("url_params.params"), tracking=_join("url_params.tracking_params"), fragment="url_params.has_fragment", depth="url_params.depth")


@query
def url_page_type(spark, sf_dir):
    return pages(spark, sf_dir).select("seq", urls.page_type(F.col("url")).alias("page_type"))


@query
def url_category(spark, sf_dir):
    return records(spark, sf_dir).select("seq", urls.category(urls.normalize("url"), F.col("word_count")).alias("category"))


@query
def url_asset(spark, sf_dir):
    p = pages(spark, sf_dir).select("seq", F.concat("url", F.element_at(F.array(*map(F.lit, ("", ".css", ".PNG?v=1", ".json", ".jsonx"))), (F.col("seq") % 5 + 1).cast("int"))).alias("link"))
    return p.select("seq", urls.is_asset(F.col("link")).alias("asset"))


# ---- quick audit ----


@query
def quick_html(spark, sf_dir):
    r = pages(spark, sf_dir).select("seq", quick.quick_html(F.col("html"), F.col("url")).alias("q"))
    return _select(r, title="q.title.value", title_ok="q.title.ok", description="q.meta_description.value", description_ok="q.meta_description.ok", canonical="q.canonical.value", h1=_join("q.headings.h1"), h2_count="q.headings.h2_count", h3_count="q.headings.h3_count", langs=_join("q.hreflang.values"), og_ok="q.open_graph.ok", card="q.twitter_card.value", images="q.images.total", without_alt="q.images.without_alt", images_ok="q.images.ok", https="q.technical.https", viewport="q.technical.has_viewport", charset="q.technical.has_charset", lang="q.technical.lang", robots="q.technical.robots_meta")


@query
def quick_links(spark, sf_dir):
    p = pages(spark, sf_dir).withColumn("home", urls.origin(urls.normalize("url")))
    r = p.select("seq", quick.quick_links(F.col("html"), F.col("url"), F.col("home")).alias("q"))
    return _select(r, internal="q.internal", external="q.external", total="q.total")


@query
def quick_schema(spark, sf_dir):
    r = pages(spark, sf_dir).select("seq", jsonld.quick_schema(jsonld.parse_blocks(jsonld.scripts(F.col("html")))).alias("q"))
    return _select(r, n="q.count", types=_join(F.array_sort("q.types")), has_article="q.has_article", has_organization="q.has_organization", has_faq="q.has_faq", has_howto="q.has_howto")


@query
def aux_file_facts(spark, sf_dir):
    f = quick.aux_facts(aux_files(spark, sf_dir))
    return f.select("site", F.col("robots.exists").alias("robots"), F.col("robots.facts.has_sitemap").alias("has_sitemap"), F.col("robots.facts.sitemap_url").alias("sitemap_url"), F.col("robots.facts.length").alias("robots_length"), F.col("sitemap.exists").alias("sitemap"), F.col("sitemap.facts.url_count").alias("url_count"), F.size("sitemap.facts.sample").alias("sample_size"), F.col("llms.exists").alias("llms"), F.col("llms.facts.content").alias("llms_content"))


@query
def quick_audit(spark, sf_dir):
    p = pages(spark, sf_dir)
    p = p.select("site", "url", "seq", "html", jsonld.quick_schema(jsonld.parse_blocks(jsonld.scripts(F.col("html")))).alias("schema"))
    speed = pagespeed.reduced_reports(reports(spark, sf_dir)).select("url", F.struct("mobile", "desktop", "summary").alias("pagespeed"), "errors")
    a = quick.quick_audit(p, aux_files(spark, sf_dir), speed)
    return a.select("url", F.col("html_analysis.title.value").alias("title"), F.col("links.total").alias("links"), F.col("schema.count").alias("blocks"), F.col("pagespeed.mobile.scores.performance").alias("performance"), F.col("robots.exists").alias("robots"), F.array_join("errors", "|").alias("errors"))


# ---- structured data ----


@query
def jsonld_types(spark, sf_dir):
    return _select(structured(spark, sf_dir), n="schema.count", types=_join(F.array_sort("schema.types")), has_organization="schema.has_organization", has_article="schema.has_article", has_product="schema.has_product", has_faq="schema.has_faq")


@query
def jsonld_flat(spark, sf_dir):
    b = structured(spark, sf_dir).select("seq", F.posexplode("parsed.blocks").alias("pos", "b"))
    return _select(b, pos="pos", invalid="b.invalid", type="b.type", context="b.context", fields=_join(F.array_sort(F.filter("b.fields", lambda f: ~f.startswith("@")))))


@query
def jsonld_validation(spark, sf_dir):
    v = structured(spark, sf_dir).select("seq", F.explode("verdicts").alias("v"))
    return _select(v, pos="v.index", type="v.type", valid="v.valid", errors=_join(F.array_sort("v.errors")), warnings=_join(F.array_sort("v.warnings")), aeo_issues=_join(F.array_sort("v.aeo_issues")), score="v.score", unknown_type="v.unknown_type")


@query
def jsonld_faq_howto(spark, sf_dir):
    v = structured(spark, sf_dir).select("seq", F.explode("verdicts").alias("v")).where("v.type in ('FAQPage', 'HowTo')")
    special = lambda p: F.filter(p, lambda e: e.rlike("^(?:FAQPage|HowTo): "))
    return _select(v, type="v.type", errors=_join(special("v.errors")), warnings=_join(special("v.warnings")))


@query
def jsonld_summary(spark, sf_dir):
    s = F.col("schema_validation.summary")
    return _select(structured(spark, sf_dir), total=s["total_blocks"], valid=s["valid_blocks"], invalid=s["invalid_blocks"], detected=_join(F.array_sort(s["detected_types"])), with_errors=_join(F.array_sort(s["types_with_errors"])))


@query
def aeo_score(spark, sf_dir):
    a = F.col("schema_validation.aeo")
    return _select(structured(spark, sf_dir), score=a["score"], rating=a["rating"], invalid=a["invalid_aeo_blocks"], weights=_join(F.transform(a["detected_types"], lambda t: t["weight"].cast("string"))))


@query
def missing_schemas(spark, sf_dir):
    m = structured(spark, sf_dir).select("seq", "page_type", F.explode("schema_validation.missing_schemas").alias("m"))
    return _select(m, page_type="page_type", type="m.type", priority="m.priority", fields=_join("m.example_fields"))


@query
def recommendations(spark, sf_dir):
    r = structured(spark, sf_dir).select("seq", F.posexplode("schema_validation.recommendations").alias("pos", "r"))
    return _select(r, pos="pos", priority="r.priority", category="r.category", type="r.schema_type", message="r.message", fields=_join("r.example_fields"))


# ---- citability ----


def _dimension(name: str) -> None:
    def run(spark, sf_dir):
        d = F.col(f"citability.dimensions.{name}")
        return _select(complete(spark, sf_dir).where("html_length is not null"), score=d["score"], signals=F.size(d["signals"]), gaps=F.size(d["gaps"]))

    run.__name__ = f"cit_{name}"
    query(run)


for _name in citability.WEIGHTS:
    _dimension(_name)


@query
def citability_score(spark, sf_dir):
    return _select(complete(spark, sf_dir).where("html_length is not null"), score="citability.score", rating="citability.rating")


@query
def citability_gaps(spark, sf_dir):
    g = complete(spark, sf_dir).select("seq", F.posexplode("citability.gaps").alias("pos", "g"))
    return _select(g, pos="pos", dimension="g.dimension", priority="g.priority", message="g.message")


# ---- sites ----


@query
def site_summary(spark, sf_dir):
    return site.summary(slim(spark, sf_dir))


@query
def status_breakdown(spark, sf_dir):
    return site.status_breakdown(slim(spark, sf_dir))


@query
def site_issues(spark, sf_dir):
    return site.issue_counts(slim(spark, sf_dir))


@query
def duplicate_titles(spark, sf_dir):
    return site.duplicates(slim(spark, sf_dir), F.col("title")).select("site", F.col("value").alias("title"), "count", _join("urls").alias("members"))


@query
def duplicate_metas(spark, sf_dir):
    return site.duplicates(slim(spark, sf_dir), F.col("description")).select("site", F.col("value").alias("description"), "count", _join("urls").alias("members"))


@query
def inbound_links(spark, sf_dir):
    return site.inbound_links(slim(spark, sf_dir)).select("site", "url", "inbound_count")


@query
def most_linked(spark, sf_dir):
    return site.most_linked(site.inbound_links(slim(spark, sf_dir)))


@query
def orphan_pages(spark, sf_dir):
    p = slim(spark, sf_dir)
    return site.orphans(p, site.inbound_links(p)).select("site", "seq", "url")


def _pages_with(name: str, issue: str, **columns) -> None:
    def run(spark, sf_dir):
        p = slim(spark, sf_dir)
        made = {n: c() if callable(c) else c for n, c in columns.items()}
        return _select(p.where(F.coalesce(site.issues_of(p)[issue], F.lit(False))), url="url", **made)

    run.__name__ = name
    query(run)


_pages_with("broken_pages", "broken_internal_links", status="status", error="error")
_pages_with("heavy_pages", "heavy_pages", size_kb=lambda: half_up(F.col("size_bytes") / 1024))
_pages_with("redirected_pages", "redirected_pages", target="final_url")
_pages_with("tracking_urls", "urls_with_tracking_params", params=lambda: _join("tracking"))
_pages_with("deep_urls", "deep_urls", depth="depth")
_pages_with("low_citability", "low_citability_pages", score="score")


@query
def schema_types_found(spark, sf_dir):
    return site.schema_types(slim(spark, sf_dir))


@query
def issue_samples(spark, sf_dir):
    p = slim(spark, sf_dir)
    s = site.issue_samples(p, site.orphans(p, site.inbound_links(p)))
    return s.select("site", "issue", "rank", "url", "detail")


@query
def site_report(spark, sf_dir):
    r = audit.site_report(slim(spark, sf_dir))
    return r.select("site", "pages_analyzed", "pages_ok", "total_bytes", "avg_citability_score", "missing_title", "title_too_long", "missing_schema", "images_without_alt", "duplicate_titles", "duplicate_metas", "total_internal_links", "orphan_pages_count", F.coalesce(F.col("most_linked_pages")[0]["inbound_count"], F.lit(0)).alias("top_inbound"), F.coalesce(F.size(F.map_keys("schema_types_found")), F.lit(0)).alias("n_types"))


@query
def crawl_report(spark, sf_dir):
    r = audit.crawl_report(pages(spark, sf_dir), sitemaps(spark, sf_dir), as_of())
    return r.select("site", "source", "total_discovered", "analyzed", "truncated", "pages_analyzed", "pages_ok", F.col("llms_txt_suggested.total_pages_categorized").alias("categorized"))


# ---- discovery ----


def crawlable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.crawlable(page.read_pages(pages(spark, sf_dir)))


@query
def sitemap_urls(spark, sf_dir):
    return discovery.sitemap_locs(sitemaps(spark, sf_dir)).select("site", "url", "is_index", "pos", "loc")


@query
def sitemap_expand(spark, sf_dir):
    e = discovery.expand(sitemaps(spark, sf_dir), "sitemap.xml")
    return e.select("site", F.array_join(F.transform("ord", lambda x: x.cast("string")), ".").alias("place"), "loc")


def _sources(spark: SparkSession, sf_dir: str, max_urls: int) -> DataFrame:
    return discovery.discover(crawlable(spark, sf_dir), sitemaps(spark, sf_dir), max_urls).groupBy("site", "source").agg(F.count(F.lit(1)).alias("n"))


@query
def discovery_source(spark, sf_dir):
    return _sources(spark, sf_dir, discovery.MAX_URLS)


@query
def sitemap_source(spark, sf_dir):
    found = _sources(spark, sf_dir, discovery.MAX_URLS)
    return found.select("site", "source", F.when(F.col("source") != "crawl", F.col("n")).alias("n"))


@query
def bfs_crawl(spark, sf_dir):
    return discovery.crawl(crawlable(spark, sf_dir), 1000).select("site", "url")


@query
def discovery_cap(spark, sf_dir):
    return discovery.discovery_report(discovery.discover(crawlable(spark, sf_dir), sitemaps(spark, sf_dir)))


# ---- llms.txt ----


@query
def llms_home(spark, sf_dir):
    return llmstxt.site_names(llmstxt.home_pages(slim(spark, sf_dir)))


@query
def llms_sections(spark, sf_dir):
    s = llmstxt.sections(llmstxt.categorized(slim(spark, sf_dir)))
    return s.select("site", "section", "rank", "seq", llmstxt.clean_title(F.col("title")).alias("title"))


@query
def llms_txt(spark, sf_dir):
    return llmstxt.render(slim(spark, sf_dir)).select("site", "content", "total_pages_categorized", _join("sections").alias("sections"))


# ---- page speed ----




@query
def ps_scores(spark, sf_dir):
    r = reports(spark, sf_dir).select("url", "strategy", pagespeed.scores(F.col("report")).alias("s"))
    return r.select("url", "strategy", F.col("s.performance").alias("performance"), F.col("s.seo").alias("seo"), F.col("s.best_practices").alias("best_practices"), F.col("s.accessibility").alias("accessibility"))


@query
def ps_metrics(spark, sf_dir):
    r = reports(spark, sf_dir).select("url", "strategy", pagespeed.lab_metrics(F.col("report")).alias("lab"), pagespeed.diagnostics(F.col("report")).alias("d"))
    named = [F.struct(F.lit(n).alias("metric"), F.col(f"{part}.{n}").alias("m")) for part, names in (("lab", pagespeed.METRICS), ("d", pagespeed.DIAGNOSTICS)) for n, _ in names]
    r = r.select("url", "strategy", F.col("d.network_requests_count").alias("requests"), F.explode(F.array(*named)).alias("x"))
    return r.select("url", "strategy", "requests", "x.metric", "x.m.value", "x.m.unit", "x.m.display", "x.m.score", "x.m.rating")


@query
def ps_field(spark, sf_dir):
    r = reports(spark, sf_dir).select("url", "strategy", pagespeed.field_data(F.col("report")).alias("f"))
    named = [F.struct(F.lit(n).alias("metric"), F.col(f"f.{n}").alias("m")) for n, _ in pagespeed.FIELD]
    r = r.select("url", "strategy", F.col("f.overall").alias("overall"), F.explode(F.array(*named)).alias("x"))
    return r.select("url", "strategy", "overall", "x.metric", "x.m.p75", "x.m.category")


@query
def ps_opportunities(spark, sf_dir):
    r = reports(spark, sf_dir).select("url", "strategy", F.posexplode(pagespeed.opportunities(F.col("report"))).alias("pos", "o"))
    return r.select("url", "strategy", "pos", F.col("o.id").alias("id"), F.col("o.title").alias("title"), F.col("o.score").alias("score"), F.col("o.savings_ms").alias("savings_ms"), F.col("o.affected_count").alias("affected"), F.col("o.rating").alias("rating"))


@query
def ps_failed_audits(spark, sf_dir):
    both = F.concat(*[F.transform(pagespeed.failed_audits(F.col("report"), keys), lambda a: F.struct(F.lit(n).alias("kind"), a["id"].alias("id"), a["affected_count"].alias("affected"), F.size(a["sample"]).alias("sampled"))) for n, keys in (("seo", pagespeed.SEO), ("a11y", pagespeed.ACCESSIBILITY))])  # noqa: B023
    r = reports(spark, sf_dir).select("url", "strategy", F.explode(both).alias("a"))
    return r.select("url", "strategy", "a.kind", "a.id", "a.affected", "a.sampled")


@query
def ps_summary(spark, sf_dir):
    s = F.col("summary")
    return pagespeed.reduced_reports(reports(spark, sf_dir)).select("url", s["scores_diff"]["performance"]["mobile"].alias("mobile"), s["scores_diff"]["performance"]["desktop"].alias("desktop"), s["cwv_status"]["mobile"].alias("cwv_mobile"), s["passes_cwv"]["mobile"].alias("passes_mobile"), s["passes_cwv"]["desktop"].alias("passes_desktop"), F.array_join("errors", "|").alias("errors"))


@query
def ps_record(spark, sf_dir):
    r = pagespeed.reduced_reports(reports(spark, sf_dir))
    return r.select("url", "client", "run_id", F.col("mobile").isNotNull().alias("has_mobile"), F.col("desktop").isNotNull().alias("has_desktop"), F.coalesce(F.size("mobile.opportunities"), F.lit(-1)).alias("opportunities"), F.coalesce(F.size("mobile.seo_issues"), F.lit(-1)).alias("seo_issues"))
