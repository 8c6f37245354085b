"""Fetched pages and companion tables that the driver's tables lack, derived from ``pages`` alike in Spark and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-06-30 00:00:00"

#: (site, seq, url, final_url, status, content_type, size_bytes, fetch_ms, error, html) of every page.
PAGES = """
WITH a AS (
  SELECT page_id AS k, url AS raw_url, html AS raw_html, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site FROM PAGES_SRC),
b AS (
  SELECT a.*, row_number() OVER (PARTITION BY site ORDER BY k) AS rn FROM a WHERE site <> ''),
c AS (
  SELECT b.*, CASE WHEN rn = 1 THEN site || '/' ELSE site ||
    CASE k % 10 WHEN 0 THEN '/blog/' WHEN 1 THEN '/product/' WHEN 2 THEN '/faq/' WHEN 3 THEN '/contact/' WHEN 4 THEN '/about/' WHEN 5 THEN '/privacy/'
      WHEN 6 THEN '/a/b/c/d/' WHEN 7 THEN '/' WHEN 8 THEN '/für/' ELSE '/en/' END || 'p' || CAST(k - k % 2 * (k % 40 - k % 20) AS STRING) ||
    CASE k % 6 WHEN 1 THEN '?utm_source=feed' WHEN 2 THEN '#top' WHEN 3 THEN '?page=2&ref=x&a=1' WHEN 4 THEN '/' WHEN 5 THEN '.html' ELSE '' END END AS url FROM b),
d AS (
  SELECT c.*, lead(url) OVER (PARTITION BY site ORDER BY k) AS next_url,
    CASE WHEN k % 19 = 4 THEN 'A rather long title that goes on and on, well over sixty characters | Brand'
      WHEN k % 17 = 5 THEN '' WHEN k % 8 IN (1, 2) THEN 'Shared title of the whole site | Brand' ELSE regexp_extract(raw_html, '<title>([^<]*)</title>', 1) END AS title,
    CASE WHEN k % 8 = 4 THEN rpad('Shared description ', 130, 'sd ')
      ELSE rpad('Page ' || CAST(k AS STRING) || CASE WHEN k % 6 = 2 THEN ' &amp;lt;b' ELSE '' END || ' ' || substr(raw_url, 9, 20) || ' ',
        CASE k % 4 WHEN 0 THEN 119 WHEN 1 THEN 120 WHEN 2 THEN 160 ELSE 161 END, 'lorem ipsum ') END || CASE WHEN k % 7 = 3 THEN chr(39) || 's' ELSE '' END AS descr,
    CASE k % 12
      WHEN 1 THEN '{"@context":"https://schema.org","@type":"Organization","name":"Org","url":"https://o.example/","logo":"l.png","sameAs":["https://x.example"],"contactPoint":{},"description":"d"}'
      WHEN 2 THEN '{"@context":"https://schema.org","@graph":[{"@type":"Organization","name":"Org","sameAs":[]},{"@type":"WebSite","name":"W","url":"u"},{"@type":"BreadcrumbList","itemListElement":[1]}]}'
      WHEN 3 THEN '{"@context":"http://schema.org","@type":"Article","headline":"H","datePublished":"2024-01-01","image":"i"}'
      WHEN 4 THEN '{"@type":"Organization","name":'
      WHEN 5 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q","acceptedAnswer":{"@type":"Answer","text":"T"}}]}</script><script type="application/ld+json">{"@context":"https://schema.org","@type":"Person","name":"P","jobTitle":" "}'
      WHEN 6 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"@type":"Question","name":"Q"},{"@type":"Thing"}]}'
      WHEN 7 THEN '{"@context":"https://schema.org","@type":"HowTo","name":"N","step":[{"@type":"HowToStep","text":"do"}],"totalTime":"PT1M"}'
      WHEN 8 THEN '{"@context":"https://schema.org","@type":"HowTo","name":"N","step":{"@type":"Step"}}'
      WHEN 9 THEN '{"@context":"https://example.org/ctx","@type":"Spaceship","name":"S"}'
      WHEN 10 THEN '{"@type":"LocalBusiness","name":"L","address":"A","telephone":0}'
      WHEN 11 THEN '[{"@context":"https://schema.org","@type":["Product","Thing"],"name":"P","offers":{}},{"@context":["https://schema.org","x"],"@type":"BlogPosting","headline":"H","author":"A","datePublished":"D"}]'
      END AS ld FROM c),
e AS (
  SELECT d.*,
    CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 6 = 1 THEN '<meta content="' || descr || '" name="description">' ELSE '<meta name="description" content="' || descr || '">' END ELSE '' END ||
    CASE WHEN k % 3 <> 0 THEN CASE WHEN k % 6 = 4 THEN '<link href="' || url || '" rel="canonical">' ELSE '<link rel="canonical" href="' || url || '">' END ELSE '' END ||
    CASE WHEN k % 4 = 0 THEN '<link rel="alternate" hreflang="de" href="/de"><link hreflang="es" rel="alternate" href="/es">' ELSE '' END ||
    CASE WHEN k % 3 = 1 THEN '<meta property="og:title" content="OG &amp; title"><meta property="og:description" content="OG text">' ||
      CASE WHEN k % 2 = 0 THEN '<meta property="og:image" content="/i.png">' ELSE '' END || '<meta name="twitter:card" content="summary">' ELSE '' END ||
    CASE WHEN k % 2 = 0 THEN '<meta name="viewport" content="width=device-width"><meta name="robots" content="index,follow">' ELSE '' END ||
    CASE WHEN ld IS NULL THEN '' ELSE '<script type="application/ld+json">' || ld || '</script>' END AS head,
    CASE WHEN k % 4 >= 1 THEN '<h2>' || CASE WHEN k % 7 = 1 THEN 'Why is it so?' ELSE 'Second <b>head</b>' END || '</h2>' ELSE '' END ||
    CASE WHEN k % 4 >= 2 THEN '<h2>More&nbsp;</h2><h3>Third</h3>' ELSE '' END || CASE WHEN k % 4 = 3 THEN '<h3>Fourth &amp; last</h3><h2> </h2>' ELSE '' END ||
    CASE WHEN k % 11 = 0 THEN '<h1>Again</h1>' ELSE '' END ||
    CASE WHEN k % 4 >= 1 THEN '<img src="/a.png" alt="a">' ELSE '' END || CASE WHEN k % 4 >= 2 THEN '<img src="b c.png" alt=" ">' ELSE '' END ||
    CASE WHEN k % 4 >= 3 THEN '<img alt=x src="/c.png"><img class="none">' ELSE '' END ||
    CASE WHEN k % 5 <> 0 AND next_url IS NOT NULL THEN '<a href="' || next_url || '">next <b>page</b></a>' || CASE WHEN k % 4 = 0 THEN '<a href="' || next_url || '">next again</a>' ELSE '' END ELSE '' END ||
    '<a href="/about">About &amp; us</a><a href="mailto:a@b.example">m</a><a href="#x">x</a><a href=" ">blank</a><a href="../x">up</a>' ||
    CASE WHEN k % 3 = 0 THEN '<a rel="nofollow" href="https://en.wikipedia.org/wiki/X">w</a>' ELSE '' END ||
    CASE WHEN k % 7 = 2 THEN '<a href="https://www.survey.com/x">s</a><a href="https://a.example/">a</a>' ELSE '' END ||
    CASE k % 4 WHEN 1 THEN '<p>Posted 2024-06-01.</p>' WHEN 2 THEN '<p>Fecha 15/09/2023 y 31-02-2024.</p>' WHEN 3 THEN '<p>Since 2020 we grew.</p>' ELSE '' END ||
    '<p>' || repeat('about 5% of it, ', CAST(k % 7 AS INT)) || 'end</p>' ||
    CASE k % 5 WHEN 0 THEN '<p>según Eurostat y Según Otro</p>' WHEN 1 THEN '<p>ÚLTIMA ACTUALIZACIÓN: hoy, por Ana María</p>' WHEN 2 THEN '<p>12 años de experiencia, Dr. X, CEO</p>' WHEN 3 THEN '<p>Our case studies vs. theirs; according to Bob</p>' ELSE '<p>from 2019 to 2023, 1.200.000 km</p>' END ||
    CASE k % 6 WHEN 0 THEN '<ul><li>a</li><li>b</li></ul><ol><li>c</li></ol>' WHEN 1 THEN '<table><tr><td>1</td></tr></table>' WHEN 2 THEN '<blockquote>q</blockquote>' WHEN 3 THEN '<dl><dt>t</dt><dd>d</dd></dl>'
      WHEN 4 THEN '<sup>[1]</sup>' ELSE '<div class="post-author">A</div><p>About the author</p><a rel="author" href="https://www.linkedin.com/in/a">li</a>' END AS body FROM d),
f AS (
  SELECT e.*, CASE WHEN k % 13 = 0 THEN replace(replace(raw_html, '<h1>', '<h4>'), '</h1>', '</h4>') ELSE raw_html END AS h FROM e)
SELECT site, k AS seq, url, CASE WHEN k % 9 = 2 THEN url || '-moved' ELSE url END AS final_url,
  CAST(CASE WHEN k % 20 = 7 THEN 404 WHEN k % 20 = 13 THEN 500 WHEN k % 20 = 17 THEN NULL ELSE 200 END AS INT) AS status,
  CASE WHEN k % 25 = 11 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CAST(CASE WHEN k % 2 = 0 THEN NULL WHEN k % 30 = 3 THEN 600000 ELSE 1000 + k END AS BIGINT) AS size_bytes, CAST(k % 900 AS BIGINT) AS fetch_ms,
  CASE WHEN k % 20 = 17 THEN 'timeout' END AS error,
  replace(replace(replace(h, '<title>' || regexp_extract(raw_html, '<title>([^<]*)</title>', 1) || '</title>', CASE WHEN k % 23 = 6 THEN '' ELSE '<title>' || title || '</title>' END), '</head>', head || '</head>'), '</body>', body || '</body>') AS html
FROM f
"""

#: (site, url, xml): a sitemap for half of the sites, an index for part of these, few locations for some.
SITEMAPS = """
WITH p AS (PAGES_SQL),
s AS (SELECT site, min(seq) AS k, count(*) AS n FROM p GROUP BY site),
j AS (SELECT p.site, p.url, p.seq, row_number() OVER (PARTITION BY p.site ORDER BY p.seq) AS r, s.k, s.n FROM p JOIN s ON p.site = s.site),
l AS (SELECT site, k, n, r % 2 AS part, 'LIST_AGG' AS locs FROM j GROUP BY site, k, n, r % 2)
SELECT site, CASE WHEN k % 4 = 0 THEN site || '/sub' || CAST(part AS STRING) || '.xml' WHEN part = 0 THEN site || '/sitemap.xml' ELSE site || '/sitemap_index.xml' END AS url,
  '<urlset>' || locs || '</urlset>' AS xml FROM l WHERE k % 2 = 0
UNION ALL
SELECT site, site || '/sitemap.xml', '<sitemapindex><sitemap><loc>' || site || '/sub1.xml</loc></sitemap><sitemap><loc> ' || site || '/sub0.xml </loc></sitemap></sitemapindex>' FROM s WHERE k % 4 = 0
"""

#: (site, kind, status, content)
AUX_FILES = """
WITH p AS (PAGES_SQL), s AS (SELECT site, min(seq) AS k FROM p GROUP BY site)
SELECT site, 'robots' AS kind, CAST(CASE WHEN k % 5 = 0 THEN 404 ELSE 200 END AS INT) AS status, 'User-agent: *' || CASE WHEN k % 2 = 0 THEN chr(10) || 'SITEMAP: ' || site || '/sitemap.xml' || chr(10) ELSE '' END AS content FROM s
UNION ALL SELECT site, 'sitemap', CAST(CASE WHEN k % 3 = 0 THEN 404 ELSE 200 END AS INT), '<urlset>' || repeat('<loc>' || site || '/a</loc>', CAST(k % 9 AS INT)) || '</urlset>' FROM s
UNION ALL SELECT site, 'llms', CAST(CASE WHEN k % 2 = 1 THEN 404 ELSE 200 END AS INT), '# ' || site FROM s WHERE k % 7 <> 0
"""

#: (url, strategy, client, run_id, raw)
REPORTS = """
WITH p AS (PAGES_SQL),
s AS (SELECT seq AS k, url, 'mobile' AS strategy FROM p UNION ALL SELECT seq + 3, url, 'desktop' FROM p WHERE seq % 7 <> 6)
SELECT url, strategy, 'acme' AS client, 'r1' AS run_id, CASE WHEN k % 11 = 5 THEN '{"error":{"message":"quota"}}' ELSE
  '{"lighthouseResult":{"finalUrl":"' || url || '","categories":{"performance":{"score":' || CAST(CAST(k % 101 AS DOUBLE) / 100 AS STRING) || '},"seo":{"score":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE '0.925' END || '},"best-practices":{"score":1}},' ||
  '"audits":{"largest-contentful-paint":{"title":"LCP","score":' || CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '0.5' WHEN 2 THEN '0.9' ELSE '0.25' END || ',"numericValue":' || CAST(1000 + k AS STRING) || '.5,"numericUnit":"millisecond","displayValue":"x"},' ||
  '"cumulative-layout-shift":{"title":"CLS","score":0.9,"numericValue":0.' || CAST(k % 10 AS STRING) || ',"numericUnit":"unitless"},"speed-index":{"title":"SI","score":0.89},' || CASE WHEN k % 5 = 0 THEN '"interactive":{"title":"TTI","numericValue":7,"numericUnit":"millisecond"},' ELSE '' END ||
  '"server-response-time":{"title":"TTFB","score":1,"numericValue":' || CAST(k % 50 AS STRING) || ',"numericUnit":"millisecond"},"dom-size":{"title":"DOM","score":0.4,"numericValue":' || CAST(k AS STRING) || ',"numericUnit":"element"},' ||
  '"unused-javascript":{"title":"JS","score":' || CASE WHEN k % 3 = 0 THEN '0.95' ELSE '0.5' END || ',"details":{"overallSavingsMs":' || CAST(k % 5 * 100 AS STRING) || ',"overallSavingsBytes":' || CAST(k % 3 * 50 AS STRING) || ',"items":[{"url":"u1","totalBytes":10,"wastedBytes":5},{"url":"u2"}]}},' ||
  '"unused-css-rules":{"title":"CSS","score":0.1,"details":{"overallSavingsMs":200,"items":[]}},"redirects":{"title":"R","score":0.4},' ||
  '"meta-description":{"title":"MD","score":' || CASE WHEN k % 2 = 0 THEN '0' ELSE '1' END || '},"image-alt":{"title":"IA","score":0,"details":{"items":[{"url":"a"},{"url":"b"},{"url":"c"},{"url":"d"}]}},"network-requests":{"title":"N","details":{"items":[{"url":"a"},{"url":"b"}]}}}}' ||
  CASE WHEN k % 6 = 1 THEN '' ELSE ',"loadingExperience":{"overall_category":"' || CASE k % 3 WHEN 0 THEN 'FAST' WHEN 1 THEN 'AVERAGE' ELSE 'SLOW' END || '","metrics":{"LARGEST_CONTENTFUL_PAINT_MS":{"percentile":' || CAST(2000 + k AS STRING) || ',"category":"AVERAGE"}' || CASE WHEN k % 2 = 0 THEN ',"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":' || CAST(k % 30 AS STRING) || ',"category":"FAST"},"INTERACTION_TO_NEXT_PAINT":{"percentile":200,"category":"SLOW"}' ELSE '' END || '}}' END || '}' END AS raw FROM s
"""


def duck(sql: str) -> str:
    """A fixture's text for DuckDB."""
    sql = sql.replace("PAGES_SQL", PAGES).replace("PAGES_SRC", "pages")
    return sql.replace("'LIST_AGG'", "string_agg('<loc>' || url || '</loc>', '' ORDER BY seq)").replace("AS STRING)", "AS VARCHAR)")


def spark_table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/pages.parquet").createOrReplaceTempView("audit_pages_src")
    listed = "array_join(transform(array_sort(collect_list(struct(seq, url))), x -> '<loc>' || x.url || '</loc>'), '')"
    return spark.sql(sql.replace("PAGES_SQL", PAGES).replace("PAGES_SRC", "audit_pages_src").replace("'LIST_AGG'", listed))
