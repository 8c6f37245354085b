"""DuckDB SQL for the queries of audit_queries.py, on the same fixture."""

from __future__ import annotations

import re

import audit_fixture as fixture

WS = r"\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
S = f"[{WS}]"
MAX_URLS = 100
# Fixed values, stated here once more: an error in the library's own tables shows as a difference.
SCRIPT = r"<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
SPECS = {
    "Organization": (["name"], ["url", "logo", "sameAs", "contactPoint", "description"], ["sameAs", "logo", "description"]),
    "LocalBusiness": (["name", "address"], ["telephone", "openingHours", "geo", "priceRange", "image", "url"], ["address", "telephone", "openingHours"]),
    "WebSite": (["name", "url"], ["potentialAction", "publisher"], ["potentialAction"]),
    "WebPage": (["name"], ["url", "description", "breadcrumb", "datePublished"], ["description"]),
    "Article": (["headline", "author", "datePublished"], ["image", "dateModified", "publisher", "mainEntityOfPage", "description"], ["author", "datePublished", "dateModified"]),
    "BlogPosting": (["headline", "author", "datePublished"], ["image", "dateModified", "publisher", "mainEntityOfPage", "description"], ["author", "datePublished", "dateModified"]),
    "NewsArticle": (["headline", "author", "datePublished", "image"], ["dateModified", "publisher", "description"], ["author", "datePublished", "publisher"]),
    "Product": (["name"], ["image", "description", "offers", "aggregateRating", "review", "brand", "sku"], ["description", "offers", "aggregateRating"]),
    "FAQPage": (["mainEntity"], [], ["mainEntity"]),
    "Question": (["name", "acceptedAnswer"], ["suggestedAnswer"], ["acceptedAnswer"]),
    "HowTo": (["name", "step"], ["image", "totalTime", "estimatedCost", "tool", "supply"], ["step", "totalTime"]),
    "BreadcrumbList": (["itemListElement"], [], ["itemListElement"]),
    "Person": (["name"], ["jobTitle", "worksFor", "sameAs", "url", "image", "description"], ["jobTitle", "worksFor", "sameAs"]),
    "Event": (["name", "startDate", "location"], ["endDate", "description", "image", "offers", "performer", "organizer"], ["startDate", "location", "description"]),
    "Recipe": (["name", "recipeIngredient", "recipeInstructions"], ["image", "author", "datePublished", "cookTime", "prepTime", "recipeYield", "nutrition"], ["recipeIngredient", "recipeInstructions", "cookTime"]),
    "VideoObject": (["name", "description", "thumbnailUrl", "uploadDate"], ["contentUrl", "embedUrl", "duration"], ["description", "uploadDate", "duration"]),
    "ImageObject": (["contentUrl"], ["caption", "creator", "license", "width", "height"], ["caption", "creator"]),
    "Course": (["name", "description", "provider"], ["offers", "aggregateRating", "hasCourseInstance"], ["description", "provider"]),
    "Review": (["reviewRating", "author"], ["datePublished", "reviewBody", "itemReviewed"], ["author", "reviewRating"]),
    "AggregateRating": (["ratingValue", "ratingCount"], ["bestRating", "worstRating"], ["ratingValue", "ratingCount"]),
    "Service": (["name", "provider"], ["description", "areaServed", "serviceType", "offers"], ["description", "areaServed"]),
    "SoftwareApplication": (["name"], ["applicationCategory", "operatingSystem", "offers", "aggregateRating"], ["applicationCategory", "description"]),
}
AEO_WEIGHTS = {"Organization": 10, "WebSite": 8, "Article": 10, "BlogPosting": 9, "NewsArticle": 10, "FAQPage": 10, "HowTo": 9, "Person": 8, "BreadcrumbList": 6, "Product": 8, "Review": 7, "LocalBusiness": 9, "Service": 7, "SoftwareApplication": 8, "Event": 7, "Course": 7, "Recipe": 6, "VideoObject": 6}
EXPECTED = [
    (None, ['Organization'], 'Organization', 'high', 'Identifica la entidad. Sin esto, LLMs no pueden verificar que el sitio represente una empresa real.', ['name', 'url', 'logo', 'sameAs', 'description']),
    (None, ['WebSite'], 'WebSite', 'medium', 'Permite a buscadores y LLMs entender la estructura del sitio. Habilita búsquedas internas vía SearchAction.', ['name', 'url', 'potentialAction']),
    (None, ['BreadcrumbList'], 'BreadcrumbList', 'medium', 'Da contexto jerárquico de cada página. Útil para entender de qué trata.', ['itemListElement']),
    ('blog|article|news', ['Article', 'BlogPosting', 'NewsArticle'], 'Article (o BlogPosting / NewsArticle)', 'high', 'Página de blog/artículo sin schema. LLMs no pueden citar autor, fecha o entidad publicadora.', ['headline', 'author', 'datePublished', 'image']),
    ('product|shop', ['Product'], 'Product', 'high', 'Página de producto sin schema. Pierde rich snippets de precio, rating y disponibilidad.', ['name', 'image', 'description', 'offers', 'aggregateRating']),
    ('faq|preguntas', ['FAQPage'], 'FAQPage', 'high', 'Página de FAQ sin schema. LLMs no pueden extraer Q&A para responder con citas literales.', ['mainEntity (con Questions)']),
    ('local|contact|store', ['LocalBusiness'], 'LocalBusiness', 'high', 'Negocio local sin schema. Pierde aparición en mapas, horarios y queries de "cerca de mí".', ['name', 'address', 'telephone', 'openingHours', 'geo']),
]
CITABILITY_WEIGHTS = {"freshness": 12, "authorship": 18, "factuality": 14, "structure": 12, "citations": 10, "expertise": 10, "machine_readable": 14, "answer_format": 10}
LLM_TYPES = ["Organization", "Article", "BlogPosting", "FAQPage", "HowTo", "Person", "Product"]
AUTHORITIES = (
    "wikipedia.org .gov .edu github.com arxiv.org nih.gov who.int oecd.org imf.org un.org reuters.com bloomberg.com nytimes.com wsj.com nature.com "
    "science.org sciencedirect.com mckinsey.com gartner.com forrester.com deloitte.com pwc.com kpmg.com ey.com bcg.com accenture.com statista.com "
    "forbes.com hbr.org mit.edu stanford.edu google.com/research developers.google.com mozilla.org w3.org rfc-editor.org ietf.org "
).split()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)}, 'i')"


def first(x: str, p: str, g: int = 1) -> str:
    return f"(CASE WHEN {has(x, p)} THEN regexp_extract({x}, {q(p)}, {g}, 'i') END)"


def every(x: str, p: str, g: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(p)}, {g}, 'i')"


def count(x: str, p: str) -> str:
    return f"len({every(x, p)})"


def sub(x: str, p: str, by: str) -> str:
    return f"regexp_replace({x}, {q(p)}, {q(by)}, 'gi')"


def trim(x: str) -> str:
    return sub(x, f"^{S}+|{S}+$", "")


def decode(x: str) -> str:
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def strip(x: str, by: str = "") -> str:
    return sub(x, "<[^>]+>", by)


def units(x: str) -> str:
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def meta(x: str, name: str) -> str:
    key = f"(?:name|property)=[\"']{name}[\"']"
    a = first(x, f"<meta[^>]+{key}[^>]*content=[\"']([^\"']*)[\"']")
    b = first(x, f"<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*{key}")
    return trim(decode(f"coalesce({a}, {b})"))


def heads(x: str, i: int) -> str:
    return f"list_filter(list_transform({every(x, f'<h{i}[^>]*>([\\s\\S]*?)</h{i}>', 1)}, x -> {trim(decode(strip('x')))}), x -> x <> '')"


def joined(x: str, by: str = "|") -> str:
    return f"array_to_string({x}, {q(by)})"


def visible(x: str) -> str:
    for tag in ("script", "style", "noscript"):
        x = sub(x, f"<{tag}[\\s\\S]*?</{tag}>", " ")
    return trim(sub(f"replace({strip(x, ' ')}, '&nbsp;', ' ')", f"{S}+", " "))


HTML = "content_type LIKE '%html%'"
ENCODE = "array_to_string(list_transform(string_split({x}, ''), c -> CASE WHEN c = ' ' THEN '%20' WHEN unicode(c) > 127 THEN url_encode(c) ELSE c END), '')"
WORDS = f"len(regexp_extract_all({strip(sub(sub('h', '<script[\\s\\S]*?</script>', ' '), '<style[\\s\\S]*?</style>', ' '), ' ')}, {q(f'[^{WS}]+')}))"

#: e: the fixture; s: the snapshot, h being html where a page has it.
BASE = f"""
WITH e AS ({fixture.duck(fixture.PAGES)}),
s AS (SELECT site, seq, url, replace(url, 'ü', '%C3%BC') AS std, final_url, status, fetch_ms, html AS raw,
  coalesce(status BETWEEN 200 AND 299 AND {HTML} AND error IS NULL, false) AS ok, error IS NULL AND {HTML} AND final_url <> url AS redirected,
  CASE WHEN error IS NOT NULL THEN NULL WHEN {HTML} THEN coalesce(nullif(size_bytes, 0), {units("html")}) ELSE nullif(size_bytes, 0) END AS size_bytes,
  CASE WHEN error IS NOT NULL THEN error WHEN NOT {HTML} THEN 'not_html' END AS error, error IS NOT NULL AS failed,
  CASE WHEN error IS NULL AND {HTML} THEN html END AS h FROM e)
"""
PARAMS = "list_filter(string_split(regexp_extract(std, '^[^?#]*\\?([^#]*)', 1), '&'), x -> x <> '')"
NAMES = f"list_transform({PARAMS}, x -> split_part(x, '=', 1))"
TRACKING = f"list_filter({NAMES}, x -> regexp_matches(x, '^(?:utm_|gclid|fbclid|mc_|_ga|sessionid|sid|ref)', 'i'))"
PATH = "regexp_extract({x}, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
DEPTH = f"len(list_filter(string_split({PATH.format(x='std')}, '/'), x -> x <> ''))"
CANONICAL = "coalesce({}, {})".format(first("h", "<link[^>]+rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)[\"']"), first("h", "<link[^>]+href=[\"']([^\"']+)[\"'][^>]*rel=[\"']canonical[\"']"))
TITLE = trim(decode(first("h", "<title[^>]*>([\\s\\S]*?)</title>")))
TAGS = every("h", "<img[^>]*>")
ALT = trim("coalesce({}, '')".format(first("x", f"{S}alt=[\"']([^\"']*)[\"']")))
PAGE_TYPE = """CASE WHEN regexp_matches(lower(url), '/blog/|/article/|/post/|/news/') THEN 'blog' WHEN regexp_matches(lower(url), '/product/|/shop/|/store/') THEN 'product'
  WHEN regexp_matches(lower(url), '/faq|/preguntas|/help') THEN 'faq' WHEN regexp_matches(lower(url), '/contact|/contacto|/store-locator') THEN 'local'
  WHEN regexp_matches(lower(url), '/about|/nosotros|/sobre') THEN 'about' ELSE 'home' END"""

#: l: links resolved, in order; b: JSON-LD scripts; t: types of a page.
LINKS = f""",
l0 AS (SELECT site, seq, url, std, ok, unnest({every("h", "<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</a>", 1)}) AS w, unnest({every("h", "<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</a>", 2)}) AS body,
  generate_subscripts({every("h", "<a[^>]+href=[\"']([^\"']+)[\"'][^>]*>([\\s\\S]*?)</a>", 1)}, 1) AS p FROM s WHERE h IS NOT NULL),
l1 AS (SELECT *, {trim("w")} AS href FROM l0),
l2 AS (SELECT site, seq, url, ok, p, substr({trim(decode(strip("body")))}, 1, 100) AS anchor,
  CASE WHEN href LIKE 'http%' THEN {ENCODE.format(x="href")} WHEN href LIKE '/%' THEN site || {ENCODE.format(x="href")}
    WHEN href = '../x' THEN site || regexp_replace(regexp_replace({PATH.format(x="std")}, '[^/]*$', ''), '[^/]+/$', '') || 'x' END AS href
  FROM l1 WHERE href <> '' AND NOT regexp_matches(href, '^(?:#|mailto:|tel:|javascript:)')),
l AS (SELECT *, regexp_extract(href, '^(https?://[^/?#]+)', 1) = site AS inside FROM l2)
"""
BLOCKS = f""",
b0 AS (SELECT seq, unnest({every("h", SCRIPT, 1)}) AS body, generate_subscripts({every("h", SCRIPT, 1)}, 1) AS i FROM s WHERE h IS NOT NULL),
b1 AS (SELECT seq, i, json_valid(body) AS good, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM b0),
b2 AS (SELECT seq, i, 1 AS n, NULL::JSON AS j, NULL::JSON AS ctx, true AS invalid FROM b1 WHERE NOT good
  UNION ALL SELECT seq, i, 1, j, j->'@context', false FROM b1 WHERE good AND json_type(j) = 'OBJECT' AND j->'@graph' IS NULL
  UNION ALL SELECT seq, i, g.n, j->('$."@graph"[' || g.n || ']'), j->'@context', false FROM b1, unnest(range(0, 3)) g(n) WHERE good AND json_type(j) = 'OBJECT' AND j->'@graph' IS NOT NULL
  UNION ALL SELECT seq, i, g.n, j->('$[' || g.n || ']'), j->('$[' || g.n || ']."@context"'), false FROM b1, unnest(range(0, 2)) g(n) WHERE good AND json_type(j) = 'ARRAY'),
b3 AS (SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY i, n) - 1 AS pos, invalid, j,
  CASE json_type(j->'@type') WHEN 'ARRAY' THEN j->>'$."@type"[0]' ELSE j->>'@type' END AS type,
  CASE json_type(ctx) WHEN 'ARRAY' THEN array_to_string(ctx::VARCHAR[], ' ') ELSE ctx->>'$' END AS context,
  list_filter(json_keys(j), k -> NOT (json_type(j->k) = 'NULL' OR json_type(j->k) = 'VARCHAR' AND trim(j->>k) = '' OR json_type(j->k) = 'ARRAY' AND json_array_length(j->k) = 0)) AS fields FROM b2 WHERE invalid OR j IS NOT NULL),
t0 AS (SELECT seq, pos, unnest(CASE json_type(j->'@type') WHEN 'ARRAY' THEN (j->'@type')::VARCHAR[] ELSE [j->>'@type'] END) AS type FROM b3 WHERE NOT invalid),
t AS (SELECT s.seq, coalesce(list_sort(list_distinct(list(t0.type) FILTER (t0.type IS NOT NULL))), []) AS types, (SELECT count(*) FROM b0 WHERE b0.seq = s.seq) AS blocks FROM s LEFT JOIN t0 ON t0.seq = s.seq WHERE s.h IS NOT NULL GROUP BY s.seq)
"""


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]::VARCHAR[]"


SPEC = ", ".join(f"({q(n)}, {_list(a)}, {_list(b)}, {_list(c)})" for n, (a, b, c) in SPECS.items())
HEAVY = ", ".join(f"({q(n)}, {w})" for n, w in AEO_WEIGHTS.items())
#: v: a verdict for each flattened block.
VERDICTS = f""",
spec(type, required, recommended, critical) AS (VALUES {SPEC}), heavy(type, weight) AS (VALUES {HEAVY}),
v0 AS (SELECT b3.*, spec.type IS NOT NULL AS known, coalesce(list_filter(required, f -> NOT list_contains(fields, f)), []) AS no_req, coalesce(list_filter(recommended, f -> NOT list_contains(fields, f)), []) AS no_rec,
  coalesce(list_filter(critical, f -> NOT list_contains(fields, f)), []) AS no_crit, greatest(len(required), 1) AS n_req, greatest(len(recommended), 1) AS n_rec,
  CASE WHEN j->'mainEntity' IS NULL THEN [] WHEN json_type(j->'mainEntity') = 'ARRAY' THEN (j->'mainEntity')::JSON[] ELSE [j->'mainEntity'] END AS faq,
  CASE WHEN j->'step' IS NULL THEN [] WHEN json_type(j->'step') = 'ARRAY' THEN (j->'step')::JSON[] ELSE [j->'step'] END AS steps FROM b3 LEFT JOIN spec ON spec.type = b3.type),
v1 AS (SELECT *,
  CASE WHEN type = 'FAQPage' THEN flatten(list_transform(faq, (x, k) -> CASE WHEN coalesce(x->>'@type', '') <> 'Question' THEN ['FAQPage: mainEntity[' || (k - 1) || '] debe ser @type=Question']
      ELSE CASE WHEN x->'name' IS NULL THEN ['FAQPage: Question[' || (k - 1) || '] sin "name" (la pregunta)'] ELSE [] END || CASE WHEN x->'acceptedAnswer' IS NULL THEN ['FAQPage: Question[' || (k - 1) || '] sin "acceptedAnswer"'] ELSE [] END END))
    WHEN type = 'HowTo' THEN flatten(list_transform(steps, (x, k) -> CASE WHEN x->'text' IS NULL THEN ['HowTo: step[' || (k - 1) || '] sin "text" ni "itemListElement"'] ELSE [] END)) ELSE []::VARCHAR[] END AS extra,
  CASE WHEN type = 'HowTo' THEN flatten(list_transform(steps, (x, k) -> CASE WHEN x->>'@type' NOT IN ('HowToStep', 'HowToSection') THEN ['HowTo: step[' || (k - 1) || '] debería ser @type=HowToStep o HowToSection'] ELSE [] END)) ELSE []::VARCHAR[] END AS extra_w,
  CASE WHEN coalesce(context, '') = '' THEN ['Falta @context'] WHEN NOT regexp_matches(context, 'schema\\.org', 'i') THEN ['@context no apunta a schema.org (encontrado: ' || substr(context, 1, 50) || ')'] ELSE []::VARCHAR[] END AS bad_ctx FROM v0),
v2 AS (SELECT *, CASE WHEN invalid THEN ['JSON-LD inválido (no se pudo parsear)'] ELSE bad_ctx || list_transform(no_req, f -> 'Falta campo requerido "' || f || '" en ' || type) || extra END AS errors,
  CASE WHEN invalid THEN []::VARCHAR[] WHEN known THEN list_transform(no_rec, f -> 'Falta campo recomendado "' || f || '" en ' || type) || extra_w ELSE ['Tipo "' || type || '" no está en nuestro catálogo (puede ser válido pero no validado en detalle)'] END AS warnings,
  list_transform(no_crit, f -> 'AEO: añadir "' || f || '" mejora citabilidad de ' || type) AS aeo FROM v1),
v AS (SELECT *, len(errors) = 0 AS valid, CASE WHEN invalid THEN 0.0::DOUBLE WHEN known THEN floor(((1 - len(no_req)::DOUBLE / n_req) * 0.7::DOUBLE + (1 - len(no_rec)::DOUBLE / n_rec) * 0.3::DOUBLE) * 100 + 0.5) / 100
  WHEN len(errors) = 0 THEN 0.5 ELSE 0.0 END AS score FROM v2)
"""
NAME = "[A-Z][a-záéíóúñ]+"
WORD = "[^A-Za-z0-9_]"


def bounded(p: str, left: bool = True, right: bool = True) -> str:
    return (r"\b" if left else "") + p + (r"\b" if right else "")


def _points(*steps: tuple) -> tuple[str, str, str]:
    """SQL for points, signals and gaps of a ladder of (condition, points, signal?, gap); a gap is a priority and SQL for its text, or 0."""

    def ladder(value) -> str:
        whens = " ".join(f"WHEN coalesce({s[0]}, false) THEN {value(s)}" for s in steps if s[0])
        last = next((value(s) for s in steps if not s[0]), value((None, 0, 0, 0)))
        return f"(CASE {whens} ELSE {last} END)"

    return ladder(lambda s: s[1]), ladder(lambda s: s[2]), ladder(lambda s: f"[({q(s[3][0])}, {s[3][1]})]" if s[3] else "[]")


def _any(*names: str) -> str:
    return f"list_has_any(types, {_list(list(names))})"


#: n days ago, by the fixture's as_of
AGE = f"list_transform(dates, d -> date_diff('day', d, DATE '{fixture.AS_OF[:10]}'))"
_N = f"({count('txt', r'\d+(?:\.\d+)?%')} + {count('txt', f'\\d{{1,3}}(?:[.,]\\d{{3}})+|\\$\\d+|€\\d+|\\d+{S}*(?:millones|billones|millions|billions)')} + {count('txt', f'\\d+(?:\\.\\d+)?{S}*(?:kg|km|mph|km/h|ms|s|gb|mb|tb)\\b')})"
_C = count("txt", f"seg[uú]n{S}+{NAME}|according{S}+to{S}+{NAME}|fuente:|source:")
_LISTS = f"({count('h', '<ul\\b')} + {count('h', '<ol\\b')})"
_AVG = f"list_avg(list_transform({every('h', '<p\\b[^>]*>[\\s\\S]*?</p>')}, x -> {units(strip('x'))}))"
_BY = has("txt", f"\\b(?:by|por){S}+{NAME}")
_FIT = "len(list_filter(types, x -> list_contains({}, x)))".format(_list(LLM_TYPES))
_SHORT = f"len(list_filter({every('h', '<li\\b[^>]*>[\\s\\S]*?</li>')}, x -> {units(strip('x'))} < 200))"
DIMENSIONS = {
    "freshness": [
        _points((f"len(list_filter({AGE}, x -> x BETWEEN 0 AND 90)) > 0", 60, 1, 0), (f"len(list_filter({AGE}, x -> x BETWEEN 0 AND 365)) > 0", 35, 1, 0), ("len(dates) > 0", 15, 0, ("medium", q("Fechas detectadas pero >1 año de antigüedad"))), (None, 0, 0, ("high", q("No se detectan fechas explícitas en el contenido visible")))),
        _points((_any("Article", "BlogPosting", "NewsArticle"), 25, 1, 0), (None, 0, 0, ("medium", q("No hay schema Article/BlogPosting con fechas estructuradas")))),
        _points((has("txt", f"última{S}+actualizaci[oó]n|last{S}+updated|updated{S}+on|actualizado{S}+el"), 15, 1, 0)),
    ],
    "authorship": [
        _points((_any("Person"), 35, 1, 0)),
        _points((_any("Article", "BlogPosting", "NewsArticle"), 20, 1, 0)),
        _points((has("h", "<[^>]+(?:class|id)=[\"'][^\"']*(?:author|byline|writer)[^\"']*[\"']"), 20, 1, 0), (_BY, 12, 1, 0), (has("h", "<a[^>]+rel=[\"']author[\"']"), 10, 0, 0), (None, 0, 0, ("high", q("No se detecta autor en el contenido")))),
        _points((has("txt", f"about{S}+the{S}+author|sobre{S}+el{S}+autor|biograf[íi]a"), 15, 1, 0), (f"{_BY} OR {_any('Person')}", 0, 0, ("medium", q("Hay autor pero falta bio visible")))),
        _points((has("h", r"linkedin\.com/in/|twitter\.com/|x\.com/"), 10, 1, 0)),
    ],
    "factuality": [
        _points((f"{_N} >= 5", 50, 1, 0), (f"{_N} >= 2", 30, 1, 0), (f"{_N} = 1", 10, 0, 0), (None, 0, 0, ("high", q("Pocos o ningún dato numérico verificable en el contenido")))),
        _points((has("txt", rf"\bvs\b|\bversus\b|comparado{S}+con|en{S}+comparación"), 15, 1, 0)),
        _points((f"{_C} >= 2", 25, 1, 0), (f"{_C} = 1", 12, 0, 0), (None, 0, 0, ("medium", q('No se detectan citas explícitas a fuentes ("según X")')))),
        _points((has("txt", rf"(?:entre|from|desde){S}+\d{{4}}{S}+(?:y|to|hasta|and){S}+\d{{4}}"), 10, 1, 0)),
    ],
    "structure": [
        _points(("n1 = 1", 20, 1, 0), (None, 0, 0, ("high", "CASE WHEN n1 = 0 THEN 'No hay H1 en la página' ELSE n1 || ' H1 detectados (debe ser 1)' END"))),
        _points(("n2 >= 2", 20, 1, 0), ("n2 = 1", 10, 0, 0), (None, 0, 0, ("medium", q("Falta jerarquía con H2")))),
        _points(("n3 >= 2", 15, 1, 0)),
        _points((f"{_LISTS} >= 3", 20, 1, 0), (f"{_LISTS} >= 1", 12, 1, 0), (None, 0, 0, ("medium", q("Sin listas en el contenido")))),
        _points((has("h", r"<table\b"), 15, 1, 0)),
        _points((f"{_AVG} < 300", 10, 1, 0), (f"{_AVG} > 600", 0, 0, ("low", q("Párrafos muy largos (>600 caracteres promedio)")))),
    ],
    "citations": [
        _points(("known >= 3", 60, 1, 0), ("known >= 1", 30, 1, 0), ("n_ext >= 3", 20, 1, 0), ("n_ext >= 1", 10, 0, 0), (None, 0, 0, ("medium", q("Sin enlaces externos a fuentes")))),
        _points((has("h", "<a[^>]+rel=[\"'][^\"']*nofollow"), 10, 1, 0)),
        _points((has("h", rf"<sup\b[^>]*>{S}*\[?\d+\]?{S}*</sup>|references|referencias|bibliograf[íi]a"), 30, 1, 0)),
    ],
    "expertise": [
        _points((has("txt", r"\b(?:PhD|MD|MBA|CFA|CPA|ingeniero|ingeniera|doctor|doctora|profesor|profesora|expert|certificado|certificada|founder|CEO|CTO|director|directora)\b"), 25, 1, 0)),
        _points(("n_about > 0", 20, 1, 0), (None, 0, 0, ("low", q("No se enlaza a página About/Equipo")))),
        _points((_any("Organization"), 20, 1, 0)),
        _points((has("txt", rf"\d+{S}+(?:años|years){S}+(?:de{S}+)?(?:experiencia|experience|en{S}+el{S}+mercado|in{S}+the{S}+industry)"), 15, 1, 0)),
        _points((has("txt", rf"casos{S}+de{S}+[ée]xito|case{S}+stud(?:y|ies)|testimoniales|testimonials"), 15, 1, 0)),
        _points((_any("Organization"), 10, 0, 0)),
    ],
    "machine_readable": [
        _points(("blocks >= 3", 35, 1, 0), ("blocks >= 1", 20, 1, 0), (None, 0, 0, ("high", q("Sin schema JSON-LD")))),
        _points((f"{_FIT} >= 2", 25, 1, 0), (f"{_FIT} = 1", 12, 0, 0)),
        _points((f"coalesce({meta('h', 'og:title')}, '') <> '' AND coalesce({meta('h', 'og:description')}, '') <> ''", 12, 1, 0)),
        _points((f"{units(meta('h', 'description'))} BETWEEN 120 AND 160", 8, 1, 0)),
        _points((f"{CANONICAL} IS NOT NULL", 8, 1, 0)),
        _points((has("h", "<html[^>]+lang=[\"']([^\"']+)[\"']"), 5, 1, 0)),
        _points(("n_lang >= 2", 7, 1, 0)),
    ],
    "answer_format": [
        _points((_any("FAQPage"), 50, 1, 0), (None, 0, 0, ("medium", q("Sin schema FAQPage")))),
        _points((_any("HowTo"), 25, 1, 0)),
        _points((has("h", r"<h[2-4][^>]*>[^<]*\?[^<]*</h[2-4]>"), 20, 1, 0)),
        _points((has("h", r"<dl\b[\s\S]*?</dl>"), 15, 1, 0)),
        _points((has("h", r"<blockquote\b"), 10, 1, 0)),
        _points((f"{_SHORT} >= 5", 10, 1, 0)),
    ],
}
_ISO, _DMY = r"\b(20\d\d)-(\d\d)-(\d\d)\b", r"\b(\d{1,2})[/-](\d{1,2})[/-](20\d\d)\b"


def _days(p: str, y: int, m: int, d: int) -> str:
    zipped = f"list_zip({every('txt', p, y)}, {every('txt', p, m)}, {every('txt', p, d)})"
    return f"list_transform(list_filter({zipped}, x -> x[2]::INT BETWEEN 1 AND 12 AND x[3]::INT BETWEEN 1 AND 31), x -> make_date(x[1]::INT, x[2]::INT, 1) + (x[3]::INT - 1))"


AUTHORITY = "|".join(a.replace(".", r"\.") for a in AUTHORITIES)
_PARTS = ", ".join(f"least(100, {' + '.join(p[0] for p in ps)}) AS {n}, {' + '.join(p[1] for p in ps)} AS {n}_signals, {' || '.join(p[2] for p in ps)} AS {n}_gaps" for n, ps in DIMENSIONS.items())
_TOTAL = " + ".join(f"{n} * {float(w)}::DOUBLE / 100" for n, w in CITABILITY_WEIGHTS.items())
_ALT_A, _ALT_B = (every("h", p, 1) for p in ("<link[^>]+rel=[\"']alternate[\"'][^>]+hreflang=[\"']([^\"']+)[\"'][^>]+href=[\"']([^\"']+)[\"']", "<link[^>]+hreflang=[\"']([^\"']+)[\"'][^>]+rel=[\"']alternate[\"'][^>]+href=[\"']([^\"']+)[\"']"))
_REF_A, _REF_B = (every("h", p, 2) for p in ("<link[^>]+rel=[\"']alternate[\"'][^>]+hreflang=[\"']([^\"']+)[\"'][^>]+href=[\"']([^\"']+)[\"']", "<link[^>]+hreflang=[\"']([^\"']+)[\"'][^>]+rel=[\"']alternate[\"'][^>]+href=[\"']([^\"']+)[\"']"))
#: c: citability of each page with html.
CITED = (
    LINKS
    + BLOCKS
    + f""",
k AS (SELECT seq, count(*) FILTER (NOT inside) AS n_ext, count(*) FILTER (NOT inside AND regexp_matches(href, {q(AUTHORITY)})) AS known, count(*) FILTER (inside AND regexp_matches(href, '/about|/sobre|/team|/equipo|/nosotros')) AS n_about FROM l GROUP BY seq),
x AS (SELECT s.site, s.seq, s.url, s.ok, h, types, blocks, coalesce(n_ext, 0) AS n_ext, coalesce(known, 0) AS known, coalesce(n_about, 0) AS n_about, {visible("h")} AS txt,
  len({heads("h", 1)}) AS n1, len({heads("h", 2)}) AS n2, len({heads("h", 3)}) AS n3, len({_ALT_A}) + len({_ALT_B}) AS n_lang FROM s JOIN t ON t.seq = s.seq LEFT JOIN k ON k.seq = s.seq),
y AS (SELECT *, {_days(_ISO, 1, 2, 3)} || {_days(_DMY, 3, 2, 1)} || list_transform({every("txt", r"\b(20\d\d)\b", 1)}, x -> make_date(x::INT, 1, 1)) AS dates FROM x),
z AS (SELECT site, seq, url, ok, {_PARTS} FROM y),
c AS (SELECT *, floor({_TOTAL} + 0.5)::INT AS score FROM z)
"""
)
#: m: what site reports need of a page.
SLIM = f""",
m AS (SELECT site, seq, url, std, final_url, ok, status, redirected, size_bytes, error, CASE WHEN failed THEN NULL ELSE {TRACKING} END AS tracking, CASE WHEN failed THEN NULL ELSE {DEPTH} END AS depth,
  {TITLE} AS title, {meta("h", "description")} AS description, len({heads("h", 1)}) AS h1, {CANONICAL} AS canonical, {count("h", SCRIPT)} AS n_schema,
  len({TAGS}) AS images, len(list_filter({TAGS}, x -> {ALT} = '')) AS bare, {WORDS} AS words, {meta("h", "og:description")} AS og_description FROM s)
"""
ISSUES = {
    "missing_title": "ok AND coalesce(title, '') = ''",
    "title_too_short": f"ok AND coalesce(title, '') <> '' AND {units('title')} < 30",
    "title_too_long": f"ok AND {units('title')} > 60",
    "missing_meta_description": "ok AND coalesce(description, '') = ''",
    "meta_too_short": f"ok AND coalesce(description, '') <> '' AND {units('description')} < 120",
    "meta_too_long": f"ok AND {units('description')} > 160",
    "no_h1": "ok AND h1 = 0",
    "multiple_h1": "ok AND h1 > 1",
    "missing_canonical": "ok AND coalesce(canonical, '') = ''",
    "missing_schema": "ok AND n_schema = 0",
    "broken_internal_links": "NOT ok AND (coalesce(status, 0) >= 400 OR coalesce(error, '') <> '')",
    "heavy_pages": "ok AND size_bytes > 500000",
    "redirected_pages": "redirected",
    "urls_with_tracking_params": "len(tracking) > 0",
    "deep_urls": "depth > 4",
}
INBOUND = """,
i AS (SELECT site, regexp_replace(href, '#.*$', '') AS target, count(*) AS n, min((seq, p)) AS seen FROM l WHERE ok AND inside GROUP BY ALL),
o AS (SELECT m.* FROM m WHERE ok AND url <> site AND url <> site || '/' AND NOT EXISTS (FROM i WHERE i.site = m.site AND i.target = m.url))
"""
MAPS = f"m0 AS ({fixture.duck(fixture.SITEMAPS)}), locs AS (SELECT site, url, regexp_matches(xml, '<sitemap>', 'i') AS is_index, unnest({every('xml', f'<loc>{S}*([^<]+?){S}*</loc>', 1)}) AS loc, generate_subscripts({every('xml', f'<loc>{S}*([^<]+?){S}*</loc>', 1)}, 1) - 1 AS pos FROM m0)"


def _grown(max_urls: int) -> str:
    """x: URLs of each site's sitemap.xml; of an index's children, those before it had twice max_urls."""
    return f""",
{MAPS},
x0 AS (SELECT site, pos AS a, NULL AS b, loc FROM locs WHERE url = site || '/sitemap.xml' AND NOT is_index
  UNION ALL SELECT p.site, p.pos, c.pos, c.loc FROM locs p JOIN locs c ON c.site = p.site AND c.url = p.loc WHERE p.url = p.site || '/sitemap.xml' AND p.is_index),
x1 AS (SELECT site, a, count(*) AS n, sum(count(*)) OVER (PARTITION BY site ORDER BY a) - count(*) AS earlier FROM x0 GROUP BY site, a),
x AS (SELECT x0.* FROM x0 JOIN x1 ON x1.site = x0.site AND x1.a = x0.a WHERE b IS NULL OR earlier < {2 * max_urls})"""


#: w: links of ok pages as a crawl sees them, by first place; f0 to f3: URLs found at each depth without a stop.
LINKED = f""",
w0 AS (SELECT site, regexp_replace(std, '#.*$', '') AS src, std, unnest({every("h", "<a[^>]+href=[\"']([^\"']+)[\"']", 1)}) AS w, generate_subscripts({every("h", "<a[^>]+href=[\"']([^\"']+)[\"']", 1)}, 1) AS p FROM s WHERE ok),
w1 AS (SELECT *, {trim("w")} AS href FROM w0),
w2 AS (SELECT site, src, p, regexp_replace(CASE WHEN href LIKE 'http%' THEN {ENCODE.format(x="href")} WHEN href LIKE '/%' THEN site || {ENCODE.format(x="href")} WHEN href = '' OR href LIKE '#%' THEN std
    WHEN href = '../x' THEN site || regexp_replace(regexp_replace({PATH.format(x="std")}, '[^/]*$', ''), '[^/]+/$', '') || 'x' END, '#.*$', '') AS href FROM w1),
w AS (SELECT site, src, href, min(p) AS p FROM w2 WHERE regexp_extract(href, '^(https?://[^/?#]+)', 1) = site AND NOT regexp_matches(href, '\\.(?:jpg|jpeg|png|gif|svg|webp|ico|css|js|pdf|zip|mp4|webm|woff2?|ttf|eot|xml|json)(?:\\?|$)', 'i') GROUP BY ALL)"""
CRAWL = (
    LINKED
    + """,
f0 AS (SELECT DISTINCT site, site || '/' AS url FROM s), f1 AS (FROM f0 UNION SELECT w.site, href FROM w JOIN f0 ON w.src = f0.url AND w.site = f0.site),
f2 AS (FROM f1 UNION SELECT w.site, href FROM w JOIN f1 ON w.src = f1.url AND w.site = f1.site), f3 AS (FROM f2 UNION SELECT w.site, href FROM w JOIN f2 ON w.src = f2.url AND w.site = f2.site)
"""
)


def _found(max_urls: int) -> str:
    """h: the URLs of each site as discovery numbers them from 0; a crawl follows a page's links while fewer than max_urls URLs were found before it."""
    clean = lambda x: f"regexp_replace(replace({x}, 'ü', '%C3%BC'), '#.*$', '')"
    rounds = ["c0 AS (SELECT DISTINCT site, site || '/' AS url, 0 AS n FROM s)"]
    known = "SELECT * FROM c0"
    for r in range(3):
        rounds.append(f"""a{r} AS (SELECT w.site, w.href AS url, min((c.n, w.p)) AS place FROM c{r} c JOIN w ON w.site = c.site AND w.src = c.url WHERE (w.site, w.href) NOT IN (SELECT (site, url) FROM ({known})) GROUP BY w.site, w.href),
b{r} AS (SELECT a.site, url, struct_extract(place, 1) AS parent, k.n + row_number() OVER (PARTITION BY a.site ORDER BY place) - 1 AS n FROM a{r} a JOIN (SELECT site, count(*) AS n FROM ({known}) GROUP BY site) k ON k.site = a.site),
c{r + 1} AS (SELECT site, url, n FROM b{r} QUALIFY min(n) OVER (PARTITION BY site, parent) < {max_urls})""")
        known += f" UNION ALL SELECT * FROM c{r + 1}"
    crawled = ",\n".join(rounds)
    return LINKED + _grown(max_urls) + f""", {crawled},
h0 AS (SELECT DISTINCT s.site, CASE WHEN (SELECT count(*) FROM x WHERE x.site = s.site) >= 3 THEN 'sitemap' WHEN (SELECT count(*) FROM locs WHERE locs.site = s.site AND locs.url = s.site || '/sitemap_index.xml') >= 3 THEN 'sitemap_index' ELSE 'crawl' END AS source FROM s),
h1 AS (SELECT site, 'sitemap' AS source, {clean("loc")} AS url, a, coalesce(b, 0) AS b FROM x UNION ALL SELECT site, 'sitemap_index', {clean("loc")}, pos, 0 FROM locs WHERE url = site || '/sitemap_index.xml'
  UNION ALL SELECT site, 'crawl', url, n, 0 FROM ({known})),
h AS (SELECT site, source, url, row_number() OVER (PARTITION BY site ORDER BY min((a, b))) - 1 AS n FROM h0 JOIN h1 USING (site, source) GROUP BY site, source, url)"""


def _cap_report(max_urls: int) -> str:
    return f"SELECT site, source, count(*) AS total_discovered, least(count(*), {max_urls}) AS analyzed, count(*) > {max_urls} AS truncated FROM h GROUP BY site, source"


def discovery_sql(max_urls: int = 100) -> dict[str, str]:
    """Queries that depend on where discovery stops."""
    found = BASE + _found(max_urls)
    page_url = "regexp_replace(regexp_replace(std, '#.*$', ''), '^(https?://[^/?]+)$', '\\1/')"
    out = {
        "discovery_source": found + " SELECT site, source, count(*) AS n FROM h GROUP BY site, source",
        "discovery_cap": found + " " + _cap_report(max_urls),
        "crawl_report": found + SLIM + f""", own AS (SELECT site, seq, ok, title, {page_url} AS url FROM m QUALIFY row_number() OVER (PARTITION BY site, {page_url} ORDER BY seq, m.url) = 1),
          got AS (SELECT own.site, count(*) AS pages_analyzed, count(*) FILTER (ok) AS pages_ok, count(*) FILTER (ok AND coalesce(title, '') <> '') AS categorized FROM own JOIN h ON h.site = own.site AND h.url = own.url AND h.n < {max_urls} GROUP BY own.site)
          SELECT d.*, pages_analyzed, pages_ok, categorized FROM ({_cap_report(max_urls)}) d LEFT JOIN got ON got.site = d.site""",
    }
    return {name: _spelled(sql) for name, sql in out.items()}


def _section(cap: bool = True) -> str:
    """g: pages by section with their rank."""
    p = f"lower({PATH.format(x='std')})"
    return f""",
g0 AS (SELECT *, {p} IN ('', '/') AS is_home, CASE WHEN {p} IN ('', '/') THEN 'main' WHEN regexp_matches({p}, '/(?:privacy|privacidad|terms|terminos|cookies|legal|sitemap|404)') THEN 'optional'
  WHEN regexp_matches({p}, '/(?:blog|noticias|news|articles?|posts?|recursos|resources)') THEN 'blog' WHEN regexp_matches({p}, '/(?:about|sobre|nosotros|equipo|team|company|empresa|contact|contacto|careers|empleo)') THEN 'about'
  WHEN regexp_matches({p}, '/(?:products?|productos?|services?|servicios?|features?|funcionalidades?|soluciones?|solutions?|pricing|precios|planes)') THEN 'products'
  WHEN len(list_filter(string_split({p}, '/'), x -> x <> '')) = 1 THEN 'main' WHEN words > 300 THEN 'blog' ELSE 'optional' END AS section FROM m WHERE ok AND coalesce(title, '') <> ''),
g AS (SELECT *, row_number() OVER (PARTITION BY site, section ORDER BY is_home DESC, CASE WHEN is_home THEN -seq ELSE seq END, url) AS rank FROM g0)"""


_CAP = "rank <= CASE section WHEN 'main' THEN 10 WHEN 'products' THEN 15 WHEN 'blog' THEN 20 ELSE 1000000 END"
_CLEAN = f"substr({trim(f'regexp_extract(title, {q(f"^([\\s\\S]*?)(?:{S}*[|—–][\\s\\S]*)?$")}, 1)')}, 1, 80)"
_HOME = f""",
u AS (SELECT m.*, row_number() OVER (PARTITION BY site ORDER BY (url = site OR url = site || '/') DESC, seq, url) AS n FROM m),
n AS (SELECT u.site, coalesce(nullif(CASE WHEN list_contains(types, 'Organization') THEN title END, ''), nullif({trim("regexp_extract(title, '^([^—|–:-]*)', 1)")}, ''),
  upper(substr(regexp_extract(u.site, '^[a-z]+://(?:www\\.)?([^/:.]+)', 1), 1, 1)) || substr(regexp_extract(u.site, '^[a-z]+://(?:www\\.)?([^/:.]+)', 1), 2)) AS name,
  coalesce(nullif(description, ''), nullif(og_description, ''), '') AS description FROM u LEFT JOIN t ON t.seq = u.seq WHERE u.n = 1)"""
_REPORT = f"WITH r AS (SELECT url, strategy, CASE WHEN raw LIKE '{{\"error%' THEN NULL ELSE raw::JSON END AS j FROM ({fixture.duck(fixture.REPORTS)}))"
_A = "j->'lighthouseResult'->'audits'"
_SCORE = "(j->>'$.lighthouseResult.categories.\"{}\".score')::DOUBLE"


def _percent(name: str) -> str:
    return f"floor({_SCORE.format(name)} * 100 + 0.5)::INT"


def _rating(x: str) -> str:
    return f"CASE WHEN {x} >= 0.9 THEN 'good' WHEN {x} >= 0.5 THEN 'needs_improvement' WHEN {x} IS NOT NULL THEN 'poor' END"


def _recommendations() -> str:
    parts = [("high", "fix_existing", 1, "errors"), ("medium", "enhance_existing", 3, "warnings"), ("medium", "aeo_improvement", 4, "CASE WHEN known AND NOT invalid THEN aeo ELSE [] END")]
    of = " UNION ALL ".join(f"SELECT seq, {q(p)} AS priority, {q(c)} AS category, {n} AS phase, pos AS a, generate_subscripts({x}, 1) AS b, type, unnest({x}) AS message, NULL AS fields FROM v" for p, c, n, x in parts)
    return f"""
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY phase, a, b) - 1 AS pos, priority, category, type, message, fields FROM ({of}
  UNION ALL SELECT seq, priority, 'add_schema', CASE priority WHEN 'high' THEN 2 ELSE 5 END, rule, 0, type, CASE priority WHEN 'high' THEN 'Añadir' ELSE 'Considerar' END || ' schema ' || type || ': ' || reason, fields FROM ({_missing()}))"""


def _missing() -> str:
    parts = []
    for rule, (where, either, name, priority, reason, fields) in enumerate(EXPECTED):
        here = "" if where is None else f" AND regexp_matches(page_type, {q(where)})"
        parts.append(f"SELECT seq, page_type, {q(name)} AS type, {q(priority)} AS priority, {q('|'.join(fields))} AS fields, {rule} AS rule, {q(reason)} AS reason FROM w9 WHERE NOT list_has_any(seen, {_list(either)}){here}")
    return f"WITH w9 AS (SELECT s.seq, {PAGE_TYPE} AS page_type, coalesce((SELECT list(type) FILTER (type IS NOT NULL) FROM v WHERE v.seq = s.seq), []) AS seen FROM s WHERE h IS NOT NULL) " + " UNION ALL ".join(parts)


def _spelled(sql: str) -> str:
    """Lambdas and JSON arrows as DuckDB wants them: the one by keyword, the other in parentheses."""
    sql = re.sub(r"\(x, k\) -> ", "lambda x, k: ", sql)
    sql = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql)
    return re.sub(r"\b([a-z]\w*)((?:->>?(?:'[^']*'|\([^()]*\)|k\b|key\b))+)", r"(\1\2)", sql)


def _nulled(x: str) -> str:
    return f"CASE WHEN h IS NOT NULL THEN {x} END"


def oracle_sql() -> dict[str, str]:
    og = {n: meta("h", f"og:{n}") for n in ("title", "description", "image", "type")}
    out = {
        "page_source": BASE + "SELECT site, seq, ok, status, redirected, size_bytes, error, fetch_ms FROM s",
        "page_title": BASE + f"SELECT seq, title, {_nulled(f'coalesce({units("title")}, 0)')} AS length, {_nulled(f'coalesce({units("title")} BETWEEN 30 AND 60, false)')} AS is_ok FROM (SELECT *, {TITLE} AS title FROM s)",
        "page_meta": BASE + f"SELECT seq, d AS description, {_nulled(f'coalesce({units("d")}, 0)')} AS length, {_nulled(f'coalesce({units("d")} BETWEEN 120 AND 160, false)')} AS is_ok, {meta('h', 'robots')} AS robots, {meta('h', 'twitter:card')} AS card FROM (SELECT *, {meta('h', 'description')} AS d FROM s)",
        "page_headings": BASE + "SELECT seq, " + ", ".join(f"{joined(heads('h', i))} AS h{i}" for i in (1, 2, 3, 4)) + ", " + ", ".join(f"len({heads('h', i)}) AS h{i}_count" for i in (1, 2, 3)) + f", len({heads('h', 1)}) = 1 AS is_ok FROM s",
        "page_canonical": BASE + f"SELECT seq, {CANONICAL} AS canonical, {_nulled(f'{CANONICAL} IS NOT NULL')} AS is_ok FROM s",
        "page_hreflang": BASE + f"SELECT seq, {_nulled(joined(f'list_transform(list_zip({_ALT_A}, {_REF_A}) || list_zip({_ALT_B}, {_REF_B}), x -> x[1] || {q("=")} || x[2])'))} AS langs, len({_ALT_A}) + len({_ALT_B}) AS n FROM s",
        "page_open_graph": BASE + f"SELECT seq, {og['title']} AS og_title, {og['description']} AS og_description, {og['image']} AS og_image, {og['type']} AS og_type, {_nulled(f'coalesce({og["title"]}, {q("")}) <> {q("")} AND coalesce({og["description"]}, {q("")}) <> {q("")}')} AS is_ok FROM s",
        "page_images": BASE + f"""SELECT seq, len(tags) AS total, len(bare) AS without_alt, len(list_filter(tags, x -> NOT {has("x", f"{S}src=[\"']([^\"']+)[\"']")})) AS without_src,
          CASE WHEN tags IS NOT NULL THEN least(5, len(list_filter(bare, x -> {has("x", f"{S}src=[\"']([^\"']+)[\"']")}))) END AS samples, len(bare) = 0 AS is_ok FROM (SELECT seq, {TAGS} AS tags, list_filter({TAGS}, x -> {ALT} = '') AS bare FROM s)""",
        "page_technical": BASE + f"SELECT seq, {has('h', '<meta[^>]+name=[\"\\x27]viewport[\"\\x27]')} AS viewport, {has('h', '<meta[^>]+charset=')} AS charset, {first('h', '<html[^>]+lang=[\"\\x27]([^\"\\x27]+)[\"\\x27]')} AS lang, {units('h')} AS html_length FROM s",
        "page_word_count": BASE + f"SELECT seq, {WORDS} AS words FROM s",
        "page_visible_text": BASE + f"SELECT seq, {visible('h')} AS visible FROM s",
        "page_record": BASE + LINKS + f"""SELECT s.seq, {PAGE_TYPE} AS page_type, {TITLE} AS title, coalesce({units(meta("h", "description"))}, 0) AS description_length, len({heads("h", 1)}) AS h1_count, {CANONICAL} AS canonical, len({TAGS}) AS images,
          (SELECT count(*) FROM l WHERE l.seq = s.seq AND inside) AS internal, (SELECT count(*) FROM l WHERE l.seq = s.seq AND NOT inside) AS external, {WORDS} AS words, {count("h", SCRIPT)} AS blocks FROM s WHERE h IS NOT NULL""",
        "page_links": BASE + LINKS + """SELECT s.seq, CASE WHEN h IS NOT NULL THEN count(l.p) FILTER (inside) END AS internal, CASE WHEN h IS NOT NULL THEN count(l.p) FILTER (NOT inside) END AS external,
          CASE WHEN h IS NOT NULL THEN coalesce(string_agg(href, '|' ORDER BY p) FILTER (inside), '') END AS hrefs, CASE WHEN h IS NOT NULL THEN coalesce(string_agg(anchor, '|' ORDER BY p) FILTER (NOT inside), '') END AS anchors FROM s LEFT JOIN l ON l.seq = s.seq GROUP BY s.seq, h""",
        "link_edges": BASE + LINKS + "SELECT site, seq, url AS src_url, row_number() OVER (PARTITION BY seq ORDER BY inside DESC, p) - 1 AS pos, href, anchor, CASE WHEN inside THEN 'internal' ELSE 'external' END AS kind FROM l",
        "url_dedupe": f"""WITH a AS (SELECT page_id AS seq, url FROM pages UNION ALL SELECT page_id + 1000000, url || '#again' FROM pages), b AS (SELECT seq, url, regexp_replace({ENCODE.format(x="url")}, '#.*$', '') AS c FROM a),
          d AS (SELECT seq, url, CASE WHEN regexp_matches(c, '^https?://[^/?]+$') THEN c || '/' ELSE c END AS clean_url FROM b) SELECT seq, clean_url FROM d QUALIFY row_number() OVER (PARTITION BY clean_url ORDER BY seq, url) = 1""",
        "url_target": BASE + "SELECT seq, CASE WHEN seq % 2 = 0 THEN 'https://' || regexp_replace(url, '^https?://', '') ELSE url END AS target, CASE WHEN seq % 2 = 0 THEN 'https://' || regexp_replace(site, '^https?://', '') ELSE site END AS origin FROM s",
        "url_params": BASE + f"SELECT seq, CASE WHEN NOT failed THEN len({PARAMS}) > 0 END AS has_params, CASE WHEN NOT failed THEN len({PARAMS}) END AS n, CASE WHEN NOT failed THEN {joined(NAMES)} END AS params, CASE WHEN NOT failed THEN {joined(TRACKING)} END AS tracking, CASE WHEN NOT failed THEN contains(url, '#') END AS fragment, CASE WHEN NOT failed THEN {DEPTH} END AS depth FROM s",
        "url_page_type": BASE + f"SELECT seq, {PAGE_TYPE} AS page_type FROM s",
        "url_category": BASE + SLIM + _section().replace("WHERE ok AND coalesce(title, '') <> ''", "") + " SELECT seq, section AS category FROM g0",
        "url_asset": BASE + "SELECT seq, seq % 5 IN (1, 2, 3) AS asset FROM s",
    }
    quick = lambda key, name: f"<meta{S}+{key}=[\"']{name}[\"']{S}+content=[\"']([^\"']*)[\"']"
    out |= {
        "quick_html": BASE + f"""SELECT seq, title, coalesce({units("title")} BETWEEN 10 AND 70, false) AS title_ok, description, coalesce({units("description")} BETWEEN 50 AND 165, false) AS description_ok, canonical, {joined("h1s")} AS h1, h2_count, h3_count, langs,
          coalesce(ogt, '') <> '' AND coalesce(ogd, '') <> '' AND coalesce(ogi, '') <> '' AS og_ok, nullif(card, '') AS card, len(tags) AS images, bare AS without_alt, len(tags) > 0 AND bare = 0 AS images_ok, url LIKE 'https://%' AS https, viewport, charset, lang, robots FROM (
          SELECT seq, url, {trim(first("raw", "<title[^>]*>([^<]*)</title>"))} AS title, {trim(first("raw", quick("name", "description")))} AS description, {trim(first("raw", f"<link{S}+rel=[\"']canonical[\"']{S}+href=[\"']([^\"']*)[\"']"))} AS canonical,
          {", ".join(f"list_filter(list_transform({every('raw', f'<h{i}[^>]*>([\\s\\S]*?)</h{i}>', 1)}, x -> {trim(sub(strip('x'), f'{S}+', ' '))}), x -> x <> '') AS h{i}s, len(h{i}s) AS h{i}_count" for i in (1, 2, 3))},
          {joined(every("raw", "<link[^>]+hreflang=[\"']([^\"']+)[\"'][^>]*>", 1))} AS langs, {first("raw", quick("property", "og:title"))} AS ogt, {first("raw", quick("property", "og:description"))} AS ogd, {first("raw", quick("property", "og:image"))} AS ogi, {first("raw", quick("name", "twitter:card"))} AS card,
          {every("raw", f"<img{S}[^>]*>")} AS tags, len(list_filter(tags, x -> NOT {has("x", f"{S}alt{S}*=")})) AS bare, {has("raw", f"<meta{S}+name=[\"']viewport[\"']")} AS viewport, {has("raw", f"<meta{S}+charset=")} AS charset, {first("raw", "<html[^>]+lang=[\"']([^\"']+)[\"']")} AS lang, {first("raw", quick("name", "robots"))} AS robots FROM s)""",
        "quick_links": BASE + f"""SELECT seq, len(list_filter(kept, x -> x LIKE '/%' OR x LIKE ' %' OR x LIKE '../%' OR starts_with(x, site || '/'))) AS internal, len(kept) - internal AS external, len(kept) AS total FROM (
          SELECT seq, site, list_filter({every("raw", f"<a{S}[^>]*href=[\"']([^\"']+)[\"']", 1)}, x -> NOT regexp_matches(x, '^(?:#|mailto:|tel:|javascript:)')) AS kept FROM s)""",
        "quick_schema": BASE.replace("CASE WHEN error IS NULL AND content_type LIKE '%html%' THEN html END AS h", "html AS h") + BLOCKS + "SELECT seq, blocks AS n, array_to_string(types, '|') AS types, list_has_any(types, ['Article', 'BlogPosting', 'NewsArticle']) AS has_article, list_contains(types, 'Organization') AS has_organization, list_contains(types, 'FAQPage') AS has_faq, list_contains(types, 'HowTo') AS has_howto FROM t",
        "aux_file_facts": f"""WITH f AS ({fixture.duck(fixture.AUX_FILES)}), g AS (SELECT site, max(status) FILTER (kind = 'robots') AS rs, max(content) FILTER (kind = 'robots') AS rc, max(status) FILTER (kind = 'sitemap') AS ss, max(content) FILTER (kind = 'sitemap') AS sc,
            max(status) FILTER (kind = 'llms') AS ls, max(content) FILTER (kind = 'llms') AS lc FROM f GROUP BY site)
          SELECT site, coalesce(rs = 200, false) AS robots, CASE WHEN rs = 200 THEN contains(rc, 'SITEMAP') END AS has_sitemap, CASE WHEN rs = 200 AND contains(rc, 'SITEMAP') THEN site || '/sitemap.xml' END AS sitemap_url, CASE WHEN rs = 200 THEN length(rc) END AS robots_length,
          coalesce(ss = 200, false) AS sitemap, CASE WHEN ss = 200 THEN len(string_split(sc, '<loc>')) - 1 END AS url_count, CASE WHEN ss = 200 THEN least(5, len(string_split(sc, '<loc>')) - 1) END AS sample_size, coalesce(ls = 200, false) AS llms, CASE WHEN ls = 200 THEN lc END AS llms_content FROM g""",
    }
    out |= {
        "jsonld_types": BASE + BLOCKS + "SELECT seq, blocks AS n, array_to_string(types, '|') AS types, list_contains(types, 'Organization') AS has_organization, list_has_any(types, ['Article', 'BlogPosting']) AS has_article, list_contains(types, 'Product') AS has_product, list_contains(types, 'FAQPage') AS has_faq FROM t",
        "jsonld_flat": BASE + BLOCKS + "SELECT seq, pos, invalid, type, context, coalesce(array_to_string(list_sort(list_filter(fields, f -> NOT starts_with(f, '@'))), '|'), '') AS fields FROM b3",
        "jsonld_validation": BASE + BLOCKS + VERDICTS + "SELECT seq, pos, type, valid, array_to_string(list_sort(errors), '|') AS errors, array_to_string(list_sort(warnings), '|') AS warnings, CASE WHEN known AND NOT invalid THEN array_to_string(list_sort(aeo), '|') ELSE '' END AS aeo_issues, score, NOT known AND NOT invalid AS unknown_type FROM v",
        "jsonld_faq_howto": BASE + BLOCKS + VERDICTS + "SELECT seq, type, array_to_string(extra, '|') AS errors, array_to_string(extra_w, '|') AS warnings FROM v WHERE type IN ('FAQPage', 'HowTo')",
        "jsonld_summary": BASE + BLOCKS + VERDICTS + "SELECT s.seq, count(v.pos) AS total, count(v.pos) FILTER (v.valid) AS valid, count(v.pos) FILTER (NOT v.valid) AS invalid, coalesce(array_to_string(list_sort(list_distinct(list(type) FILTER (type IS NOT NULL))), '|'), '') AS detected, coalesce(array_to_string(list_sort(list(type) FILTER (NOT v.valid AND type IS NOT NULL)), '|'), '') AS with_errors FROM s LEFT JOIN v ON v.seq = s.seq WHERE h IS NOT NULL GROUP BY s.seq",
        "aeo_score": BASE + BLOCKS + VERDICTS + """, w1 AS (SELECT s.seq, coalesce((SELECT sum(weight) FROM heavy WHERE type IN (SELECT type FROM v WHERE v.seq = s.seq AND v.valid)), 0) AS earned, (SELECT count(*) FROM v JOIN heavy ON heavy.type = v.type WHERE v.seq = s.seq AND NOT v.valid) AS bad,
            coalesce((SELECT string_agg(weight::VARCHAR, '|' ORDER BY weight DESC) FROM heavy WHERE type IN (SELECT type FROM v WHERE v.seq = s.seq AND v.valid)), '') AS weights FROM s WHERE h IS NOT NULL), w2 AS (SELECT *, least(100, floor(greatest(0, earned - 2 * bad)::DOUBLE / 50 * 100 + 0.5))::INT AS score FROM w1)
          SELECT seq, score, CASE WHEN score >= 70 THEN 'excellent' WHEN score >= 40 THEN 'good' WHEN score >= 15 THEN 'needs_improvement' ELSE 'poor' END AS rating, bad AS invalid, weights FROM w2""",
        "missing_schemas": BASE + BLOCKS + VERDICTS + f"SELECT seq, page_type, type, priority, fields FROM ({_missing()})",
        "recommendations": BASE + BLOCKS + VERDICTS + _recommendations(),
        "citability_score": BASE + CITED + "SELECT seq, score, CASE WHEN score >= 75 THEN 'excellent' WHEN score >= 55 THEN 'good' WHEN score >= 30 THEN 'needs_improvement' ELSE 'poor' END AS rating FROM c",
    }
    out |= {f"cit_{n}": BASE + CITED + f"SELECT seq, {n} AS score, {n}_signals AS signals, len({n}_gaps) AS gaps FROM c" for n in DIMENSIONS}
    counts = ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in ISSUES.items())
    out |= {
        "site_summary": BASE + CITED + "SELECT s.site, count(*) AS pages_analyzed, count(*) FILTER (s.ok) AS pages_ok, count(*) FILTER (NOT s.ok) AS pages_failed, coalesce(sum(size_bytes) FILTER (s.ok), 0)::BIGINT AS total_bytes, coalesce(floor(avg(size_bytes) FILTER (s.ok) + 0.5), 0)::BIGINT AS avg_bytes_per_page, coalesce(floor(avg(score) FILTER (s.ok) + 0.5), 0)::BIGINT AS avg_citability_score FROM s LEFT JOIN c ON c.seq = s.seq GROUP BY s.site",
        "status_breakdown": BASE + "SELECT site, coalesce(status::VARCHAR, 'error') AS status, count(*) AS pages FROM s GROUP BY ALL",
        "site_issues": BASE + CITED + SLIM + f"SELECT site, {counts}, count(*) FILTER (ok AND (SELECT score FROM c WHERE c.seq = m.seq) < 40) AS low_citability_pages, coalesce(sum(bare) FILTER (ok), 0)::BIGINT AS images_without_alt, coalesce(sum(images) FILTER (ok), 0)::BIGINT AS images_total FROM m GROUP BY site",
        "duplicate_titles": BASE + SLIM + "SELECT site, title, count(*) AS count, string_agg(url, '|' ORDER BY seq) AS members FROM m WHERE ok AND title <> '' GROUP BY site, title HAVING count(*) > 1",
        "duplicate_metas": BASE + SLIM + "SELECT site, description, count(*) AS count, string_agg(url, '|' ORDER BY seq) AS members FROM m WHERE ok AND description <> '' GROUP BY site, description HAVING count(*) > 1",
        "inbound_links": BASE + LINKS + SLIM + INBOUND + "SELECT site, target AS url, n AS inbound_count FROM i",
        "most_linked": BASE + LINKS + SLIM + INBOUND + "SELECT site, row_number() OVER (PARTITION BY site ORDER BY n DESC, seen, target) AS rank, target AS url, n AS inbound_count FROM i QUALIFY rank <= 10",
        "orphan_pages": BASE + LINKS + SLIM + INBOUND + "SELECT site, seq, url FROM o",
        "broken_pages": BASE + SLIM + f"SELECT seq, url, status, error FROM m WHERE {ISSUES['broken_internal_links']}",
        "heavy_pages": BASE + SLIM + "SELECT seq, url, floor(size_bytes::DOUBLE / 1024 + 0.5)::BIGINT AS size_kb FROM m WHERE ok AND size_bytes > 500000",
        "redirected_pages": BASE + SLIM + "SELECT seq, url, final_url AS target FROM m WHERE redirected",
        "tracking_urls": BASE + SLIM + "SELECT seq, url, array_to_string(tracking, '|') AS params FROM m WHERE len(tracking) > 0",
        "deep_urls": BASE + SLIM + "SELECT seq, url, depth FROM m WHERE depth > 4",
        "low_citability": BASE + CITED + "SELECT seq, url, score FROM c WHERE ok AND score < 40",
        "schema_types_found": BASE + BLOCKS + "SELECT site, type, count(*) AS pages FROM (SELECT site, unnest(types) AS type FROM t JOIN s ON s.seq = t.seq WHERE ok) GROUP BY ALL",
    }
    sampled = ["missing_title", "no_h1", "multiple_h1", "missing_meta_description", "missing_canonical", "missing_schema", "broken_internal_links", "heavy_pages", "redirected_pages", "urls_with_tracking_params"]
    details = {"multiple_h1": "h1::VARCHAR", "broken_internal_links": "concat_ws(' ', status, error)", "heavy_pages": "floor(size_bytes::DOUBLE / 1024 + 0.5)::BIGINT::VARCHAR", "redirected_pages": "final_url", "urls_with_tracking_params": "array_to_string(tracking, ',')"}
    each = " UNION ALL ".join(f"SELECT site, {q(n)} AS issue, seq, url, {details.get(n, q(''))} AS detail FROM m WHERE {ISSUES[n]}" for n in sampled)
    first_gap = "list_sort(" + " || ".join(f"list_transform({n}_gaps, (x, k) -> (CASE x[1] WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, {i}, k, x[2]))" for i, n in enumerate(DIMENSIONS)) + ")[1][4]"
    out["issue_samples"] = BASE + CITED + SLIM + INBOUND + f"""SELECT site, issue, row_number() OVER (PARTITION BY site, issue ORDER BY seq, url) AS rank, url, detail FROM ({each}
      UNION ALL SELECT site, 'low_citability_pages', seq, url, concat_ws(': ', score, {first_gap}) FROM c WHERE ok AND score < 40 UNION ALL SELECT site, 'orphan_pages', seq, url, '' FROM o) QUALIFY rank <= CASE issue WHEN 'broken_internal_links' THEN 10 ELSE 5 END"""
    out["site_report"] = BASE + CITED + SLIM + INBOUND + """
      SELECT m.site, count(*) AS pages_analyzed, count(*) FILTER (m.ok) AS pages_ok, coalesce(sum(size_bytes) FILTER (m.ok), 0)::BIGINT AS total_bytes, coalesce(floor(avg(score) FILTER (m.ok) + 0.5), 0)::BIGINT AS avg_citability_score,
        count(*) FILTER (m.ok AND coalesce(title, '') = '') AS missing_title, count(*) FILTER (m.ok AND length(title) > 60) AS title_too_long, count(*) FILTER (m.ok AND n_schema = 0) AS missing_schema, coalesce(sum(bare) FILTER (m.ok), 0)::BIGINT AS images_without_alt,
        (SELECT count(*) FROM (SELECT title FROM m d WHERE d.site = m.site AND ok AND title <> '' GROUP BY title HAVING count(*) > 1)) AS duplicate_titles, (SELECT count(*) FROM (SELECT description FROM m d WHERE d.site = m.site AND ok AND description <> '' GROUP BY description HAVING count(*) > 1)) AS duplicate_metas,
        coalesce((SELECT sum(n) FROM i WHERE i.site = m.site), 0)::BIGINT AS total_internal_links, (SELECT count(*) FROM o WHERE o.site = m.site) AS orphan_pages_count, coalesce((SELECT max(n) FROM i WHERE i.site = m.site), 0) AS top_inbound,
        (SELECT count(DISTINCT type) FROM (SELECT unnest(types) AS type FROM t JOIN s ON s.seq = t.seq WHERE s.ok AND s.site = m.site)) AS n_types FROM m LEFT JOIN c ON c.seq = m.seq GROUP BY m.site"""
    chosen = CRAWL + _grown(MAX_URLS) + f""",
d0 AS (SELECT DISTINCT s.site, CASE WHEN (SELECT count(*) FROM x WHERE x.site = s.site) >= 3 THEN 'sitemap' WHEN (SELECT count(*) FROM locs WHERE locs.site = s.site AND locs.url = s.site || '/sitemap_index.xml') >= 3 THEN 'sitemap_index' ELSE 'crawl' END AS source FROM s)"""
    out |= {
        "sitemap_urls": f"WITH {MAPS} SELECT site, url, is_index, pos, loc FROM locs",
        "sitemap_expand": BASE + _grown(MAX_URLS) + " SELECT site, a::VARCHAR || coalesce('.' || b::VARCHAR, '') AS place, loc FROM x",
        "bfs_crawl": BASE + CRAWL + "SELECT site, url FROM f3",
    }
    listed = chosen + """, d1 AS (
  SELECT site, count(DISTINCT regexp_replace(replace(loc, 'ü', '%C3%BC'), '#.*$', '')) AS n FROM x GROUP BY site), d2 AS (SELECT site, count(DISTINCT regexp_replace(replace(loc, 'ü', '%C3%BC'), '#.*$', '')) AS n FROM locs WHERE url = site || '/sitemap_index.xml' GROUP BY site)"""
    out["sitemap_source"] = BASE + listed + " SELECT d0.site, source, CASE source WHEN 'sitemap' THEN d1.n WHEN 'sitemap_index' THEN d2.n END AS n FROM d0 LEFT JOIN d1 ON d1.site = d0.site LEFT JOIN d2 ON d2.site = d0.site"
    out |= {
        "llms_home": BASE + BLOCKS + SLIM + _HOME + " SELECT site, name, description FROM n",
        "llms_sections": BASE + SLIM + _section() + f" SELECT site, section, rank, seq, {_CLEAN} AS title FROM g WHERE {_CAP}",
        "llms_txt": BASE + BLOCKS + SLIM + _HOME + _section() + f""",
          p AS (SELECT site, CASE section WHEN 'main' THEN 1 WHEN 'products' THEN 2 WHEN 'blog' THEN 3 WHEN 'about' THEN 4 ELSE 5 END AS o, section, count(*) AS n,
            CASE section WHEN 'main' THEN '## Páginas principales' WHEN 'products' THEN '## Productos y servicios' WHEN 'blog' THEN '## Blog y recursos' WHEN 'about' THEN '## Información corporativa' ELSE '## Optional' END || chr(10) || chr(10) ||
            string_agg('- [' || {_CLEAN} || '](' || url || ')' || CASE WHEN section <> 'optional' AND coalesce(description, '') <> '' THEN ': ' || description ELSE '' END, chr(10) ORDER BY rank) FILTER ({_CAP}) || chr(10) AS body FROM g GROUP BY site, section)
          SELECT n.site, {trim("any_value('# ' || name || chr(10) || chr(10) || CASE WHEN description <> '' THEN '> ' || description || chr(10) || chr(10) ELSE '' END || 'URL: ' || n.site || chr(10) || chr(10)) || coalesce(string_agg(body, chr(10) ORDER BY o), '')")} || chr(10) AS content,
            coalesce(sum(p.n), 0)::BIGINT AS total_pages_categorized, coalesce(string_agg(section, '|' ORDER BY o), '') AS sections FROM n LEFT JOIN p ON p.site = n.site GROUP BY n.site""",
    }
    ids = ["render-blocking-resources", "unused-javascript", "unused-css-rules", "redirects"]
    opp = " UNION ALL ".join(f"SELECT url, strategy, {i} AS i, {q(k)} AS id, {_A}->{q(k)} AS a FROM r" for i, k in enumerate(ids))
    failing = " UNION ALL ".join(f"SELECT url, strategy, {q(kind)} AS kind, {q(k)} AS id, {_A}->{q(k)} AS a FROM r" for kind, k in (("seo", "meta-description"), ("seo", "image-alt"), ("a11y", "image-alt")))
    runs = _REPORT + ", u AS (SELECT url, max(j::VARCHAR) FILTER (strategy = 'mobile')::JSON AS m, max(j::VARCHAR) FILTER (strategy = 'desktop')::JSON AS d, count(*) FILTER (strategy = 'desktop') AS n_d FROM r GROUP BY url)"
    perf = "floor(({}->>'$.lighthouseResult.categories.performance.score')::DOUBLE * 100 + 0.5)::INT"
    cwv = "({}->>'$.loadingExperience.overall_category')"
    opened = "len(list_filter([({m}->'unused-javascript'->>'score')::DOUBLE, 0.1, 0.4], x -> x < 0.9))".format(m="m->'lighthouseResult'->'audits'")
    out |= {
        "ps_scores": _REPORT + f"SELECT url, strategy, {_percent('performance')} AS performance, {_percent('seo')} AS seo, {_percent('best-practices')} AS best_practices, {_percent('accessibility')} AS accessibility FROM r",
        "ps_metrics": _REPORT + f""", k(metric, key) AS (VALUES ('lcp', 'largest-contentful-paint'), ('fcp', 'first-contentful-paint'), ('cls', 'cumulative-layout-shift'), ('tbt', 'total-blocking-time'), ('si', 'speed-index'), ('tti', 'interactive'), ('ttfb', 'server-response-time'),
            ('total_byte_weight', 'total-byte-weight'), ('dom_size', 'dom-size'), ('main_thread_work', 'mainthread-work-breakdown'), ('bootup_time', 'bootup-time')), a AS (SELECT r.*, metric, {_A}->key AS a FROM r, k)
          SELECT url, strategy, json_array_length({_A}->'network-requests'->'details'->'items')::INT AS requests, metric, (a->>'numericValue')::DOUBLE AS value, a->>'numericUnit' AS unit, a->>'displayValue' AS display, (a->>'score')::DOUBLE AS score, {_rating("(a->>'score')::DOUBLE")} AS rating FROM a""",
        "ps_field": _REPORT + """, k(metric, key) AS (VALUES ('lcp', 'LARGEST_CONTENTFUL_PAINT_MS'), ('fcp', 'FIRST_CONTENTFUL_PAINT_MS'), ('cls', 'CUMULATIVE_LAYOUT_SHIFT_SCORE'), ('inp', 'INTERACTION_TO_NEXT_PAINT'), ('ttfb', 'EXPERIMENTAL_TIME_TO_FIRST_BYTE')),
            a AS (SELECT r.*, metric, j->'loadingExperience'->'metrics'->key AS a FROM r, k) SELECT url, strategy, j->>'$.loadingExperience.overall_category' AS overall, metric, (a->>'percentile')::DOUBLE AS p75, a->>'category' AS category FROM a""",
        "ps_opportunities": _REPORT + f""", a AS ({opp}), b AS (SELECT *, (a->>'score')::DOUBLE AS score, (a->>'$.details.overallSavingsMs')::DOUBLE AS savings_ms, coalesce((a->>'$.details.overallSavingsBytes')::DOUBLE, 0) AS size FROM a WHERE (a->>'score')::DOUBLE < 0.9)
          SELECT url, strategy, row_number() OVER (PARTITION BY url, strategy ORDER BY coalesce(savings_ms, 0) DESC, size DESC, i) - 1 AS pos, id, a->>'title' AS title, score, savings_ms, coalesce(json_array_length(a->'details'->'items'), 0)::INT AS affected, {_rating("score")} AS rating FROM b""",
        "ps_failed_audits": _REPORT + f", a AS ({failing}) SELECT url, strategy, kind, id, coalesce(json_array_length(a->'details'->'items'), 0)::INT AS affected, least(3, coalesce(json_array_length(a->'details'->'items'), 0))::INT AS sampled FROM a WHERE (a->>'score')::DOUBLE <> 1",
        "ps_summary": runs + f"""SELECT url, {perf.format("m")} AS mobile, {perf.format("d")} AS desktop, {cwv.format("m")} AS cwv_mobile, coalesce({cwv.format("m")} = 'FAST', false) AS passes_mobile, coalesce({cwv.format("d")} = 'FAST', false) AS passes_desktop,
          array_to_string(list_filter([CASE WHEN m IS NULL THEN 'PageSpeed mobile: quota' END, CASE WHEN d IS NULL THEN 'PageSpeed desktop: ' || CASE WHEN n_d = 0 THEN 'timeout' ELSE 'quota' END END], x -> x IS NOT NULL), '|') AS errors FROM u""",
        "ps_record": runs + f"""SELECT url, 'acme' AS client, 'r1' AS run_id, m IS NOT NULL AS has_mobile, d IS NOT NULL AS has_desktop, CASE WHEN m IS NULL THEN -1 ELSE {opened} END AS opportunities,
          CASE WHEN m IS NULL THEN -1 ELSE 1 + ((m->'lighthouseResult'->'audits'->'meta-description'->>'score')::DOUBLE <> 1)::INT END AS seo_issues FROM u""",
    }
    gaps = " UNION ALL ".join(f"SELECT seq, {k} AS d, {q(n)} AS dimension, unnest({n}_gaps) AS g, generate_subscripts({n}_gaps, 1) AS i FROM c" for k, n in enumerate(DIMENSIONS))
    out["citability_gaps"] = BASE + CITED + f"""SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY CASE g[1] WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, d, i) - 1 AS pos, dimension, g[1] AS priority, g[2] AS message FROM ({gaps})"""
    out["quick_audit"] = f"""SELECT e.url, a.title, b.total AS links, d.n AS blocks, p.mobile AS performance, f.robots, p.errors FROM ({fixture.duck(fixture.PAGES)}) e
      JOIN ({out["quick_html"]}) a ON a.seq = e.seq JOIN ({out["quick_links"]}) b ON b.seq = e.seq JOIN ({out["quick_schema"]}) d ON d.seq = e.seq JOIN ({out["ps_summary"]}) p ON p.url = e.url JOIN ({out["aux_file_facts"]}) f ON f.site = e.site"""
    return {name: _spelled(sql) for name, sql in out.items()} | discovery_sql()
