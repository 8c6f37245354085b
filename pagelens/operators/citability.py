"""Citability: how fit a page is to be cited, by eight weighted dimensions. Column expressions of a page's record."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from ..functions.text import END, START, WS, closed, count, every, half_up, let, strip_tags, units
from . import page

S, Q = f"[{WS}]", tags.Q
# Weights, and strings that mark a link to a source of authority.
WEIGHTS = {"freshness": 12, "authorship": 18, "factuality": 14, "structure": 12, "citations": 10, "expertise": 10, "machine_readable": 14, "answer_format": 10}
AUTHORITIES = [
    "wikipedia.org", ".gov", ".edu", "github.com", "arxiv.org", "nih.gov", "who.int", "oecd.org", "imf.org", "un.org", "reuters.com", "bloomberg.com",
    "nytimes.com", "wsj.com", "nature.com", "science.org", "sciencedirect.com", "mckinsey.com", "gartner.com", "forrester.com", "deloitte.com", "pwc.com",
    "kpmg.com", "ey.com", "bcg.com", "accenture.com", "statista.com", "forbes.com", "hbr.org", "mit.edu", "stanford.edu", "google.com/research",
    "developers.google.com", "mozilla.org", "w3.org", "rfc-editor.org", "ietf.org",
]
ARTICLES = ["Article", "BlogPosting", "NewsArticle"]
LLM_TYPES = ["Organization", "Article", "BlogPosting", "FAQPage", "HowTo", "Person", "Product"]
NAME = "[A-Z][a-záéíóúñ]+"
PRIORITY = ["high", "medium", "low"]
GAP = "struct<dimension:string,priority:string,message:string,fix:string>"


class Dimension:
    """Rules of one dimension; of each rule's ladder the first step that fits gives points, a signal and a gap.

    Every rule is one expression, so a page's text is searched once for each condition that is reached.
    """

    def __init__(self, name: str) -> None:
        self.name, self.rules = name, []

    def add(self, *ladder: tuple[Column | None, int, Column | str | None, tuple | None]) -> None:
        """Steps (condition, points, signal, gap); condition None is the last resort. A gap is (priority, message, fix)."""
        self.rules.append(self._case(ladder))

    def add_for(self, value: Column, ladder: Callable[[Column], list[tuple]]) -> None:
        """A ladder over a value that is computed once."""
        self.rules.append(let(value, lambda v: self._case(ladder(v))))

    def _case(self, ladder) -> Column:
        out = self._step(0, None, None)
        for when, points, signal, gap in reversed(ladder):
            step = self._step(points, signal, gap)
            out = step if when is None else F.when(F.coalesce(when, F.lit(False)), step).otherwise(out)
        return out

    def _step(self, points: int, signal: Column | str | None, gap: tuple | None) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        lack = F.lit(None).cast(GAP) if gap is None else F.struct(F.lit(self.name).alias("dimension"), *[text(x).alias(n) for x, n in zip(gap, ("priority", "message", "fix"))])
        return F.struct(F.lit(points).alias("points"), text(signal).cast("string").alias("signal"), lack.alias("gap"))

    def column(self) -> Column:
        def total(rules: Column) -> Column:
            score = F.least(F.lit(100), F.aggregate(rules, F.lit(0), lambda a, r: a + r["points"]))
            return F.struct(score.alias("score"), F.array_compact(F.transform(rules, lambda r: r["signal"])).alias("signals"), F.array_compact(F.transform(rules, lambda r: r["gap"])).alias("gaps"))

        return let(F.array(*self.rules), total)


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def dates(text: Column) -> Column:
    """Days named in a text as ISO dates, day/month/year and bare years (their first of January), repeats kept.

    Days beyond the month's end roll over; months over 12 or days over 31 name no date. A date lies in a stretch of
    digits, '-' and '/' that no word character precedes; the text is read once for these, and only they for dates.
    """
    stretches = every(text, r"[0-9](?<![A-Za-z0-9_][0-9])[0-9/-]*+[A-Za-z_]?")  # a letter behind tells that no date ends here
    return let(F.array_join(stretches, " "), _dates)


def _dates(text: Column) -> Column:
    iso =rf"{START}(20\d\d)-(\d\d)-(\d\d){END}"
    dmy = rf"{START}(\d{{1,2}})[/-](\d{{1,2}})[/-](20\d\d){END}"
    parts = lambda p, y, m, d: F.transform(F.arrays_zip(every(text, p, y).alias("y"), every(text, p, m).alias("m"), every(text, p, d).alias("d")), lambda x: F.struct(x["y"].cast("int").alias("y"), x["m"].cast("int").alias("m"), x["d"].cast("int").alias("d")))
    years = F.transform(every(text, rf"{START}(20\d\d){END}", 1), lambda y: F.struct(y.cast("int").alias("y"), F.lit(1).alias("m"), F.lit(1).alias("d")))
    found = F.filter(F.concat(parts(iso, 1, 2, 3), parts(dmy, 3, 2, 1), years), lambda x: x["m"].between(1, 12) & x["d"].between(1, 31))
    return F.transform(found, lambda x: F.date_add(F.make_date(x["y"], x["m"], F.lit(1)), x["d"] - 1))


def recent(found: Column, as_of: Column, days: int) -> Column:
    """True if one of the days is at most so many days before ``as_of``; a later day never is."""
    age = lambda d: (F.unix_micros(as_of) / 1e6 - F.unix_date(d) * 86400.0) / 86400.0
    return F.exists(found, lambda d: (age(d) >= 0) & (age(d) <= days))


def freshness(text: Column, types: Column, as_of: Column) -> Column:
    d = Dimension("freshness")
    old = ("medium", "Fechas detectadas pero >1 año de antigüedad", "Actualizar contenido o publicar contenido nuevo. Los LLMs priorizan contenido reciente.")
    none = ("high", "No se detectan fechas explícitas en el contenido visible", "Añadir fecha de publicación y actualización visible en cada página de contenido.")
    d.add_for(dates(text), lambda x: [(recent(x, as_of, 90), 60, "Contenido fresco (fecha últimos 3 meses)", None), (recent(x, as_of, 365), 35, "Fechas del último año detectadas", None), (F.size(x) > 0, 15, None, old), (None, 0, None, none)])
    d.add((_any(types, ARTICLES), 25, "Schema con datePublished/dateModified", None), (None, 0, None, ("medium", "No hay schema Article/BlogPosting con fechas estructuradas", "Añadir schema con datePublished y dateModified.")))
    d.add((text.rlike(rf"(?iu)última{S}+actualizaci[oó]n|last{S}+updated|updated{S}+on|actualizado{S}+el"), 15, 'Marker de "última actualización" visible', None))
    return d.column()


def _any(types: Column, names: list[str]) -> Column:
    return F.arrays_overlap(types, F.array(*map(F.lit, names)))


def authorship(html: Column, text: Column, types: Column) -> Column:
    d, person = Dimension("authorship"), _any(types, ["Person"])
    byline = text.rlike(rf"(?iu){START}(?:by|por){S}+{NAME}")
    d.add((person, 35, "Schema Person presente", None))
    d.add((_any(types, ARTICLES), 20, "Schema Article con autor estructurado", None))
    d.add(
        (tags.has(html, "<", rf"[^>]+(?:class|id)={Q}[^\"']*(?:author|byline|writer)[^\"']*{Q}"), 20, "Sección de autor con marcas semánticas", None),
        (byline, 12, "Byline visible en el contenido", None),
        (tags.has(html, "<a", f"[^>]+rel={Q}author{Q}"), 10, None, None),
        (None, 0, None, ("high", "No se detecta autor en el contenido", "Añadir autor visible (byline) + schema Person con jobTitle, sameAs y bio.")),
    )
    d.add((text.rlike(rf"(?iu)about{S}+the{S}+author|sobre{S}+el{S}+autor|biograf[íi]a"), 15, "Bio del autor detectada", None), (byline | person, 0, None, ("medium", "Hay autor pero falta bio visible", "Añadir bio breve del autor con experiencia/credenciales.")))
    d.add((html.rlike(r"(?i)linkedin\.com/in/|twitter\.com/|x\.com/"), 10, "Perfil social del autor enlazado", None))
    return d.column()


def factuality(text: Column) -> Column:
    d = Dimension("factuality")
    big = rf"(?i)\d{{1,3}}(?:[.,]\d{{3}})+|\$\d+|€\d+|\d+{S}*(?:millones|billones|millions|billions)"
    measured = rf"(?i)\d+(?:\.\d+)?{S}*(?:kg|km|mph|km/h|ms|s|gb|mb|tb){END}"
    n = count(text, r"\d+(?:\.\d+)?%") + count(text, big) + count(text, measured)
    few = ("high", "Pocos o ningún dato numérico verificable en el contenido", "Los LLMs citan páginas con datos concretos (porcentajes, cifras, mediciones). Añadir estadísticas o datos cuantificables.")
    d.add_for(n, lambda n: [(n >= 5, 50, _said(n, " datos numéricos concretos en el contenido"), None), (n >= 2, 30, _said(n, " datos numéricos detectados"), None), (n == 1, 10, None, None), (None, 0, None, few)])
    d.add((text.rlike(rf"(?iu){START}vs{END}|{START}versus{END}|comparado{S}+con|en{S}+comparación"), 15, "Comparativas detectadas", None))
    cites = count(text, rf"(?iu)seg[uú]n{S}+{NAME}|according{S}+to{S}+{NAME}|fuente:|source:")
    lack = ("medium", 'No se detectan citas explícitas a fuentes ("según X")', 'Atribuir datos a fuentes con frases tipo "según [organismo/estudio]".')
    d.add_for(cites, lambda n: [(n >= 2, 25, _said(n, " citas a fuentes externas"), None), (n == 1, 12, None, None), (None, 0, None, lack)])
    d.add((text.rlike(rf"(?i)(?:entre|from|desde){S}+\d{{4}}{S}+(?:y|to|hasta|and){S}+\d{{4}}"), 10, "Rangos temporales detectados", None))
    return d.column()


def openers(html: Column) -> Column:
    """Names, as written, of the opening tags of lists, tables and quotations, in one search."""
    return every(html, f"(?i)<(ul|ol|table|blockquote){END}", 1)


def _named_as(opened: Column, *names: str) -> Column:
    return F.size(F.filter(opened, lambda x: F.lower(x).isin(*names)))


def structure(html: Column, heads: Column, opened: Column | None = None) -> Column:
    """``opened`` is openers(html) where it is at hand."""
    opened = openers(html) if opened is None else opened
    d, h1, h2, h3 = Dimension("structure"), heads["h1_count"], heads["h2_count"], heads["h3_count"]
    d.add((h1 == 1, 20, "Un único H1 (correcto)", None), (h1 == 0, 0, None, ("high", "No hay H1 en la página", "Añadir un único H1 que describa la página.")), (None, 0, None, ("high", _said(h1, " H1 detectados (debe ser 1)"), "Reducir a un único H1.")))
    d.add((h2 >= 2, 20, _said(h2, " H2 (estructura clara)"), None), (h2 == 1, 10, None, None), (None, 0, None, ("medium", "Falta jerarquía con H2", "Estructurar el contenido con H2 para secciones principales.")))
    d.add((h3 >= 2, 15, _said(h3, " H3 (subdivisión detallada)"), None))
    d.add_for(_named_as(opened, "ul", "ol"), lambda n: [(n >= 3, 20, _said(n, " listas (UL/OL) — formato escaneable"), None), (n >= 1, 12, _said(n, " listas"), None), (None, 0, None, ("medium", "Sin listas en el contenido", "Los LLMs extraen mejor información de listas. Convertir párrafos enumerativos en listas."))])
    d.add_for(_named_as(opened, "table"), lambda n: [(n >= 1, 15, _said(n, " tablas (excelente para datos comparativos)"), None)])
    paragraphs = tags.matches(closed(html, "p"), f"<p{END}", r"[^>]*>[\s\S]*?</p>")
    # Each ends in a closing tag, so no tag goes on into the next one and all can be measured at once.
    average = let(paragraphs, lambda all_of: units(strip_tags(F.array_join(all_of, ""))) / F.nullif(F.size(all_of), F.lit(0)))
    d.add_for(average,lambda x: [(x < 300, 10, "Párrafos cortos (escaneables)", None), (x > 600, 0, None, ("low", "Párrafos muy largos (>600 caracteres promedio)", "Dividir párrafos largos para mejorar escaneabilidad."))])
    return d.column()


def citations(html: Column, external: Column) -> Column:
    d = Dimension("citations")
    pattern = "|".join(a.replace(".", r"\.") for a in AUTHORITIES)
    none = ("medium", "Sin enlaces externos a fuentes", "Citar fuentes externas (estudios, medios, instituciones). Mejora E-E-A-T y citabilidad.")
    n = F.size(external)
    d.add_for(F.size(F.filter(external, lambda x: x["href"].rlike(pattern))), lambda known: [
        (known >= 3, 60, _said(known, " enlaces a fuentes de autoridad"), None),
        (known >= 1, 30, _said(known, " enlace a fuente de autoridad"), None),
        (n >= 3, 20, _said(n, " enlaces externos (sin dominios de autoridad detectados)"), None),
        (n >= 1, 10, None, None),
        (None, 0, None, none),
    ])
    d.add((tags.has(html, "<a", rf"[^>]+rel={Q}[^\"']*nofollow"), 10, 'Uso de rel="nofollow" en enlaces (señal de cuidado editorial)', None))
    d.add((html.rlike(rf"(?iu)<sup{END}[^>]*>{S}*\[?\d+\]?{S}*</sup>|references|referencias|bibliograf[íi]a"), 30, "Sistema de citas/referencias detectado", None))
    return d.column()


def expertise(text: Column, internal: Column, types: Column) -> Column:
    d, organization = Dimension("expertise"), _any(types, ["Organization"])
    people = "PhD|MD|MBA|CFA|CPA|ingeniero|ingeniera|doctor|doctora|profesor|profesora|expert|certificado|certificada|founder|CEO|CTO|director|directora"
    d.add((text.rlike(f"(?i){START}(?:{people}){END}"), 25, "Credenciales/cargos profesionales mencionados", None))
    d.add((F.exists(internal, lambda x: x["href"].rlike("/about|/sobre|/team|/equipo|/nosotros")), 20, 'Página "About"/"Equipo" enlazada', None), (None, 0, None, ("low", "No se enlaza a página About/Equipo", "Enlazar a página de equipo desde footer o autor — refuerza E-E-A-T.")))
    d.add((organization, 20, "Schema Organization presente", None))
    d.add((text.rlike(rf"(?iu)\d+{S}+(?:años|years){S}+(?:de{S}+)?(?:experiencia|experience|en{S}+el{S}+mercado|in{S}+the{S}+industry)"), 15, "Años de experiencia mencionados", None))
    d.add((text.rlike(rf"(?iu)casos{S}+de{S}+[ée]xito|case{S}+stud(?:y|ies)|testimoniales|testimonials"), 15, "Casos de éxito o testimoniales referenciados", None))
    d.add((organization, 10, None, None))
    return d.column()


def machine_readable(record: dict[str, Column], types: Column, blocks: Column) -> Column:
    d = Dimension("machine_readable")
    d.add((blocks >= 3, 35, _said(blocks, " bloques JSON-LD"), None), (blocks >= 1, 20, _said(blocks, " bloque(s) JSON-LD"), None), (None, 0, None, ("high", "Sin schema JSON-LD", "Añadir al menos Organization + WebSite + (Article/Product según tipo).")))
    fit = F.filter(types, lambda t: t.isin(*LLM_TYPES))
    d.add_for(fit, lambda x: [(F.size(x) >= 2, 25, _said("Tipos relevantes para LLMs: ", F.array_join(x, ", ")), None), (F.size(x) == 1, 12, None, None)])
    d.add((record["open_graph"]["ok"], 12, "Open Graph completo", None))
    d.add((record["meta"]["ok"], 8, "Meta description en rango óptimo", None))
    d.add((record["canonical"]["ok"], 8, "Canonical declarado", None))
    lang, n = record["technical"]["lang"], record["hreflang"]["count"]
    d.add((lang.isNotNull(), 5, _said("Idioma declarado: ", lang), None))
    d.add((n >= 2, 7, _said("hreflang con ", n, " variantes"), None))
    return d.column()


def answer_format(html: Column, types: Column, opened: Column | None = None) -> Column:
    """``opened`` is openers(html) where it is at hand."""
    opened = openers(html) if opened is None else opened
    d = Dimension("answer_format")
    d.add((_any(types, ["FAQPage"]), 50, "Schema FAQPage presente (excelente para LLMs)", None), (None, 0, None, ("medium", "Sin schema FAQPage", "Si tienes preguntas frecuentes, añadir schema FAQPage. Los LLMs extraen Q&A literalmente.")))
    d.add((_any(types, ["HowTo"]), 25, "Schema HowTo presente", None))
    d.add((F.exists(tags.matches(html, "<h[2-4]", "[^>]*>([^<]*+)</h[2-4]>", 1), lambda x: x.contains("?")), 20, "Headings con formato pregunta", None))
    d.add((closed(html, "dl").rlike(rf"(?i)<dl{END}[\s\S]*?</dl>"), 15, "Listas de definición (<dl>) — formato perfecto para LLMs", None))
    d.add((_named_as(opened, "blockquote") > 0, 10, "Blockquotes presentes", None))
    short = F.size(F.filter(tags.matches(closed(html, "li"), f"<li{END}", r"[^>]*>[\s\S]*?</li>"), lambda x: units(strip_tags(x)) < 200))
    d.add_for(short, lambda n: [(n >= 5, 10, _said(n, " bullets con respuestas concisas"), None)])
    return d.column()


def with_citability(records: DataFrame, as_of: Column) -> DataFrame:
    """Records with structured data and html, and ``citability``: score, rating, dimensions, signals and gaps.

    ``as_of`` is the time by which dates are recent. Gaps stand by priority, then in the order of dimensions and rules.
    Null where html is null; an empty html scores 0, ``no_data``. Persist the result before filtering on it: a filter
    pushed below these columns would compute them again.
    """
    html, types = F.col("html"), F.coalesce("schema.types", F.expr("cast(array() as array<string>)"))
    r = records.withColumns({"visible": page.visible_text(html), "opened": openers(html)})
    text, rec = F.col("visible"), {n: F.col(n) for n in ("open_graph", "meta", "canonical", "technical", "hreflang")}
    no_links = F.expr("cast(array() as array<struct<href:string,anchor:string>>)")
    made = {
        "freshness": freshness(text, types, as_of),
        "authorship": authorship(html, text, types),
        "factuality": factuality(text),
        "structure": structure(html, F.col("headings"), F.col("opened")),
        "citations": citations(html, F.coalesce("links.external", no_links)),
        "expertise": expertise(text, F.coalesce("links.internal", no_links), types),
        "machine_readable": machine_readable(rec, types, F.coalesce("schema.count", F.lit(0))),
        "answer_format": answer_format(html, types, F.col("opened")),
    }
    empty = F.struct(F.lit(0).alias("score"), F.lit("no_data").alias("rating"), F.lit(None).alias("dimensions"), F.expr("cast(array() as array<struct<dimension:string,message:string>>)").alias("signals"), F.expr(f"cast(array() as array<{GAP}>)").alias("gaps"))
    full = let(F.struct(*[c.alias(n) for n, c in made.items()]), _compiled)
    return r.withColumn("citability", F.when(F.coalesce(html, F.lit("")) != "", full).when(html.isNotNull(), empty)).drop("visible", "opened")


def _compiled(dim: Column) -> Column:
    """Score, rating, signals and gaps of all dimensions."""
    total = half_up(reduce(lambda a, b: a + b, [dim[n]["score"] * F.lit(float(w)) / 100 for n, w in WEIGHTS.items()])).cast("int")
    rating = lambda s: F.when(s >= 75, "excellent").when(s >= 55, "good").when(s >= 30, "needs_improvement").otherwise("poor")
    signals = F.concat(*[_named(n, dim[n]["signals"]) for n in WEIGHTS])
    gaps = F.concat(*[dim[n]["gaps"] for n in WEIGHTS])
    ordered = F.concat(*[_of(gaps, p) for p in PRIORITY])
    return let(total, lambda s: F.struct(s.alias("score"), rating(s).alias("rating"), dim.alias("dimensions"), signals.alias("signals"), ordered.alias("gaps")))


def _named(name: str, signals: Column) -> Column:
    return F.transform(signals, lambda s: F.struct(F.lit(name).alias("dimension"), s.alias("message")))


def _of(gaps: Column, priority: str) -> Column:
    return F.filter(gaps, lambda g: g["priority"] == priority)
