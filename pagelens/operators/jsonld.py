"""Structured data: JSON-LD blocks of a page, their validation, answer-engine score and recommendations.

One Arrow helper parses and flattens the JSON; all else is column expressions on a page's arrays, so nothing shuffles.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tags
from ..functions.text import closed, half_up, let, no_strings

SCRIPT = rf"[^>]+type={tags.Q}application/ld\+json{tags.Q}[^>]*>([\s\S]*?)</script>"

# Required, recommended and answer-critical fields of each type.
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
# Weight and reason of the types that answer engines cite.
WEIGHTS = {
    "Organization": (10, "LLMs verifican la entidad como real"),
    "WebSite": (8, "Permite a LLMs sugerir búsquedas internas"),
    "Article": (10, "LLMs citan con autor y fecha verificables"),
    "BlogPosting": (9, "Igual que Article para contenido editorial"),
    "NewsArticle": (10, "Crítico para que aparezca en News + LLMs"),
    "FAQPage": (10, "LLMs extraen Q&A literalmente"),
    "HowTo": (9, "LLMs reproducen pasos en respuestas"),
    "Person": (8, "Credibilidad del autor (E-E-A-T)"),
    "BreadcrumbList": (6, "Contexto jerárquico para entender la página"),
    "Product": (8, "LLMs comparan productos con datos estructurados"),
    "Review": (7, "Citas con valoraciones reales"),
    "LocalBusiness": (9, "Crítico para queries locales en LLMs"),
    "Service": (7, "Permite a LLMs entender qué ofreces"),
    "SoftwareApplication": (8, "Para SaaS, define el producto claramente"),
    "Event": (7, "LLMs muestran eventos con datos completos"),
    "Course": (7, "Educación: LLMs derivan a cursos estructurados"),
    "Recipe": (6, "Citas con ingredientes/pasos exactos"),
    "VideoObject": (6, "Indexación de contenido audiovisual"),
}
FULL_SCORE, PENALTY = 50, 2
# Schemas a page should have. Page types (None: any), types of which one will do, name, priority, reason, fields.
EXPECTED = [
    (None, ["Organization"], "Organization", "high", "Identifica la entidad. Sin esto, LLMs no pueden verificar que el sitio represente una empresa real.", ["name", "url", "logo", "sameAs", "description"]),
    (None, ["WebSite"], "WebSite", "medium", "Permite a buscadores y LLMs entender la estructura del sitio. Habilita búsquedas internas vía SearchAction.", ["name", "url", "potentialAction"]),
    (None, ["BreadcrumbList"], "BreadcrumbList", "medium", "Da contexto jerárquico de cada página. Útil para entender de qué trata.", ["itemListElement"]),
    ("blog|article|news", ["Article", "BlogPosting", "NewsArticle"], "Article (o BlogPosting / NewsArticle)", "high", "Página de blog/artículo sin schema. LLMs no pueden citar autor, fecha o entidad publicadora.", ["headline", "author", "datePublished", "image"]),
    ("product|shop", ["Product"], "Product", "high", "Página de producto sin schema. Pierde rich snippets de precio, rating y disponibilidad.", ["name", "image", "description", "offers", "aggregateRating"]),
    ("faq|preguntas", ["FAQPage"], "FAQPage", "high", "Página de FAQ sin schema. LLMs no pueden extraer Q&A para responder con citas literales.", ["mainEntity (con Questions)"]),
    ("local|contact|store", ["LocalBusiness"], "LocalBusiness", "high", 'Negocio local sin schema. Pierde aparición en mapas, horarios y queries de "cerca de mí".', ["name", "address", "telephone", "openingHours", "geo"]),
]
FLAGS = [("organization", ["Organization"]), ("website", ["WebSite"]), ("article", ["Article", "BlogPosting"]), ("product", ["Product"]), ("faq", ["FAQPage"]), ("howto", ["HowTo"]), ("breadcrumb", ["BreadcrumbList"]), ("local_business", ["LocalBusiness"])]

_SPACE = "\t\n\x0b\f\r \u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _parse(text: str) -> object:
    return json.loads(text.strip(_SPACE), parse_constant=_no_constant)


def _word(v: object) -> str:
    return v if isinstance(v, str) else "[object Object]" if isinstance(v, dict) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def _present(v: object) -> bool:
    return not (v is None or isinstance(v, str) and not v.strip(_SPACE) or isinstance(v, list) and not v)


def _true(v: object) -> bool:
    return isinstance(v, (dict, list)) or bool(v)


def _get(v: object, key: str) -> object:
    return v.get(key) if isinstance(v, dict) else None


def _flatten(parsed: list) -> list[dict]:
    """Typed objects in document order, each with the nearest context; a typed parent of a @graph comes before it."""
    out, todo = [], [(v, None) for v in reversed(parsed)]
    while todo:
        v, inherited = todo.pop()
        if isinstance(v, list):
            todo += [(x, inherited) for x in reversed(v)]
        elif isinstance(v, dict):
            context = v.get("@context") if _true(v.get("@context")) else inherited
            graph = v.get("@graph")
            if _true(graph):
                todo += [(x, context) for x in reversed(graph if isinstance(graph, list) else [graph])]
            if _true(v.get("@type")) or _true(v.get("_invalid")) and not _true(graph):
                out.append(_fact({k: x for k, x in v.items() if k != "@graph" or not _true(graph)}, context))
    return out


def _fact(block: dict, context: object) -> dict:
    if _true(block.get("_invalid")):
        return {"invalid": True, "type": None, "context": None, "fields": [], "faq": [], "steps": []}
    kind = block["@type"]
    kind = (kind[0] if kind else None) if isinstance(kind, list) else kind
    text = None if context is None else context if isinstance(context, str) else " ".join(map(_word, context)) if isinstance(context, list) else json.dumps(context, ensure_ascii=False, separators=(",", ":"))
    items = lambda name: v if isinstance(v := block.get(name), list) else [] if v is None else [v]
    faq, steps = [], []
    if kind == "FAQPage":
        for q in items("mainEntity"):
            a = _get(q, "acceptedAnswer")
            faq.append({"question": _get(q, "@type") == "Question", "name": _true(_get(q, "name")), "answer": _true(a), "answer_type": _get(a, "@type") == "Answer", "text": _true(_get(a, "text"))})
    if kind == "HowTo":
        for s in items("step"):
            t = _get(s, "@type")
            steps.append({"odd_type": _true(t) and t not in ("HowToStep", "HowToSection"), "body": _true(_get(s, "text")) or _true(_get(s, "itemListElement"))})
    return {"invalid": False, "type": None if kind is None else _word(kind), "context": text, "fields": [k for k, v in block.items() if _present(v)], "faq": faq, "steps": steps}


def _collect(v: object, types: dict[str, None]) -> None:
    todo = [v]
    while todo:
        v = todo.pop()
        if isinstance(v, list):
            todo += reversed(v)
        elif isinstance(v, dict):
            kind = v.get("@type")
            if _true(kind):
                types.update(dict.fromkeys(_word(t) for t in (kind if isinstance(kind, list) else [kind])))
            if _true(v.get("@graph")):
                todo.append(v["@graph"])


def _quick(v: object, types: dict[str, None]) -> None:
    """One level only; a member that can't have a type ends the block."""
    items = v if isinstance(v, list) else _get(v, "@graph") if _true(_get(v, "@graph")) else [v]
    for it in items if isinstance(items, list) else []:
        if it is None:
            return
        kind = _get(it, "@type")
        if _true(kind):
            types.update(dict.fromkeys(_word(t) for t in (kind if isinstance(kind, list) else [kind])))


_PARSED = T.StructType([T.StructField("count", T.IntegerType()), T.StructField("types", T.ArrayType(T.StringType())), T.StructField("quick_types", T.ArrayType(T.StringType())), T.StructField("blocks", T.ArrayType(T.StructType([
    T.StructField("invalid", T.BooleanType()), T.StructField("type", T.StringType()), T.StructField("context", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("faq", T.ArrayType(T.StructType([T.StructField(n, T.BooleanType()) for n in ("question", "name", "answer", "answer_type", "text")]))),
    T.StructField("steps", T.ArrayType(T.StructType([T.StructField(n, T.BooleanType()) for n in ("odd_type", "body")])))])))])


@F.pandas_udf(_PARSED)
def parse_blocks(scripts: pd.Series) -> pd.DataFrame:
    """Of a page's JSON-LD scripts: number, types in order of first sight, types by the quick rule, flattened blocks."""
    rows = []
    for bodies in scripts:
        types: dict[str, None] = {}
        quick: dict[str, None] = {}
        blocks: list = []
        for body in bodies if bodies is not None else ():
            try:
                v = _parse(body)
            except (ValueError, RecursionError):
                v = {"_invalid": True}
            else:
                _collect(v, types)
                _quick(v, quick)
            blocks.append(v)
        rows.append((len(blocks), list(types), list(quick), _flatten(blocks)))
    return pd.DataFrame(rows, columns=["count", "types", "quick_types", "blocks"])


def scripts(html: Column) -> Column:
    return tags.bodies(closed(html, "script"), "<script", SCRIPT)


def has_flags(types: Column) -> list[Column]:
    return [F.arrays_overlap(types, F.array(*map(F.lit, names))).alias(f"has_{flag}") for flag, names in FLAGS]


def schema_record(parsed: Column) -> Column:
    """Number of blocks, types and flags of a page."""
    return F.struct(parsed["count"].alias("count"), parsed["types"].alias("types"), *has_flags(parsed["types"]))


def quick_schema(parsed: Column) -> Column:
    """The same by the quick rule, where news counts as an article."""
    types = parsed["quick_types"]
    flags = [F.arrays_overlap(types, F.array(*map(F.lit, [*names, *(["NewsArticle"] if flag == "article" else [])]))).alias(f"has_{flag}") for flag, names in FLAGS]
    return F.struct(parsed["count"].alias("count"), types.alias("types"), (parsed["count"] > 0).alias("has_schema"), *flags)


def _texts(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else no_strings()


def _spec() -> Column:
    entries = [x for name, parts in SPECS.items() for x in (F.lit(name), F.struct(*[_texts(*p).alias(n) for n, p in zip(("required", "recommended", "critical"), parts)]))]
    return F.create_map(*entries)


def _when(condition: Column, *texts: Column) -> Column:
    return F.when(condition, F.array(*texts)).otherwise(no_strings())


def _lines(array: Column, line) -> Column:
    """All messages that ``line(item, index)`` gives for the items, in order."""
    return F.flatten(F.transform(array, line))


def _faq_errors(b: Column) -> Column:
    def line(q: Column, i: Column) -> Column:
        n = i.cast("string")
        wrong = F.array(F.concat(F.lit("FAQPage: mainEntity["), n, F.lit("] debe ser @type=Question")))
        name = _when(~q["name"], F.concat(F.lit("FAQPage: Question["), n, F.lit('] sin "name" (la pregunta)')))
        answer = _when(~q["answer"], F.concat(F.lit("FAQPage: Question["), n, F.lit('] sin "acceptedAnswer"')))
        text = _when(q["answer"] & ~q["text"], F.concat(F.lit("FAQPage: Question["), n, F.lit('].acceptedAnswer sin "text"')))
        return F.when(~q["question"], wrong).otherwise(F.concat(name, answer, text))

    empty = F.array(F.lit("FAQPage: mainEntity vacío (debe contener Questions)"))
    return F.when(b["type"] == "FAQPage", F.when(F.size(b["faq"]) == 0, empty).otherwise(_lines(b["faq"], line))).otherwise(no_strings())


def _faq_warnings(b: Column) -> Column:
    return _lines(b["faq"], lambda q, i: _when(q["question"] & q["answer"] & ~q["answer_type"], F.concat(F.lit("FAQPage: Question["), i.cast("string"), F.lit("].acceptedAnswer debería ser @type=Answer"))))


def _howto_errors(b: Column) -> Column:
    line = lambda s, i: _when(~s["body"], F.concat(F.lit("HowTo: step["), i.cast("string"), F.lit('] sin "text" ni "itemListElement"')))
    return F.when(b["type"] == "HowTo", F.when(F.size(b["steps"]) == 0, F.array(F.lit('HowTo: "step" vacío'))).otherwise(_lines(b["steps"], line))).otherwise(no_strings())


def _howto_warnings(b: Column) -> Column:
    return _lines(b["steps"], lambda s, i: _when(s["odd_type"], F.concat(F.lit("HowTo: step["), i.cast("string"), F.lit("] debería ser @type=HowToStep o HowToSection"))))


def _verdict(b: Column, i: Column, spec: Column) -> Column:
    """``{index,type,valid,errors,warnings,aeo_issues,score,unknown_type}`` of one block."""
    no_context = F.coalesce(b["context"], F.lit("")) == ""
    context = F.when(no_context, F.array(F.lit("Falta @context"))).when(~b["context"].rlike("(?i)schema\\.org"), F.array(F.concat(F.lit("@context no apunta a schema.org (encontrado: "), F.substring(b["context"], 1, 50), F.lit(")")))).otherwise(no_strings())
    missing = lambda part: F.filter(spec[part], lambda f: ~F.array_contains(b["fields"], f))
    named = lambda part, lead: F.transform(missing(part), lambda f: F.concat(F.lit(lead), F.lit('"'), f, F.lit('" en '), b["type"]))
    share = lambda part: 1 - F.size(missing(part)) / F.greatest(F.size(spec[part]), F.lit(1))
    known = spec.isNotNull()
    errors = F.when(b["invalid"], F.array(F.lit("JSON-LD inválido (no se pudo parsear)"))).when(known, F.concat(context, named("required", "Falta campo requerido "), _faq_errors(b), _howto_errors(b))).otherwise(context)
    unknown = F.array(F.concat(F.lit('Tipo "'), F.coalesce(b["type"], F.lit("undefined")), F.lit('" no está en nuestro catálogo (puede ser válido pero no validado en detalle)')))
    warnings = F.when(b["invalid"], no_strings()).when(known, F.concat(named("recommended", "Falta campo recomendado "), _faq_warnings(b), _howto_warnings(b))).otherwise(unknown)
    critical = F.transform(missing("critical"), lambda f: F.concat(F.lit('AEO: añadir "'), f, F.lit('" mejora citabilidad de '), b["type"]))

    def verdict(e: Column) -> Column:
        valid = F.size(e) == 0
        score = F.when(b["invalid"], 0.0).when(known, half_up((share("required") * 0.7 + share("recommended") * 0.3) * 100) / 100).when(valid, 0.5).otherwise(0.0)
        return F.struct(i.alias("index"), b["type"].alias("type"), valid.alias("valid"), e.alias("errors"), warnings.alias("warnings"), F.when(known & ~b["invalid"], critical).otherwise(no_strings()).alias("aeo_issues"), score.alias("score"), (~known & ~b["invalid"]).alias("unknown_type"))

    return let(errors, verdict)


def validate(blocks: Column) -> Column:
    """A verdict for each flattened block, in order."""
    spec = _spec()
    return F.transform(blocks, lambda b, i: let(F.try_element_at(spec, F.coalesce(b["type"], F.lit(""))), lambda s: _verdict(b, i, s)))


def detected(verdicts: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(verdicts, lambda v: v["type"]), lambda t: F.coalesce(t, F.lit("")) != ""))


def summary(verdicts: Column) -> Column:
    bad = F.filter(verdicts, lambda v: ~v["valid"])
    failed = F.filter(F.transform(bad, lambda v: v["type"]), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.struct(F.size(verdicts).alias("total_blocks"), (F.size(verdicts) - F.size(bad)).alias("valid_blocks"), F.size(bad).alias("invalid_blocks"), detected(verdicts).alias("detected_types"), failed.alias("types_with_errors"))


def aeo_score(verdicts: Column) -> Column:
    """Answer-engine score: weights of distinct valid types less a penalty for broken blocks of weighted types."""
    weights = F.create_map(*[x for name, (w, reason) in WEIGHTS.items() for x in (F.lit(name), F.struct(F.lit(w).alias("weight"), F.lit(reason).alias("reason")))])
    heavy = lambda t: F.coalesce(t, F.lit("")).isin(*WEIGHTS)
    valid = F.array_distinct(F.transform(F.filter(verdicts, lambda v: v["valid"] & heavy(v["type"])), lambda v: v["type"]))
    broken = F.size(F.filter(verdicts, lambda v: ~v["valid"] & heavy(v["type"])))
    rows = F.transform(valid, lambda t, i: F.struct((-weights[t]["weight"]).alias("w"), i.alias("i"), t.alias("type"), weights[t]["reason"].alias("reason")))
    earned = F.aggregate(valid, F.lit(0), lambda a, t: a + weights[t]["weight"])
    score = F.least(F.lit(100), half_up(F.greatest(F.lit(0), earned - PENALTY * broken) / FULL_SCORE * 100)).cast("int")
    rated = lambda s: F.when(s >= 70, "excellent").when(s >= 40, "good").when(s >= 15, "needs_improvement").otherwise("poor")
    types = F.transform(F.array_sort(rows), lambda r: F.struct(r["type"].alias("type"), (-r["w"]).alias("weight"), r["reason"].alias("reason")))
    return let(score, lambda s: F.struct(s.alias("score"), rated(s).alias("rating"), types.alias("detected_types"), broken.alias("invalid_aeo_blocks")))


def missing_schemas(types: Column, page_type: Column) -> Column:
    """Schemas that a page of its type should have and doesn't: ``array<struct<type,priority,reason,example_fields>>``."""
    rows = []
    for where, either, name, priority, reason, fields in EXPECTED:
        lacks = ~F.arrays_overlap(types, _texts(*either))
        here = lacks if where is None else lacks & F.coalesce(F.lower(page_type), F.lit("")).rlike(where)
        rows.append(F.when(here, F.struct(F.lit(name).alias("type"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"), _texts(*fields).alias("example_fields"))))
    return F.array_compact(F.array(*rows))


def recommendations(verdicts: Column, missing: Column) -> Column:
    """What to do, in five phases: errors, missing of high priority, warnings, answer issues, other missing."""

    def rec(priority: Column, category: str, kind: Column, message: Column, fields: Column | None = None) -> Column:
        return F.struct(priority.alias("priority"), F.lit(category).alias("category"), kind.alias("schema_type"), message.alias("message"), (fields if fields is not None else F.lit(None).cast("array<string>")).alias("example_fields"))

    def of(rows: Column, part: str, priority: str, category: str) -> Column:
        return F.flatten(F.transform(rows, lambda v: F.transform(v[part], lambda m: rec(F.lit(priority), category, v["type"], m))))

    def add(rows: Column, lead: str) -> Column:
        return F.transform(rows, lambda m: rec(m["priority"], "add_schema", m["type"], F.concat(F.lit(lead), m["type"], F.lit(": "), m["reason"]), m["example_fields"]))

    return F.concat(
        of(F.filter(verdicts, lambda v: ~v["valid"]), "errors", "high", "fix_existing"),
        add(F.filter(missing, lambda m: m["priority"] == "high"), "Añadir schema "),
        of(verdicts, "warnings", "medium", "enhance_existing"),
        of(verdicts, "aeo_issues", "medium", "aeo_improvement"),
        add(F.filter(missing, lambda m: m["priority"] != "high"), "Considerar schema "),
    )


def with_structured_data(records: DataFrame) -> DataFrame:
    """``records(html, page_type, ...)`` with ``parsed``, ``schema``, ``verdicts`` and ``schema_validation``.

    All null where html is null.
    """
    r = records.withColumn("parsed", parse_blocks(F.when(F.col("html").isNotNull(), scripts(F.col("html")))))
    r = r.withColumn("verdicts", F.when(F.col("html").isNotNull(), validate(F.col("parsed.blocks"))))
    v, missing = F.col("verdicts"), missing_schemas(detected(F.col("verdicts")), F.col("page_type"))
    check = let(missing, lambda m: F.struct(summary(v).alias("summary"), aeo_score(v).alias("aeo"), m.alias("missing_schemas"), recommendations(v, m).alias("recommendations")))
    there = F.col("html").isNotNull()
    return r.withColumns({"schema": F.when(there, schema_record(F.col("parsed"))), "schema_validation": F.when(there, check)})
