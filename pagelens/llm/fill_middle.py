"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, found by one repeated-capture match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_groups, text_buffer, unused, without

#: Lines; a fullmatch keeps the end of each repetition of group 1. A unit never gives characters back.
UNITS = regex.compile(r"([^\n]*+\n|[^\n]++)*+")
#: Sentinels before prefix, suffix and middle. A text that holds one stays plain, so they are found again surely.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 7, 100, 50
GROUP_BYTES = 1 << 23
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws for a document, from the hex SHA-256 of ``seed:doc_id``; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def arrange(text: str, h: tuple[int, int, int, int], rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of prefix and middle (None if plain), and the text rearranged by draws ``h``."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m = (ends[k - 1] if k else 0 for k in (first, last))
    if h[3] % 100 < spm_rate:
        return n, "spm", p, m - p, "".join((SUFFIX, text[m:], PREFIX, text[:p], MIDDLE, text[p:m]))
    return n, "psm", p, m - p, "".join((PREFIX, text[:p], SUFFIX, text[m:], MIDDLE, text[p:m]))


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` and ``fim(n, form, prefix_chars, middle_chars, output)``.

    A text is ``n`` lines, each with its line feed if it has one. Prefix, middle and suffix are whole lines, cut at two
    draws made from doc_id alone, so reruns and any partitioning agree. ``rate`` per cent of the documents change, of
    these ``spm_rate`` per cent to suffix-prefix-middle order, the rest to prefix-suffix-middle. Null and empty texts
    (null counts as empty) and texts that hold a sentinel are ``plain``: the output is the text, the counts null.
    Counts are code points. Rows that repeat give equal rows; an empty table gives none; a column ``fim`` is replaced.
    A text is held with its output, one batch at a time.
    """
    docs = without(docs, "fim")
    key = unused(docs, "draws")
    at, held = docs.columns.index("text"), docs.withColumn(key, F.array(*draws(F.col("doc_id"), seed)))
    out = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = text_buffer(b.column(at))
            for lo, hi in row_groups(offsets, GROUP_BYTES):
                part = b.slice(lo, hi - lo)
                h = part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, 4)
                rows = [arrange(t or "", tuple(map(int, x)), rate, spm_rate) for t, x in zip(part.column(at).to_pylist(), h)]
                fim = pa.array([dict(zip(out.names, r)) for r in rows], out)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], fim], [*part.schema.names[:-1], "fim"])

    return held.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("fim", T.StructType.fromDDL(RESULT))]))


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle() was given, from its output and form alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        s, m = F.instr(output, second), F.instr(output, MIDDLE)
        begin = F.lit(len(first) + 1)
        return F.substring(output, begin, s - begin), F.substring(output, s + len(second), m - s - len(second)), F.substring(output, m + len(MIDDLE), F.length(output))

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def digest(done: DataFrame) -> DataFrame:
    """One row per document: counts, form, and hashes of the output and of the text rebuilt from it."""
    fim, sha = F.col("fim"), lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", fim["n"].alias("n"), fim["form"].alias("form"), fim["prefix_chars"].alias("prefix_chars"), fim["middle_chars"].alias("middle_chars"),
                       sha(fim["output"]).alias("output_sha256"), sha(restored(fim["output"], fim["form"])).alias("restored_sha256"))


SQL = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
        ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""
