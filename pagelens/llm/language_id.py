"""Language identification: nearest of several TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chain, mix, without

#: Hashed character n-grams of 1 to MAX_GRAM letters.
DIMS, MAX_GRAM = 4096, 3
CENTROIDS = 4
#: Bound of the labelled rows that centroids are fitted on, shared evenly by the languages.
MAX_ROWS = 4000
#: Bound of the languages, CENTROIDS vectors of DIMS floats each, that a model has.
MAX_LANGS = 1000
#: A text is rejected if its similarity is under this part of the lowest that fitted texts of like length reach.
REJECT = 0.5
LENGTH_BINS = 12
#: Characters of a text that are looked at in one go.
STRETCH = 1 << 20
UNDETERMINED = "und"
_LETTERS: list[np.ndarray] = []


def learnable(doc_id: Column) -> Column:
    """True for rows that may be learned from: CRC-32 of the id as text is not 2 modulo 4. Null is not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def _letters() -> np.ndarray:
    """Is-a-letter of every code point, built once a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of STRETCH characters, cut where no letter stands if there is such a place nearby."""
    lo = 0
    while len(text) - lo > STRETCH:
        hi = next((i for i in range(lo + STRETCH, lo + STRETCH - 1000, -1) if not text[i].isalpha()), lo + STRETCH)
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts ``(text, dimension)`` of hashed character n-grams, and each text's number of letters.

    Letters are lower-cased; whatever stands between them counts as one space. N-grams don't cross texts. A long text
    is counted piece by piece.
    """
    if len(texts) == 1 and len(texts[0]) > STRETCH:
        counted = [gram_counts([p]) for p in _pieces(texts[0])]
        return sum(c for c, _ in counted), sum(n for _, n in counted)
    joined = [f" {t.lower()} \0" for t in texts]
    cp = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in joined])
    letter = _letters()[cp]
    cp = np.where(letter | (cp == 0), cp, 32)
    keep = letter | (cp == 0) | np.concatenate(([True], cp[1:] != cp[:-1]))
    n_letters = np.bincount(row[letter], minlength=len(texts))
    cp, row = cp[keep].astype(np.uint64), row[keep]
    counts = np.zeros(len(texts) * DIMS, np.float32)
    space, end = cp == 32, cp == 0
    for n in range(1, MAX_GRAM + 1):
        m = len(cp) - n + 1
        parts = [cp[i : i + m] for i in range(n)]
        ok = ~end[:m]
        for i in range(1, n):
            ok &= ~end[i : i + m]
        if n == 1:
            ok &= ~space
        for i in range(1, n - 1):
            ok &= ~space[i : i + m]  # no n-gram spans two words
        h = mix(chain(*parts) if n > 1 else parts[0] + np.uint64(1 << 40))
        at = row[:m][ok] * DIMS + (h[ok] % np.uint64(DIMS)).astype(np.int64)
        counts += np.bincount(at, minlength=len(counts)).astype(np.float32)
    return counts.reshape(-1, DIMS), n_letters


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _bins(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(np.int64), LENGTH_BINS - 1)


def _groups(texts: pa.Array, chars: int = 200_000, rows: int = 64) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of a bounded size: first row and texts."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        t = t.as_py() or ""
        if held and (len(held) == rows or size + len(t) > chars):
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t)
    if held:
        yield first, held


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    #: Least similarity by length bin; texts under it are rejected.
    floor: np.ndarray


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(dim, df)`` over all rows of ``docs(text)``; dimension -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for _, texts in _groups(b.column(0)):
                df[1:] += (gram_counts(texts)[0] > 0).sum(axis=0)
                df[0] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(df)], ["dim", "df"])

    return docs.select("text").mapInArrow(run, "dim long, df long").groupBy("dim").agg(F.sum("df").alias("df"))


def _cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out first centres; deterministic."""
    c = x[:1]
    while len(c) < min(k, len(x)):
        c = np.vstack((c, x[[int((x @ c.T).max(axis=1).argmin())]]))
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    return c


def _sample(rows: DataFrame, max_rows: int, max_langs: int) -> DataFrame:
    """``(lang, k)`` of at most ``max_rows`` distinct texts, evenly by language, those of the least hashes ``k``.

    A language's count tells how small a hash must about be, so few rows are left when each language is ranked; copies
    of a text are one row before that.
    """
    count = rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("n"))
    sizes = {r["lang"]: r["n"] for r in count.orderBy(F.desc("n"), "lang").limit(max_langs).collect()}  # as long as the model
    share = max(1, max_rows // max(1, len(sizes)))
    n = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")] if sizes else F.lit(0)
    place = F.pmod("k", F.lit(1 << 30)) / float(1 << 30)
    few = rows.where(place * n <= 1.25 * share + 50).distinct()
    return few.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("k"))).where(F.col("r") <= share).select("lang", "k")


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, centroids: int = CENTROIDS, max_langs: int = MAX_LANGS) -> Model:
    """A model from the learnable rows of ``docs(doc_id, text, lang)`` with a lang and a text.

    Document frequencies come from all of these rows; the centroids from at most ``max_rows`` distinct texts, evenly
    by language, chosen by a hash of the text, so neither a repeated doc_id nor copies fill the sample. Of more than
    ``max_langs`` languages the most frequent are learned (at most ``max_rows``, so that each has a text). A table
    with no such row gives a model that leaves all undetermined.
    """
    rows = docs.select("text", "lang", F.xxhash64("text").alias("k")).where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = _sample(rows.select("lang", "k"), max_rows, min(max_langs, max_rows))
    df = {r["dim"]: r["df"] for r in document_frequencies(rows).collect()}  # DIMS + 1 rows
    n = df.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIMS)]))).astype(np.float32) + np.float32(1)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, list[np.ndarray]] = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            for at, texts in _groups(b.column(0)):
                counts, letters = gram_counts(texts)
                x = _vectors(counts, idf)
                for i in np.flatnonzero(letters > 0).tolist():
                    found.setdefault(langs[at + i], []).append(x[i].astype(np.float16))
                    sizes.setdefault(langs[at + i], []).append(letters[i])
        names, centres = [], []
        for lang in sorted(found):
            c = _cluster(np.array(found[lang], np.float32), centroids)
            names += [lang] * len(c)
            centres += list(c)
        if not names:
            return
        c = np.array(centres)
        floor = np.ones(LENGTH_BINS)
        for lang in found:
            best = (np.array(found[lang], np.float32) @ c.T).max(axis=1)
            np.minimum.at(floor, _bins(np.array(sizes[lang])), best)
        floor = np.minimum.accumulate(floor[::-1])[::-1]  # shorter texts are never held to more than longer ones
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(list(c), pa.list_(pa.float32())), pa.array([floor] * len(names), pa.list_(pa.float64()))], ["lang", "centre", "floor"])

    picked = rows.join(F.broadcast(chosen), ["lang", "k"], "left_semi").dropDuplicates(["lang", "k"])  # max_rows rows at most
    ordered = picked.repartition(1).sortWithinPartitions("k", "lang").select("text", "lang")
    got = ordered.mapInArrow(train, "lang string, centre array<float>, floor array<double>").collect()
    got.sort(key=lambda r: r["lang"])
    return Model(idf, np.array([r["centre"] for r in got], np.float32).reshape(-1, DIMS), [r["lang"] for r in got], np.array(got[0]["floor"] if got else [0.0] * LENGTH_BINS))


def predict(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """All columns of ``docs(text, ...)`` and a struct ``language_id(lang, score, rejected)``.

    ``lang`` is the language of the nearest centroid by cosine and ``score`` that cosine, 0 to 1. A text that is null
    or has no letter is ``und`` with score 0 and rejected. Others are rejected, their nearest language kept, if the
    score is under ``reject`` times the lowest that fitted texts of their length reach. The text alone decides.
    Repeated rows repeat; a column ``language_id`` of ``docs`` is replaced.
    """
    docs = without(docs, "language_id")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats a centroid, of a bounded fit
    own = "lang string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, out = [], [], []
            for _, texts in _groups(b.column(at)):
                counts, letters = gram_counts(texts)
                if len(m.langs):
                    sim = _vectors(counts, m.idf) @ m.centroids.T
                    best = sim.argmax(axis=1)
                    score = np.clip(sim.max(axis=1).astype(np.float64), 0, 1).round(6)
                else:
                    best, score = np.zeros(len(texts), int), np.zeros(len(texts))
                none = (letters == 0) | (len(m.langs) == 0)
                langs += [UNDETERMINED if x else m.langs[i] for x, i in zip(none, best)]
                scores.append(np.where(none, 0.0, score))
                out.append(none | (score < reject * m.floor[_bins(letters)]))
            if not b.num_rows:
                continue
            arrays = [pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(out))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(arrays, ["lang", "score", "rejected"])], [*b.schema.names, "language_id"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("language_id", T.StructType.fromDDL(own))]))


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` for every row of ``docs(doc_id, text, lang)``."""
    rows = predict(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("language_id.lang").alias("lang_pred"), F.col("language_id.score").alias("score"), F.col("language_id.rejected").alias("rejected"))
