"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chain, row_groups, text_buffer, without, word_hashes

#: Hashed features: words, pairs of neighbours, and pairs with one or two words between them.
DIMS = 1 << 20
GAPS = (1, 2, 3)
#: Bound of the labelled rows that weights are learned from, chosen by a hash of doc_id.
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
THRESHOLD = 0.3
GROUP_BYTES = 1 << 20


@dataclass
class Model:
    """Weights that aren't zero, by ascending feature, and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def learnable(doc_id: Column) -> Column:
    """True for rows that may be learned from: CRC-32 of the id as text is not 2 modulo 4. Null is not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text as (row, feature), sorted by row and feature. Words never pair across texts."""
    h, row, _, _ = word_hashes(data, offsets)
    found, rows = [h], [row]
    for gap in GAPS:
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            found.append(chain(h[:-gap], h[gap:] + np.uint64(gap))[same])
            rows.append(row[:-gap][same])
    joint = np.unique(np.concatenate(rows).astype(np.int64) * DIMS + (np.concatenate(found) % np.uint64(DIMS)).astype(np.int64))
    return joint // DIMS, joint % DIMS


class Ftrl:
    """Per-coordinate FTRL-proximal state (McMahan et al. 2013) over features of value 1 and an intercept."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == DIMS, 0.0, L1)  # the intercept isn't shrunk to zero
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, DIMS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Model:
    """Weights from the learnable rows of ``docs(doc_id, text)`` with a ``toxic`` of 0 or 1 in ``labels(doc_id, toxic)``.

    At most ``max_rows`` of them, chosen and ordered by a hash of doc_id, pass through one task; what leaves it are
    the weights that L1 left. Of rows that share a doc_id the one whose text has the least hash is learned from, with
    each of the id's labels. Without such rows every score is 1/2. Null texts count as empty.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learnable(F.col("doc_id")) & F.col("toxic").isin(0, 1)).distinct()
    chosen = known.orderBy(*order).limit(max_rows)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, int]] = []
        for b in batches:
            data, off = text_buffer(b.column(0))
            label = b.column(1).to_numpy()
            for lo, hi in row_groups(off, GROUP_BYTES):
                row, at = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                seen += [(at[s:e].astype(np.int32), int(y)) for s, e, y in zip(cut[:-1], cut[1:], label[lo:hi])]
        model = Ftrl()
        for _ in range(epochs):
            for at, y in seen:
                model.learn(at, y)
        w = model.weights(np.arange(DIMS + 1))
        at = np.append(np.flatnonzero(w[:-1]), DIMS)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["feature", "weight"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has max_rows rows at most
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))  # as many
    ordered = rows.repartition(1).sortWithinPartitions(*order).select("text", "toxic")
    got = sorted((r["feature"], r["weight"]) for r in ordered.mapInArrow(train, "feature long, weight double").collect())
    bias = next((w for at, w in got if at == DIMS), 0.0)
    got = [x for x in got if x[0] < DIMS]
    return Model(np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got]), bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs(text, ...)`` and ``toxicity``, 0 to 1, higher for likelier toxic; the text alone decides.

    Null and empty texts get what the intercept gives. Repeated rows repeat; an empty table gives no rows. A column
    ``toxicity`` of ``docs`` is replaced.
    """
    docs = without(docs, "toxicity")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.zeros(DIMS)
        table[m.features] = m.weights
        for b in batches:
            data, off = text_buffer(b.column(at))
            out = np.empty(b.num_rows)
            for lo, hi in row_groups(off, GROUP_BYTES):
                row, f = features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                out[lo:hi] = m.bias + np.bincount(row, table[f], minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], [*b.schema.names, "toxicity"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))
