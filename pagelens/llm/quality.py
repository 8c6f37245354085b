"""Quality: multiple-instance learning with gated attention over the passages of a text (Ilse et al. 2018)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix, row_groups, text_buffer, without, word_hashes

#: Words of a passage; words are what stands between white space.
PASSAGE = 64
#: Kinds of byte whose pairs are counted, and buckets of hashed byte trigrams.
CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".", b",;:", b"!?", b"'\"()-", b"#$%&*@^~", b"|<>{}[]/\\=+_`"]
TRIGRAMS = 256
N_CLASSES = len(CLASSES) + 2  # other ASCII, bytes of longer characters
STATS = 8
WIDTH = N_CLASSES**2 + TRIGRAMS + STATS
#: Units of the passage encoder and of the attention.
UNITS, GATES = 32, 16
#: Bound of the labelled rows that the model is learned from, chosen by a hash of doc_id.
MAX_ROWS = 4_000
EPOCHS, BATCH, RATE, DECAY = 25, 64, 3e-3, 1e-4
THRESHOLD = 0.5
GROUP_BYTES = 1 << 20
RESULT = "score double, attention array<double>"

_KIND = np.full(256, N_CLASSES - 2, np.int64)
for _i, _of in enumerate(CLASSES):
    _KIND[list(_of)] = _i
_KIND[128:] = N_CLASSES - 1
_WORD = np.arange(256, dtype=np.uint8)
_WORD[[0, *b" \t\n\v\f\r"]] = 0  # NUL ends words too

Weights = dict[str, np.ndarray]


def learnable(doc_id: Column) -> Column:
    """True for rows that may be learned from: CRC-32 of the id as text is not 1 modulo 3. Null is not learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of concatenated texts, and the number of passages of each text (1 if it has no word).

    Roots of the shares of byte-class pairs and of hashed byte trigrams, and facts about the words. A passage has the
    bytes from its first word on to the next passage's; what stands before the first word belongs to it too.
    """
    h, row, start, end = word_hashes(data, offsets, _WORD)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    count = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(count) - count
    of = first[row] + (np.arange(len(row)) - (np.cumsum(n_words) - n_words)[row]) // PASSAGE  # passage of each word
    n = int(count.sum())
    out = np.zeros((n, WIDTH), np.float32)
    begin = np.zeros(n, np.int64)
    begin[first] = offsets[:-1]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else of
    inner = ~np.isin(of[head], first)
    begin[of[head][inner]] = start[head][inner]
    owner = np.repeat(np.arange(n), np.diff(np.append(begin, len(data))))  # passage of each byte
    size = np.bincount(owner, minlength=n)[:, None]
    out[:, -1] = np.log1p(size[:, 0]) / 8
    size = np.maximum(size, 1)
    if len(data) > 2:
        pair = owner[1:] == owner[:-1]
        kinds = _KIND[data]
        k = N_CLASSES**2
        out[:, :k] = np.sqrt(np.bincount((owner[1:] * k + kinds[:-1] * N_CLASSES + kinds[1:])[pair], minlength=n * k).reshape(n, k) / size)
        three = owner[2:] == owner[:-2]
        d = data.astype(np.uint64)
        gram = (mix(d[:-2] | d[1:-1] << np.uint64(8) | d[2:] << np.uint64(16)) % np.uint64(TRIGRAMS)).astype(np.int64)
        out[:, k : k + TRIGRAMS] = np.sqrt(np.bincount((owner[2:] * TRIGRAMS + gram)[three], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS) / size)
    if len(of):
        words = np.bincount(of, minlength=n)
        per = lambda x: np.bincount(of, x, n) / np.maximum(words, 1)
        again = np.append(False, (h[1:] == h[:-1]) & (of[1:] == of[:-1]))
        order = np.lexsort((h, of))
        new = np.append(True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1]))
        size_of = (end - start).astype(float)
        capital = (data[start] >= ord("A")) & (data[start] <= ord("Z"))
        mean = per(size_of)
        stats = [per(again), np.bincount(of[order], new, n) / np.maximum(words, 1), mean / 10, np.sqrt(np.maximum(per(size_of**2) - mean**2, 0)) / 10, per(capital), per(size_of <= 3), np.log1p(words) / 5]
        out[:, -STATS:-1] = np.stack(stats, 1)
    return out, count


def initial(rng: np.random.Generator) -> Weights:
    shapes = {"W": (WIDTH, UNITS), "b": (UNITS,), "V": (UNITS, GATES), "U": (UNITS, GATES), "w": (GATES,), "c": (UNITS,), "c0": (1,)}
    return {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("b", "c0") else np.zeros(s) for k, s in shapes.items()}


def forward(m: Weights, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Logits of texts whose standardised passages follow each other in ``x``, ``count`` of each (1 at least), and all between.

    Each passage is encoded, a tanh and a sigmoid gate give its attention, the weighted sum of codes is scored.
    """
    starts = np.cumsum(count) - count
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), 1 / (1 + np.exp(-(h @ m["U"])))
    e = (t * s) @ m["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
    a = e / np.repeat(np.add.reduceat(e, starts), count)
    z = np.add.reduceat(a[:, None] * h, starts)
    return z @ m["c"] + m["c0"][0], {"h": h, "t": t, "s": s, "a": a, "z": z}


def gradients(m: Weights, x: np.ndarray, count: np.ndarray, label: np.ndarray) -> Weights:
    """Of the mean log loss, with respect to each weight."""
    logit, f = forward(m, x, count)
    h, t, s, a = f["h"], f["t"], f["s"], f["a"]
    starts = np.cumsum(count) - count
    err = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - label) / len(label)
    dz = np.repeat(err[:, None] * m["c"], count, 0)
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), count))
    gate = de[:, None] * m["w"]
    dt, ds = gate * s * (1 - t * t), gate * t * s * (1 - s)
    dh = (a[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": f["z"].T @ err, "c0": err.sum(keepdims=True)}


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """Adam over shuffled batches of texts; features are standardised by the training passages' mean and deviation."""
    rng = np.random.default_rng(0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    m, starts = initial(rng), np.cumsum(count) - count
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(count))
        for some in np.split(order, range(BATCH, len(order), BATCH)):
            rows = np.concatenate([np.arange(starts[i], starts[i] + count[i]) for i in some])
            g = gradients(m, (x[rows] - mean) / scale, count[some], label[some])
            step += 1
            for k in m:
                grad = g[k] + DECAY * m[k] * (k not in ("b", "c0"))
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                m[k] = m[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return m | {"mean": mean, "scale": scale}


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS) -> Weights | None:
    """Weights from the learnable rows of ``docs(doc_id, text)`` with a ``quality`` of 0 or 1 in ``labels(doc_id, quality)``.

    At most ``max_rows`` of them, chosen and ordered by a hash of doc_id, pass through one task, which keeps the features
    of their passages. Of rows that share a doc_id the one whose text has the least hash is learned from, with each of
    the id's labels. Null texts count as empty. None without such rows: every score is 1/2 then.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).distinct()
    chosen = known.orderBy(*order).limit(max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, labels = [], [], []
        for b in batches:
            data, off = text_buffer(b.column(0))
            labels.append(b.column(1).to_numpy())
            for lo, hi in row_groups(off, GROUP_BYTES):
                x, count = passages(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                parts.append(x)
                counts.append(count)
        if parts:
            file = io.BytesIO()
            np.savez(file, **train(np.concatenate(parts), np.concatenate(counts), np.concatenate(labels), epochs))
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["model"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen has max_rows rows at most
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))  # as many
    ordered = rows.repartition(1).sortWithinPartitions(*order).select("text", "quality")
    got = ordered.mapInArrow(learn, "model binary").collect()  # weights of a fixed number
    return dict(np.load(io.BytesIO(got[0]["model"]))) if got else None


def score(docs: DataFrame, model: Weights | None) -> DataFrame:
    """All columns of ``docs(text, ...)`` and ``quality(score, attention)``; the whole text alone decides.

    ``score`` goes from 0 to 1, higher for likelier good; ``attention`` has a weight for each passage of PASSAGE words, in
    order, that sum to 1. A null text counts as empty; a text without words is one passage. Repeated rows repeat; an
    empty table gives no rows. A column ``quality`` of ``docs`` is replaced. A text's passages are held at once.
    """
    docs = without(docs, "quality")
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed number
    kind = pa.struct([("score", pa.float64()), ("attention", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, off = text_buffer(b.column(at))
            for lo, hi in row_groups(off, GROUP_BYTES):
                x, count = passages(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if m is None:
                    p, a = np.full(hi - lo, 0.5), np.repeat(1 / count, count)
                else:
                    logit, f = forward(m, (x - m["mean"]) / m["scale"], count)
                    p, a = np.round(1 / (1 + np.exp(-np.clip(logit, -35, 35))), 9), f["a"]  # sums differ in the last bits by where a text stands
                attention = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(a))
                column = pa.StructArray.from_arrays([pa.array(p), attention], fields=list(kind))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "quality"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("quality", T.StructType.fromDDL(RESULT))]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    rows = score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    found = F.col("quality.score")
    return rows.select("doc_id", held_out.alias("held_out"), found.alias("score"), (found >= threshold).cast("int").alias("predicted"))
