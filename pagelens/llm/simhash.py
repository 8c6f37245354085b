"""SimHash near-duplicates: a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_buffer
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
#: Two fingerprints that differ in 3 bits or fewer share at least 8 - 3 of their 8 bytes.
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Any five of eight positions hold three of the first four or three of the last four, so these eight triples of
#: positions meet every linked pair.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Longer keys for postings of more than HOT rows: every five positions.
FIVES = list(combinations(range(8), 5))
HOT = 4096
#: Number of the first design of longer keys, and the fingerprints of such a posting from which partners are looked up.
#: A posting of five bytes has 2**24 fingerprints at most.
LONGER, MANY = 100, 1 << 14


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64 (seed 42). No words: 0."""
    words = text.lower().split()  # bytes: only A-Z change, and only \\x20 \\x09-\\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle_words, len(words))
    hash64 = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 14):
        pairs = zip(starts[lo : min(n, lo + (1 << 14))].tolist(), ends[lo + k - 1 : lo + (1 << 14) + k - 1].tolist())
        h = np.array([hash64(joined[a:b], 42) for a, b in pairs], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long. Null text counts as empty: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column(1))
            raw = data.tobytes()
            fps = np.fromiter((fingerprint(raw[s:e], shingle_words) for s, e in zip(off[:-1].tolist(), off[1:].tolist())), np.uint64, len(off) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _byte_mask(positions: tuple[int, ...]) -> int:
    m = sum(0xFF << 8 * p for p in positions)
    return m - (1 << 64) if m >> 63 else m


def _postings(rows: DataFrame, designs: list[tuple[int, ...]]) -> DataFrame:
    """One posting ``(design, key, fp)`` for each set of byte positions."""
    keys = [F.struct(F.lit(i).cast("short").alias("design"), F.col("fp").bitwiseAND(F.lit(_byte_mask(p))).alias("key")) for i, p in enumerate(designs)]
    return rows.select("fp", F.explode(F.array(*keys)).alias("p")).select("p.design", "p.key", "fp")


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact distance."""
    x = a ^ b
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1)
    out = shared >= MIN_SHARED_BYTES
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one long posting that join all that is linked in it: a breadth-first forest, not all pairs."""
    left, found = fps, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _linked(left, np.broadcast_to(at, left.shape))
            if hit.any():
                near = left[hit]
                found.append((np.full(len(near), at), near))
                left = left[~hit]
                queue.extend(near)
    return found


@cache
def _flips(free: tuple[int, ...]) -> np.ndarray:
    """All masks of 1 to MAX_BITS bits in the bytes at ``free``."""
    bits = [1 << (8 * p + i) for p in free for i in range(8)]
    return np.array([sum(x) for k in range(1, MAX_BITS + 1) for x in combinations(bits, k)], np.uint64)


def _by_flips(fps: np.ndarray, free: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all that is linked among fingerprints alike but in the bytes at ``free``; fit for very many.

    Each fingerprint's few thousand possible partners are looked up, so the work is in proportion to the posting.
    """
    fps, found = np.sort(fps), []
    root = np.arange(len(fps))
    for mask in _flips(free):
        at = np.minimum(np.searchsorted(fps, fps ^ mask), len(fps) - 1)
        u = np.flatnonzero((fps[at] == fps ^ mask) & (at > np.arange(len(fps))))
        u = u[root[u] != root[at[u]]]
        v = at[u]
        if len(u):
            found.append((fps[u], fps[v]))
        while len(u):
            a, b = root[u], root[v]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            rest = root[u] != root[v]
            u, v = u[rest], v[rest]
    return found


def _links_of_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal ``(design, key)``; the partition comes sorted by them."""

    def links(design: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], (design[1:] != design[:-1]) | (key[1:] != key[:-1]))))
        size = np.diff(np.concatenate((first, [len(fp)])))
        found = []
        for n in np.unique(size[(size > 1) & (size <= 8)]).tolist():
            at = fp[first[size == n][:, None] + np.arange(n)]
            for i, j in combinations(range(n), 2):
                hit = _linked(np.ascontiguousarray(at[:, i]), np.ascontiguousarray(at[:, j]))
                found.append((at[hit, i], at[hit, j]))
        for s, n in zip(first[size > 8].tolist(), size[size > 8].tolist()):
            if n > MANY and design[s] >= LONGER:
                found += _by_flips(fp[s : s + n], tuple(set(range(8)) - set(FIVES[design[s] - LONGER])))
            else:
                found += _forest(fp[s : s + n])
        u = np.concatenate([x[0] for x in found]) if found else np.zeros(0, np.uint64)
        v = np.concatenate([x[1] for x in found]) if found else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    kept: list[np.ndarray] | None = None
    for b in batches:
        cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols)]
        if not len(cols[0]):
            continue
        cut = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))  # the last run may go on
        if cut:
            yield links(*[x[:cut] for x in cols])
        kept = [x[cut:] for x in cols]
    if kept is not None and len(kept[0]):
        yield links(*kept)


def near_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``(u, v)``: enough links between distinct ``fp`` values to join all within MAX_BITS bits of each other.

    Every fingerprint is posted under eight 3-byte position keys. Postings of over ``hot`` rows are split further by
    the ten 5-byte keys that extend theirs (a linked pair shares five bytes, so it meets in one of these); none is
    dropped. In a posting, pairs are kept if they share MIN_SHARED_BYTES positional bytes and verified bit by bit.
    """
    posts = _postings(fps.select("fp").distinct(), TRIPLES)
    over = materialize(posts.groupBy("design", "key").count().where(F.col("count") > hot).select("design", "key"))
    sets = F.array(*[F.array(*[F.lit(i).cast("short") for i, t in enumerate(TRIPLES) if set(t) <= set(five)]) for five in FIVES])
    again = posts.join(over, ["design", "key"], "left_semi").groupBy("fp").agg(F.collect_set("design").alias("hot"))
    fives = again.select("fp", "hot", F.posexplode(sets).alias("i", "of")).where(F.arrays_overlap("hot", "of"))
    masks = F.array(*[F.lit(_byte_mask(p)) for p in FIVES])
    longer = fives.select((F.col("i") + LONGER).cast("short").alias("design"), F.col("fp").bitwiseAND(masks[F.col("i")]).alias("key"), "fp")
    rows = posts.join(over, ["design", "key"], "left_anti").unionByName(longer)
    runs = rows.repartition("design", "key").sortWithinPartitions("design", "key")
    return runs.mapInArrow(_links_of_postings, "u long, v long")


def near_duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``(doc_id, fp, fingerprint, component_id)`` for every row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most 3 bits are linked; ``component_id`` is the smallest doc_id reachable.
    Null and wordless texts have fingerprint 0 and are linked like others. Repeated rows give repeated results. A
    null doc_id never names a component unless all of its rows have none. An empty table gives no rows; further
    columns are ignored.
    """
    fps = materialize(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    parts = materialize(connected_components(near_links(nodes, hot)))
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(least, "component").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
