"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chain, row_groups, text_buffer, unused, word_hashes

SEED_WORDS = 3
#: N-grams found in over so many times the documents of their item's median n-gram aren't seeds.
RARE = 4.0
#: N-grams that no more distinct texts hold are always seeds, so that an item's own near copies don't make them common.
COMMON = 1000
#: Seeds of an item that must stand near each other in a text to make a candidate; all, for items of fewer.
MIN_SEEDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least alignment score over that of a whole verbatim copy.
THRESHOLD = 0.5
#: Words of test items that are looked for in one pass over the corpus; a benchmark of more takes several passes.
BLOCK_WORDS = 1_000_000
GROUP_BYTES = 1 << 20


@dataclass
class Items:
    """A block of distinct test items: word hashes end to end, and n-grams by ascending hash with the items they stand in.

    ``seed`` is the words of an n-gram and ``need`` the seeds that a candidate needs, fewer in items that have fewer.
    """

    keys: list
    seed: int
    need: int
    words: np.ndarray
    starts: np.ndarray
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list, seed: int, need: int) -> Items:
        texts = [r["low"].encode() for r in rows]
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        h, row, _, _ = word_hashes(np.frombuffer(b"".join(texts), np.uint8), off)
        starts = np.searchsorted(row, np.arange(len(rows) + 1))
        gram, item, place = [], [], []
        for i in range(len(rows)):
            w = h[starts[i] : starts[i + 1]]
            g = _grams(w, min(seed, len(w)))
            gram.append(g)
            item.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (gram, item, place))
        order = np.lexsort((place, item, gram))
        return cls([bytes(r["key"]) for r in rows], seed, need, h, starts, gram[order].astype(np.uint64), item[order], place[order])

    @property
    def sizes(self) -> set[int]:
        return {min(self.seed, int(n)) for n in np.diff(self.starts)}

    def keep(self, found: dict[int, int], rare: float) -> Items:
        """The n-grams that at most ``rare`` times as many texts hold as the item's median n-gram, or COMMON texts.

        ``found``: distinct texts by n-gram. N-grams that no document holds can't find anything and don't count.
        """
        df = np.array([found.get(int(g), 0) for g in self.grams.view(np.int64)], np.int64)
        there = np.flatnonzero(df)
        order = there[np.lexsort((df[there], self.item[there]))]
        n = np.bincount(self.item[there], minlength=len(self.keys))
        middle = np.zeros(len(n))
        middle[n > 0] = df[order[(np.cumsum(n) - n + n // 2)[n > 0]]]
        kept = np.flatnonzero((df > 0) & (df <= np.maximum(rare * middle[self.item], COMMON)))
        return Items(self.keys, self.seed, self.need, self.words, self.starts, self.grams[kept], self.item[kept], self.place[kept])


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    return chain(words[:m] + np.uint64(n), *[words[i : i + m] for i in range(1, n)])


def _text_grams(words: np.ndarray, row: np.ndarray, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of texts with the position of their first word, none across texts; shorter ones for items that short."""
    for n in range(1, seed + 1):
        if len(words) >= n:
            at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
            yield _grams(words, n)[at], at


def _frequencies(docs: DataFrame, shared: Broadcast) -> dict[int, int]:
    """Distinct texts of the whole corpus that hold each n-gram of the items; copies of a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.unique(shared.value.grams)
        sizes = shared.value.sizes
        for b in batches:
            data, off = text_buffer(b.column(0))
            for lo, hi in row_groups(off, GROUP_BYTES):
                words, row, _, _ = word_hashes(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for n, (g, at) in enumerate(_text_grams(words, row, shared.value.seed), 1):
                    if n in sizes and len(grams):
                        k = np.searchsorted(grams, g)
                        hit = grams[np.minimum(k, len(grams) - 1)] == g
                        seen = np.unique(row[at[hit]] * len(grams) + k[hit])
                        text = b.column(1).take(pa.array(lo + seen // len(grams)))
                        yield pa.RecordBatch.from_arrays([text, pa.array(grams[seen % len(grams)].view(np.int64))], ["text", "gram"])

    held = docs.select("low", F.xxhash64("low").alias("text")).mapInArrow(run, "text long, gram long").distinct()
    found = held.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return {r["gram"]: r["df"] for r in found.collect()}  # one row for each n-gram of a block, see _seeds()


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment (Smith-Waterman, linear gaps): score, first and last word of it in the passage, end exclusive."""
    n = len(passage)
    ramp = -GAP * np.arange(n + 1)
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        diag = score[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = score[1:] + GAP
        new = np.concatenate(([0], np.maximum(np.maximum(diag, up), 0)))
        begin = np.concatenate(([0], np.where(diag >= up, start[:-1], start[1:])))
        begin = np.where(new > 0, begin, np.arange(n + 1))
        run = new + ramp  # a gap along the passage costs as much as the ramp rises
        top = np.maximum.accumulate(run)
        origin = np.maximum.accumulate(np.where(run == top, np.arange(n + 1), 0))
        score, start = top - ramp, begin[origin]
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (int(score[at]), int(start[at]), at)
    return best


def _candidates(items: Items, words: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, item, first word, last word) of stretches where enough distinct seeds of an item stand near each other."""
    sizes, found = items.sizes, []
    need = np.minimum(items.need, np.bincount(items.item, minlength=len(items.keys)))
    length = np.diff(items.starts)
    for n, (g, at) in enumerate(_text_grams(words, row, items.seed), 1):
        if n not in sizes or not len(items.grams):
            continue
        lo = np.searchsorted(items.grams, g, "left")
        hit = np.flatnonzero(items.grams[np.minimum(lo, len(items.grams) - 1)] == g)
        lo, at = lo[hit], at[hit]
        many = np.searchsorted(items.grams, g[hit], "right") - lo
        k = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(at, many)
        item, place = items.item[k], items.place[k]
        order = np.lexsort((at, item, row[at]))
        at, item, place = at[order], item[order], place[order]
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] - at[:-1] > length[item[1:]]))) if len(at) else np.zeros(0, bool)
        cluster = np.cumsum(new) - 1
        distinct = np.bincount(np.unique(np.stack((cluster, place)), axis=1)[0], minlength=0) if len(at) else np.zeros(0, np.int64)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        for c in np.flatnonzero(distinct >= need[item[first]]).tolist():
            i = int(item[first[c]])
            found.append((int(row[at[first[c]]]), i, int(at[first[c]]) - int(length[i]), int(at[last[c]]) + n + int(length[i])))
    return found


def _find(items: Items, data: np.ndarray, off: np.ndarray, threshold: float) -> list[tuple[int, int, float, str, int, int]]:
    """(row, item, score, passage, first word, last word) of the best alignment of each text and item it holds."""
    length = np.diff(items.starts)
    out = []
    for lo, hi in row_groups(off, GROUP_BYTES):
        raw = data[off[lo] : off[hi]]
        words, row, start, end = word_hashes(raw, off[lo : hi + 1] - off[lo])
        edge = np.searchsorted(row, np.arange(hi - lo + 1))
        best: dict[tuple[int, int], tuple] = {}
        for r, i, s, e in _candidates(items, words, row):
            s, e = max(s, int(edge[r])), min(e, int(edge[r + 1]))
            score, x, y = align(items.words[items.starts[i] : items.starts[i + 1]], words[s:e])
            share = score / (MATCH * int(length[i]))
            if share >= threshold and share > best.get((r, i), (0,))[0]:
                text = raw[start[s + x] : end[s + y - 1]].tobytes().decode("utf-8", "replace")
                best[r, i] = (share, text, s + x - int(edge[r]), s + y - int(edge[r]))
        out += [(lo + r, i, *v) for (r, i), v in sorted(best.items())]
    return out


def _distinct(benchmark: DataFrame) -> DataFrame:
    """``(low, key, n)``: the benchmark's distinct texts, case folded, that have words."""
    words = F.coalesce(F.regexp_count("low", F.lit(r"[^\W_]+|[^\x00-\x7F]+")), F.lit(0))
    low = benchmark.select(F.lower("text").alias("low")).where("low is not null").distinct()
    return low.select("low", F.md5(F.col("low").cast("binary")).cast("binary").alias("key"), words.alias("n")).where("n > 0")


def _seeds(docs: DataFrame, benchmark: DataFrame, rare: float | None, block_words: int, seed_words: int, min_seeds: int) -> Iterator[Broadcast]:
    """The benchmark's distinct texts in blocks, each with its seeds by the corpus, broadcast.

    A hash deals texts out to blocks of ``block_words`` / 2 words on average, so that few are larger than
    ``block_words``; an item of more than that stands whole in its block, as it does in every task that aligns it.
    """
    spark = docs.sparkSession
    low = docs.select(F.lower("text").alias("low"))
    test = _distinct(benchmark)
    words = test.agg(F.sum("n")).first()[0] or 0
    blocks = min(words, 1) if words <= block_words else -(-2 * words // block_words)
    for block in range(blocks):
        rows = test.where(F.pmod(F.xxhash64("low"), F.lit(blocks)) == block).orderBy("low").collect()
        if not rows:
            continue
        every = Items.of(rows, seed_words, min_seeds)
        yield spark.sparkContext.broadcast(every if rare is None else every.keep(_frequencies(low, spark.sparkContext.broadcast(every)), rare))


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare: float | None = RARE, block_words: int = BLOCK_WORDS, seed_words: int = SEED_WORDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``(doc_id, item_id, score, matched, start, end)``: test items found in texts, the best alignment of each.

    ``docs(doc_id, text)``, ``benchmark(item_id, text)``. Words are runs of letters and digits, case folded. Seeds are
    the item's word n-grams that no more than ``rare`` times as many distinct texts hold as its median n-gram, or COMMON texts,
    so an item whose n-grams are all common keeps seeds too. Where ``min_seeds`` of them stand near each other, the
    stretch and an item's length on both sides are aligned; ``score`` is the alignment's over that of a verbatim copy,
    kept from ``threshold`` on; start and end count words of the text, ``matched`` is the passage, case folded.

    The exact way: ``rare=None, seed_words=1, min_seeds=1`` aligns an item with all text around any word of it, which
    misses no alignment of a score of 1/2 or more, in one pass less and far more time. With the defaults, a copy is
    missed that has not ``min_seeds`` seeds intact.

    The benchmark is looked for in blocks of about ``block_words`` words, each broadcast; repeated items count once and
    give a row for each of their rows. Null or wordless texts and items match nothing. Documents are taken one by one:
    repeated rows repeat, a null doc_id stays null. Empty tables give no rows; further columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL("key binary, score double, matched string, start int, end int").fields])
    kinds = to_arrow_schema(schema)
    result = docs.sparkSession.createDataFrame([], schema)
    for seeds in _seeds(docs, benchmark, rare, block_words, seed_words, min_seeds):

        def run(batches: Iterator[pa.RecordBatch], seeds: Broadcast = seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = _find(seeds.value, *text_buffer(b.column(1)), threshold)
                ids = b.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                items = pa.array([seeds.value.keys[x[1]] for x in found], pa.binary())
                rest = [pa.array([x[k] for x in found], kinds.field(k).type) for k in range(2, 6)]
                yield pa.RecordBatch.from_arrays([ids, items, *rest], kinds.names)

        result = result.unionByName(docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(run, schema))
    names = benchmark.select("item_id", F.md5(F.lower("text").cast("binary")).cast("binary").alias("key"))
    return result.join(names, "key").select("doc_id", "item_id", "score", "matched", "start", "end")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rare: float | None = RARE, block_words: int = BLOCK_WORDS, seed_words: int = SEED_WORDS, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``docs`` without the rows that contaminated_passages() finds an item in, all columns kept; no row moves."""
    out = docs
    for seeds in _seeds(docs, benchmark, rare, block_words, seed_words, min_seeds):

        def run(batches: Iterator[pa.RecordBatch], seeds: Broadcast = seeds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                clean[[x[0] for x in _find(seeds.value, *text_buffer(b.column(b.num_columns - 1)), threshold)]] = False
                yield b.select(range(b.num_columns - 1)).filter(pa.array(clean))

        out = out.withColumn(unused(docs, "low"), F.lower("text")).mapInArrow(run, docs.schema)
    return out
