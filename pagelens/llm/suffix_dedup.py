"""Removal of repeated byte strings: sparse suffix sorting by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, prefix_hash, row_groups, stored, substring_hash, text_buffer

LENGTH = 400
#: First q-gram of a bucket; anchors are picked by it.
GRAM = 64
#: Bytes looked at in one go, and window starts in a piece of a long text; a worker's arrays take many times as much.
PIECE = 1 << 18
#: Bytes of contexts that are refined together.
REFINE = 1 << 18
#: Contexts of a bucket that one task refines; larger buckets are split by parts of their windows.
HOT = 1000
#: Parts that a context's windows are split into there.
PARTS = 8
ANCHOR = "tk binary, size int, gram long, context long, at array<int>"


def _piece(length: int) -> int:
    """PIECE, or more if the windows ask for it; a power of two and the same in all tasks, as it limits the hash bits that are compared."""
    return max(PIECE, 1 << (2 * length).bit_length())


def _portions(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Rows with at most ``limit`` bytes in a column, or a single row, so that memory doesn't follow the batches' size."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy()
        for lo, hi in row_groups(np.concatenate(([0], np.cumsum(size, dtype=np.int64))), limit):
            yield b.slice(lo, hi - lo)


def _anchors_of(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Anchor positions: for each window of ``length`` bytes at ``starts`` the position of its least gram hash.

    ``starts`` is sorted. Ties go to the leftmost, so equal windows pick the same place in both.
    """
    width = length - gram + 1
    n = len(data) - gram + 1
    at = np.arange(n)
    index = np.uint64(_piece(length) * 2 - 1)
    key = (substring_hash(prefix_hash(data), at, at + gram) & ~index) | at.astype(np.uint64)
    pad = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = key
    blocks = pad.reshape(-1, width)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = (np.minimum(down[starts], up[starts + width - 1]) & index).astype(np.int64)
    return least[np.concatenate(([True], least[1:] != least[:-1]))]


def _context(pos: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that windows holding an anchor's gram can reach, inside its text."""
    return np.maximum(0, pos - (length - gram)), np.minimum(size, pos + length)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffles, under their MD5."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in _portions(batches, 1, PIECE):
        data, off = text_buffer(b.column(1))
        raw, keys, packed = data.tobytes(), [], []
        for s, e in zip(off[:-1].tolist(), off[1:].tolist()):
            keys.append(hashlib.md5(raw[s:e]).digest())
            packed.append(squeeze(raw[s:e]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(off)), pa.array(packed, pa.binary())], ["doc_id", "tk", "size", "z"])


def _unpacked(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about PIECE bytes of texts, or one longer text, with the bytes and offsets of what _packed() has packed in a column."""
    expand = zstandard.ZstdDecompressor().decompress
    for b in batches:
        first, texts, size = 0, [], 0
        for row, z in enumerate(b.column(column), 1):
            texts.append(expand(z.as_py()))
            size += len(texts[-1])
            if size >= PIECE or row == b.num_rows:
                yield b.slice(first, row - first), np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64)))
                first, texts, size = row, [], 0


def _find_anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row for each gram and context of a text with all places where they stand, so a line that a text repeats is one."""
    step = _piece(length) - length
    for b in _portions(batches, 0, PIECE):
        raw, off = text_buffer(b.column(0))
        text = raw.tobytes()
        ends = off[1:]
        found = []
        for at in range(0, len(raw) - length + 1, step):  # pieces overlap, so every window lies whole in one
            part = raw[at : at + step + length - 1]
            starts = np.arange(at, at + len(part) - length + 1)
            end = ends[np.searchsorted(ends, starts, "right")]
            starts = starts[starts + length <= end]
            if len(starts):
                found.append(_anchors_of(part, starts - at, length, gram) + at)
        if not found:
            continue
        place = np.unique(np.concatenate(found))
        row = np.searchsorted(ends, place, "right")
        begin = off[row]
        pos, size = place - begin, np.diff(off)[row]
        left, right = _context(pos, size, length, gram)
        hash64 = xxhash.xxh3_64_intdigest
        g = np.fromiter((hash64(text[p : p + gram]) for p in place.tolist()), np.uint64, len(place))
        seeds = ((pos - left) * (length + 1) + right - pos).tolist()
        c = np.fromiter((hash64(text[s:e], seed) for s, e, seed in zip((begin + left).tolist(), (begin + right).tolist(), seeds)), np.uint64, len(place))
        keys = pa.array([hashlib.md5(text[x:y]).digest() for x, y in zip(off[:-1].tolist(), ends.tolist())], pa.binary())
        order = np.lexsort((pos, c, g, row))
        row, g, c, pos, size = row[order], g[order], c[order], pos[order].astype(np.int32), size[order].astype(np.int32)
        cut = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (g[1:] != g[:-1]) | (c[1:] != c[:-1]))))
        at = pa.ListArray.from_arrays(pa.array(np.append(cut, len(row)).astype(np.int32)), pa.array(pos))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[cut])), pa.array(size[cut]), pa.array(g[cut].view(np.int64)), pa.array(c[cut].view(np.int64)), at], ["tk", "size", "gram", "context", "at"])


def _cut_contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Bytes around the anchors that a text was joined with."""
    names = ["gram", "hot", "tk", "pos", "single", "before", "bytes"]
    for b, data, off in _unpacked(batches, 1):
        lists = b.column(2)
        flat = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        pos = flat.field("pos").to_numpy().astype(np.int64)
        left, right = _context(pos, np.diff(off)[row], length, gram)
        for s in range(0, len(pos), 4096):
            cut = slice(s, s + 4096)
            at = off[row[cut]]
            pieces = [data[x:y].tobytes() for x, y in zip((at + left[cut]).tolist(), (at + right[cut]).tolist())]
            rest = flat.slice(s, 4096)
            yield pa.RecordBatch.from_arrays([rest.field("gram"), rest.field("hot"), b.column(0).take(pa.array(row[cut])), rest.field("pos"), rest.field("single"), pa.array((pos - left)[cut].astype(np.int32)), pa.array(pieces, pa.binary())], names)


CONTEXT = "gram long, hot boolean, tk binary, pos int, single boolean, before int, bytes binary"


def _buckets(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by a key: the entries that share theirs with others, and the numbers of their buckets."""
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)  # same[i] tells if entry i has the key of the one before
    same[1:-1] = key[1:] == key[:-1]
    shared = same[:-1] | same[1:]
    return order[shared], np.cumsum(~same[:-1], dtype=np.int32)[shared]


def _repeats(group: np.ndarray, before: np.ndarray, data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``length`` bytes that two or more contexts of a group share: (context, start in the context).

    Contexts of a group are lined up at their anchors. Entries (column, context) start in buckets of equal q-grams;
    sorting an entry on its own bucket and the bucket of the q-gram that stands q bytes later doubles q, and the new
    buckets serve the next round, the last of which overlaps to reach ``length``. Entries alone in their bucket drop
    out at once.
    """
    row = np.repeat(np.arange(len(before), dtype=np.int32), np.diff(off))
    index = (np.arange(len(row)) - off[row]).astype(np.int32)
    left = np.diff(off).astype(np.int32)[row] - index  # bytes up to the context's end
    q = -(-length // 4)
    live = np.flatnonzero(left >= q)
    column = (length - gram - before)[row[live]] + index[live]
    place = mix(group[row[live]].view(np.uint64) ^ (column.astype(np.uint64) << np.uint64(48)))
    bucket = np.full(len(row), -1, np.int32)
    some, ids = _buckets(mix(substring_hash(prefix_hash(data), live, live + q) ^ place))
    del column, place
    bucket[live[some]] = ids
    while q < length:
        step = min(q, length - q)
        live = np.flatnonzero((bucket >= 0) & (left >= q + step))
        live = live[bucket[live + step] >= 0]
        # a pair's second bucket may only be compared inside one text, which left >= q + step ensures
        pair = bucket[live].astype(np.uint64) << np.uint64(32) | bucket[live + step].astype(np.uint64)
        some, ids = _buckets(pair)
        bucket.fill(-1)
        bucket[live[some]] = ids
        q += step
    hit = np.flatnonzero(bucket >= 0)
    return row[hit], index[hit]


def _refine(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of single contexts; the partition comes sorted by gram and only whole groups are refined."""

    def spans(t: pa.Table) -> pa.RecordBatch:
        data, off = text_buffer(t.column("bytes").combine_chunks())
        group = t.column("gram").to_numpy()
        row, start = _repeats(group, t.column("before").to_numpy().astype(np.int64), data, off, length, gram)
        single = t.column("single").to_numpy()
        row, start = row[single[row]], start[single[row]]
        at = t.column("pos").to_numpy()[row] - t.column("before").to_numpy()[row] + start
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(row)) - 1 if len(row) else first
        return pa.RecordBatch.from_arrays([t.column("tk").combine_chunks().take(pa.array(row[first])), pa.array(at[first].astype(np.int32)), pa.array((at[last] + length).astype(np.int32))], ["tk", "s", "e"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for s in range(0, b.num_rows, 256):
            held.append(b.slice(s, 256))
            size += held[-1].nbytes
            if size < REFINE:
                continue
            t = pa.Table.from_batches(held)
            g = t.column("gram").to_numpy()
            cut = int(np.argmax(g == g[-1]))  # the last group may go on
            if cut:
                yield spans(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
            size = sum(x.nbytes for x in held)
    if held and sum(b.num_rows for b in held):
        yield spans(pa.Table.from_batches(held))


def _part(length: int, gram: int) -> int:
    return max(1, -(-(length - gram + 1) // PARTS))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few contexts at a time, as each gives many hashes."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _parts(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Hashes of each part of a context's windows: of the bytes that all of them hold and of those that any holds."""
    digest = xxhash.xxh3_128_digest
    for b in _slices(batches):
        data, off = text_buffer(b.column(5))
        raw, before = data.tobytes(), b.column(4).to_numpy()
        row, part, inner, outer = [], [], [], []
        for i in range(b.num_rows):
            end = int(off[i + 1])
            # parts are counted from the anchor, so they line up whatever the texts' starts
            for k in range(-(-int(before[i] + 1) // width)):
                last = int(off[i] + before[i]) - k * width
                lo, hi = max(int(off[i]), last - width + 1), min(last, end - length)
                if lo <= hi:
                    row.append(i)
                    part.append(k)
                    # a text's start or end may cut windows off; those left hold the bytes that all of a whole part do
                    inner.append(digest(raw[last : last - width + 1 + length]))
                    outer.append(digest(raw[lo : hi + length], (last - hi) * width + hi - lo))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(4)], pa.array(part, pa.int32()), pa.array(inner, pa.binary()), pa.array(outer, pa.binary())], ["gram", "tk", "pos", "single", "part", "inner", "outer"])


def _windows(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Every window of some parts of a context with its hash."""
    for b in _slices(batches):
        data, off = text_buffer(b.column(3))
        raw, pos, before = data.tobytes(), b.column(1).to_numpy().astype(np.int64), b.column(2).to_numpy().astype(np.int64)
        row, start, hashes, single = [], [], [], []
        for i, parts in enumerate(b.column(4).to_pylist()):
            for p in parts:
                hi = int(off[i] + before[i]) - p["part"] * width
                for at in range(max(int(off[i]), hi - width + 1), min(hi, int(off[i + 1]) - length) + 1):
                    row.append(i)
                    start.append(pos[i] - before[i] + at - int(off[i]))
                    hashes.append(xxhash.xxh3_128_digest(raw[at : at + length]))
                    single.append(p["single"])
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), b.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(single, pa.bool_())], ["h", "tk", "s", "single"])


def _hot_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated spans of single contexts in buckets too large for one task; every step is a hash-dealt count.

    A context's windows are split into parts. Where the bytes of a whole part repeat, it is settled; where the bytes
    that its windows share are alone, none repeats; what is left, one for each distinct part, is counted by window.
    """
    width = _part(length, gram)
    parts = materialize(contexts.select("gram", "tk", "pos", "single", "before", "bytes").mapInArrow(partial(_parts, length=length, width=width), "gram long, tk binary, pos int, single boolean, part int, inner binary, outer binary"))
    same = ["gram", "part", "inner"]  # so that no two rows of a bucket are the same place
    by = parts.groupBy(*same, "outer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "pos", "part", "single")).alias("one"))
    by = materialize(by.select(*same, "outer", "n", "one", ((F.col("n") == 1) & F.col("one.single")).alias("open")))
    first = F.greatest(F.lit(0), F.greatest(F.col("pos") - (length - gram), F.col("pos") - F.col("part") * width - width + 1))
    last = F.col("pos") - F.col("part") * width
    sizes = contexts.select("tk", "pos", (F.col("pos") - F.col("before") + F.octet_length("bytes")).alias("end"))
    done = parts.where("single").join(by.where("n > 1").select(*same, "outer"), [*same, "outer"], "left_semi").join(sizes, ["tk", "pos"])
    done = done.select("tk", first.alias("s"), F.least(last + length, F.col("end")).alias("e"))
    # counts are kept apart from the joins that follow, so that a crowded key's partition is one that Spark can split
    mixed = materialize(by.groupBy(*same).agg(F.count(F.lit(1)).alias("m"), F.max("open").alias("any")).where("m > 1 and any").select(*same))
    again = by.join(mixed, same, "left_semi").select("one.tk", "one.pos", "one.part", F.col("open").alias("single"))
    again = again.groupBy("tk", "pos").agg(F.collect_list(F.struct("part", "single")).alias("parts"))
    wide = contexts.select("tk", "pos", "before", "bytes").join(again, ["tk", "pos"]).select("tk", "pos", "before", "bytes", "parts").mapInArrow(partial(_windows, length=length, width=width), "h binary, tk binary, s int, single boolean")
    wide = materialize(wide.groupBy("h", "tk", "s").agg(F.max("single").alias("single")))
    twice = materialize(wide.groupBy("h").count().where("count > 1").select("h"))
    broad = wide.where("single").join(twice, "h", "left_semi").select("tk", "s", (F.col("s") + length).alias("e"))
    return done.unionByName(broad)


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(tk, s, e)``: byte spans covered by ``length``-byte strings that start at two places or more.

    ``texts(text)``; ``tk`` is a text's MD5. Spans of a text may touch or overlap and may come more than once.

    An anchor is the position of the least hash in a window of gram positions, so two equal strings of ``length``
    bytes hold an anchor at the same offset. Anchors are bucketed by the q-gram they start; buckets of one go. Equal
    whole contexts (all that the windows holding the anchor can reach) settle the rest of a copy; one anchor stands
    for each distinct context, and buckets of several contexts are refined, see _repeats(). Buckets of more than
    ``hot`` contexts are split over tasks, see _hot_spans().
    """
    size = {"length": length, "gram": gram}
    long = texts.where(F.octet_length("text") >= length).select("text")
    anchors = long.mapInArrow(partial(_find_anchors, **size), ANCHOR)  # found twice, which costs less than keeping all
    # kept apart from the joins that follow, so that these are plain ones whose crowded partitions Spark can split
    places = F.sum(F.size("at")).alias("n")
    shared = materialize(anchors.groupBy("gram").agg(places).where("n > 1").select("gram"))
    anchors = stored(anchors.join(shared, "gram", "left_semi"))
    contexts = anchors.groupBy("gram", "context").agg(places, F.min(F.struct("tk", F.col("at")[0].alias("pos"), "size")).alias("one"))
    contexts = stored(contexts.select("gram", "context", (F.col("n") == 1).alias("single"), "one"))
    whole = anchors.join(contexts.where("not single").select("gram", "context"), ["gram", "context"], "left_semi")
    whole = whole.select("tk", "size", F.explode("at").alias("pos"))
    whole = whole.select("tk", F.greatest(F.lit(0), F.col("pos") - (length - gram)).alias("s"), F.least("size", F.col("pos") + length).alias("e"))

    open_ = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("any")).where("n > 1 and any").select("gram", (F.col("n") > hot).alias("hot"))
    todo = contexts.join(materialize(open_), "gram").select("gram", "hot", "single", "one.tk", "one.pos")
    lists = todo.groupBy("tk").agg(F.collect_list(F.struct("gram", "pos", "single", "hot")).alias("at"))
    packed = long.select(F.lit(0).alias("doc_id"), "text").mapInArrow(_packed, "doc_id int, tk binary, size long, z binary")
    # one row a text: each of its contexts is cut out once, however many copies there are
    cut = packed.select("tk", "z").dropDuplicates(["tk"]).join(lists, "tk").select("tk", "z", "at").mapInArrow(partial(_cut_contexts, **size), CONTEXT)
    fine = cut.where("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(partial(_refine, **size), "tk binary, s int, e int")
    many = materialize(cut.where("hot"))
    return whole.unionByName(fine).unionByName(_hot_spans(many, length, gram))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for b, data, off in _unpacked(batches, 1):
        kept, removed, runs = [], [], []
        for i, spans in enumerate(b.column(2).to_pylist()):
            text = data[off[i] : off[i + 1]]
            gone = np.zeros(len(text) + 2, np.int32)
            for x in spans or ():
                gone[x["s"] + 1] += 1
                gone[x["e"] + 1] -= 1
            hit = np.cumsum(gone) > 0  # hit[i + 1] tells of byte i
            runs.append(int((hit[1:] & ~hit[:-1]).sum()))
            hit = hit[1:-1]
            removed.append(int(hit.sum()))
            kept.append(text[~hit].tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs(doc_id, text)``; ``kept`` is binary.

    Texts are UTF-8 bytes (null: empty). Each byte covered by a ``length``-byte string that also starts anywhere else
    in the table, in the same text too, is removed, judged on the input. Rows with equal texts are copies of each
    other, so of repeated rows all that is ``length`` bytes or longer goes. Shorter texts stay whole. An empty table
    gives no rows; a null or repeated doc_id matters not, as rows are told apart by text; further columns are ignored.
    """
    spans = repeated_spans(docs, length, gram, hot).groupBy("tk").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_packed, f"doc_id {kind}, tk binary, size long, z binary")
    rows = rows.join(spans, "tk", "left").select("doc_id", "z", "spans")
    return rows.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
