"""ISO base media files: box walking and sample tables, without decoding payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_groups, text_buffer, without

#: Layout of stored payloads: bytes a sample, samples a chunk, samples from one sync sample to the next, samples a second.
UNIT, CHUNK, SYNC, RATE = 64, 16, 8, 125
CONTAINERS = {b"moov", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
MAX_DEPTH = 16
#: Bytes of texts that are packed together.
GROUP_BYTES = 1 << 22


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *content: bytes) -> bytes:
    return _box(kind, bytes(4), *content)


def pack(payload: bytes) -> bytes:
    """A file of one 8-bit raw audio track that holds ``payload``, a multiple of UNIT bytes, as samples of UNIT bytes."""
    n = len(payload) // UNIT
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK), (chunks, last)] if chunks > 1 and last != CHUNK else [(1, last if chunks == 1 else CHUNK)]
    matrix = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    syncs = np.arange(1, n + 1, SYNC, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE * UNIT << 16))

    def head(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = (first + np.arange(chunks, dtype=np.uint64) * (CHUNK * UNIT)).astype(">u8" if wide else ">u4")
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(syncs)), syncs.tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", at, per, 1) for at, per in runs]),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", struct.pack(">I", 1)))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), minf)
        trak = _box(b"trak", _box(b"tkhd", struct.pack(">I", 7), struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), matrix, bytes(8)), mdia)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIHH", 0, 0, RATE, n, 0x10000, 0x100, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2") + _box(b"moov", mvhd, trak)

    lead = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if len(payload) + 8 >= 1 << 32 else struct.pack(">I4s", 8 + len(payload), b"mdat")
    size = len(head(0))  # the offsets' width may depend on where they start
    size = len(head(size + len(lead)))
    return head(size + len(lead)) + lead + payload


@dataclass
class Track:
    """What the boxes say of a track; ``room`` is the length of its file."""

    room: int
    codec: str | None = None
    kind: str | None = None
    timescale: int = 0
    length: int = 0
    tables: dict[bytes, memoryview] = field(default_factory=dict)
    runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = field(default_factory=list)

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and size of every sample: those of the sample tables, then those of the fragments' runs."""
        at, size = self._tabled()
        return np.concatenate([at, *[r[0] for r in self.runs]]), np.concatenate([size, *[r[1] for r in self.runs]])

    def _tabled(self) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables
        if b"stsz" not in t or b"stsc" not in t or not (b"stco" in t or b"co64" in t):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        fixed, n = struct.unpack_from(">II", t[b"stsz"], 4)
        if fixed * n > self.room:
            raise ValueError("a sample lies outside the file")
        sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(t[b"stsz"], ">u4", n, 12).astype(np.int64)
        wide = b"co64" in t
        table = t[b"co64" if wide else b"stco"]
        chunks = np.frombuffer(table, ">u8" if wide else ">u4", struct.unpack_from(">I", table, 4)[0], 8).astype(np.int64)
        runs = np.frombuffer(t[b"stsc"], ">u4", 3 * struct.unpack_from(">I", t[b"stsc"], 4)[0], 8).reshape(-1, 3).astype(np.int64)
        ends = np.minimum(np.cumsum(np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))), n)
        per = np.diff(ends, prepend=0)
        if per.sum() != n:
            raise ValueError("the sample tables disagree")
        chunk = np.repeat(np.arange(len(per)), per)
        sums = np.concatenate(([0], np.cumsum(sizes)))
        return chunks[chunk] + sums[:-1] - sums[ends - per][chunk], sizes

    def sync(self, n: int) -> np.ndarray:
        """Indices of sync samples among ``n``; without a table every sample outside fragments is one."""
        tabled = n - sum(len(r[0]) for r in self.runs)
        at = np.arange(tabled)
        if b"stss" in self.tables:
            table = self.tables[b"stss"]
            at = np.frombuffer(table, ">u4", struct.unpack_from(">I", table, 4)[0], 8).astype(np.int64) - 1
            at = at[(at >= 0) & (at < tabled)]
        return np.concatenate([at, tabled + np.flatnonzero(np.concatenate([r[2] for r in self.runs]))]) if self.runs else at

    def seconds(self) -> float | None:
        """Duration by the media header; with fragments, that of all samples. Null without a time scale."""
        ticks = self.length
        if self.runs:
            table = self.tables.get(b"stts", bytes(8))
            pairs = np.frombuffer(table, ">u4", 2 * struct.unpack_from(">I", table, 4)[0], 8).reshape(-1, 2).astype(np.int64)
            ticks = int((pairs[:, 0] * pairs[:, 1]).sum()) + sum(r[3] for r in self.runs)
        return ticks / self.timescale if self.timescale else None


@dataclass
class Movie:
    tracks: list[Track] = field(default_factory=list)
    by_id: dict[int, Track] = field(default_factory=dict)
    defaults: dict[int, tuple[int, int, int]] = field(default_factory=dict)


def walk(data: bytes) -> list[Track]:
    """The tracks of a file. Raises ValueError or struct.error where boxes are broken."""
    movie = Movie()
    _visit(memoryview(data), 0, len(data), 0, None, movie)
    return movie.tracks


def _children(view: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Kind, start, start of the content and end of each box between ``at`` and ``end``."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", view, at)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", view, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} doesn't fit")
        yield kind, at, at + head, at + size
        at += size


def _visit(view: memoryview, at: int, end: int, depth: int, track: Track | None, movie: Movie) -> None:
    if depth > MAX_DEPTH:
        raise ValueError("boxes are nested too deep")
    for kind, start, lo, hi in _children(view, at, end):
        body = view[lo:hi]
        if kind == b"trak":
            movie.tracks.append(Track(len(view)))
            _visit(view, lo, hi, depth + 1, movie.tracks[-1], movie)
        elif kind == b"moof":
            after = None
            for inner, _, a, b in _children(view, lo, hi):
                if inner == b"traf":
                    after = _fragment(view, start, a, b, after, movie)
        elif kind in CONTAINERS:
            _visit(view, lo, hi, depth + 1, track, movie)
        elif kind == b"trex":
            number, _, ticks, size, flags = struct.unpack_from(">5I", body, 4)
            movie.defaults[number] = ticks, size, flags
        elif track is None:
            pass
        elif kind == b"tkhd":
            movie.by_id[struct.unpack_from(">I", body, 20 if body[0] == 1 else 12)[0]] = track
        elif kind == b"mdhd":
            track.timescale, track.length = struct.unpack_from(">IQ", body, 20) if body[0] == 1 else struct.unpack_from(">II", body, 12)
        elif kind == b"hdlr":
            track.kind = bytes(body[8:12]).decode("latin-1")
        elif kind == b"stsd" and struct.unpack_from(">I", body, 4)[0]:
            track.codec = bytes(body[12:16]).decode("latin-1")
        elif kind in (b"stts", b"stss", b"stsc", b"stsz", b"stco", b"co64"):
            track.tables[kind] = body


#: Flag bits of fragment headers (tfhd), of runs (trun) and of samples; fixed by the format.
TFHD_BASE, TFHD_ENTRY, TFHD_TICKS, TFHD_SIZE, TFHD_FLAGS, TFHD_FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
TRUN_OFFSET, TRUN_FIRST, TRUN_TICKS, TRUN_SIZE, TRUN_FLAGS, TRUN_SHIFT = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def _fragment(view: memoryview, moof: int, lo: int, hi: int, after: int | None, movie: Movie) -> int:
    """Adds the runs of one track fragment to its track; the end of its data, where the next one's may start."""
    boxes = [(kind, view[a:b]) for kind, _, a, b in _children(view, lo, hi)]
    head = next((body for kind, body in boxes if kind == b"tfhd"), None)
    if head is None:
        raise ValueError("a fragment has no header")
    word, number = struct.unpack_from(">II", head)
    if number not in movie.by_id:
        raise ValueError("a fragment of an unknown track")
    track, at = movie.by_id[number], 8
    given = {}
    for bit, form in ((TFHD_BASE, ">Q"), (TFHD_ENTRY, ">I"), (TFHD_TICKS, ">I"), (TFHD_SIZE, ">I"), (TFHD_FLAGS, ">I")):
        if word & bit:
            given[bit] = struct.unpack_from(form, head, at)[0]
            at += struct.calcsize(form)
    ticks, size, flags = (given.get(bit, d) for bit, d in zip((TFHD_TICKS, TFHD_SIZE, TFHD_FLAGS), movie.defaults.get(number, (0, 0, 0))))
    base = given.get(TFHD_BASE, moof if after is None or word & TFHD_FROM_MOOF else after)
    end = base
    for kind, body in boxes:
        if kind != b"trun":
            continue
        bits, n = struct.unpack_from(">II", body)
        at, start = 8, end
        if bits & TRUN_OFFSET:
            start, at = base + struct.unpack_from(">i", body, at)[0], at + 4
        first = None
        if bits & TRUN_FIRST:
            first, at = struct.unpack_from(">I", body, at)[0], at + 4
        columns = [b for b in (TRUN_TICKS, TRUN_SIZE, TRUN_FLAGS, TRUN_SHIFT) if bits & b]
        if not columns and n * max(size, 1) > len(view):
            raise ValueError("a sample lies outside the file")
        table = np.frombuffer(body, ">u4", n * len(columns), at).reshape(n, len(columns)).astype(np.int64)
        sizes, spans, marks = (table[:, columns.index(b)] if b in columns else np.full(n, d, np.int64) for b, d in ((TRUN_SIZE, size), (TRUN_TICKS, ticks), (TRUN_FLAGS, flags)))
        key = marks & NOT_SYNC == 0
        if n and first is not None:
            key[0] = first & NOT_SYNC == 0
        ends = start + np.cumsum(sizes)
        track.runs.append((ends - sizes, sizes, key, int(spans.sum())))
        end = int(ends[-1]) if n else start
    return end


def pack_texts(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text as UTF-8, zero-padded to a positive multiple of UNIT, in a media file.

    Null text counts as empty. Rows with equal texts get equal files; repeated rows repeat. An empty table gives no
    rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column(1))
            for lo, hi in row_groups(off, GROUP_BYTES):
                raw, size, files = data[off[lo] : off[hi]].tobytes(), np.diff(off[lo : hi + 1]), []
                for s, n in zip((off[lo:hi] - off[lo]).tolist(), size.tolist()):
                    files.append(pack(raw[s : s + n] + bytes(-n % UNIT if n else UNIT)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


TRACKS = "array<struct<codec:string,kind:string,duration:double,n_samples:long,keyframes:array<struct<start:long,end:long>>,payload:binary>>"
FACTS = f"tracks {TRACKS}, error string"


def scan_media(files: DataFrame, column: str = "media", payload: bool = True) -> DataFrame:
    """All columns of ``files`` and each file's facts, as one struct ``facts`` of ``tracks`` and ``error``.

    A track, in the file's order: codec, handler kind, duration in seconds, number of samples, byte ranges (end
    exclusive) of sync samples and, if asked for, the samples' bytes in order. Samples are those of its sample tables,
    then those of its movie fragments. Null or broken files get an ``error`` and null tracks; a file without tracks has
    an empty array and no error. All columns of the input are kept, but one called ``facts``, which is replaced.
    """
    files = without(files, "facts")
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["codec", "kind", "duration", "n_samples", "keyframes", "payload"]
    track = pa.struct(list(zip(names, [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(kind), pa.binary()])))

    def facts_of(data: bytes, t: Track) -> dict:
        at, size = t.samples()
        if len(at) and (at.min() < 0 or (at + size).max() > len(data)):
            raise ValueError("a sample lies outside the file")
        key, whole = t.sync(len(at)), b"" if payload else None
        if payload and len(at):  # one slice for each run of adjacent samples
            cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + size[:-1])))
            whole = b"".join(data[s:e] for s, e in zip(at[cut].tolist(), (at + size)[np.append(cut[1:], len(at)) - 1].tolist()))
        ranges = [{"start": s, "end": e} for s, e in zip(at[key].tolist(), (at + size)[key].tolist())]
        return dict(zip(names, (t.codec, t.kind, t.seconds(), len(at), ranges, whole)))

    def one(data: bytes | None) -> tuple[list[dict] | None, str | None]:
        try:
            if data is None:
                raise ValueError("no data")
            return [facts_of(data, t) for t in walk(data)], None
        except (ValueError, struct.error, OverflowError, IndexError) as e:
            return None, f"{e}"[:200]

    at = files.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                tracks, errors = zip(*[one(x) for x in part.column(at).to_pylist()])
                facts = pa.StructArray.from_arrays([pa.array(tracks, pa.list_(track)), pa.array(errors, pa.string())], names=["tracks", "error"])
                yield pa.RecordBatch.from_arrays([*part.columns, facts], [*part.schema.names, "facts"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("facts", T.StructType.fromDDL(FACTS))]))


def digest(files: DataFrame) -> DataFrame:
    """Digests of pack_texts() files, the payload of their one track read back through the sample tables."""
    track = F.get("facts.tracks", F.lit(0))
    ranges = F.array_join(F.transform("track.keyframes", lambda k: F.concat(k["start"].cast("string"), F.lit("-"), k["end"].cast("string"))), ",")
    feature = F.concat_ws(";", "track.codec", F.col("track.duration").cast("string"), F.col("track.n_samples").cast("string"), F.size("track.keyframes").cast("string"), F.md5(ranges.cast("binary")))
    payload = F.col("track.payload")
    return scan_media(files).select("doc_id", "n_bytes", "media", track.alias("track")).select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -UNIT, UNIT)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
