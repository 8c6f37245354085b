"""Helpers shared by the training-data operators: cutting lineage and reading Arrow text without copies."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}

#: White space of the corpus' word rule ``[^\\x20\\x09-\\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def materialize(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, the session's ``spark.checkpoint.dir``; its lineage is cut."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession) -> str:
    """A path for a table of its own in the shared checkpoint folder."""
    return f"{_shared_folder(spark)}/{uuid.uuid4()}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to a scratch() path and read again; for large, compressible tables.

    The files go when the driver's session ends, or at discard().
    """
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    place, files = _place(df.sparkSession, path)
    files.deleteOnExit(place)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes stored() tables that nothing reads any more; paths without one are left."""
    for path in paths:
        place, files = _place(spark, path)
        files.delete(place, True)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _shared_folder(spark: SparkSession) -> str:
    """A folder of this session in ``spark.checkpoint.dir``; only on a local master, where it may be unset, a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column of the name that an operator is about to add, whatever its case."""
    return df.select([c for c in df.columns if c.lower() != name.lower()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as make it no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string or binary column; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw, off - off[0]


def row_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes, or a single row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least, kept per worker."""
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, 2 * have, 1 << 16)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial of the first i bytes; substring hashes come from substring_hash."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def substring_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal contents give equal values wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


#: Bytes of words once text is lower-cased: ASCII letters (folded), digits, all of UTF-8's multi-byte sequences.
_FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalnum():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _FOLD[_b] = _b


#: Bytes of text that are hashed in one go; a longer stretch only where no word ends.
STRETCH = 1 << 22


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of concatenated texts: (hash, row, start, end), in text order. Words never cross rows.

    ``fold`` tells the byte that each byte counts as in words, 0 between them; by default words are alphanumeric.
    """
    parts, lo = [], 0
    while lo < len(data):
        hi = min(lo + STRETCH, len(data))
        if hi < len(data):  # back to a separator, else on to the next
            gap = np.flatnonzero(fold[data[lo:hi]] == 0)
            if len(gap):
                hi = lo + int(gap[-1]) + 1
            else:
                gap = np.flatnonzero(fold[data[hi:]] == 0)
                hi = hi + int(gap[0]) + 1 if len(gap) else len(data)
        parts.append(_words(data, offsets, lo, hi, fold))
        lo = hi
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*parts))


def _words(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    folded = fold[data[lo:hi]]
    inside = folded != 0
    edge = np.zeros(hi - lo + 1, bool)
    near = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, "right")]
    edge[near - lo] = True
    start = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    return substring_hash(prefix_hash(folded), start, end), np.searchsorted(offsets, start + lo, "right") - 1, start + lo, end + lo


def chain(*hashes: np.ndarray) -> np.ndarray:
    """One hash of a sequence of hashes; the order counts."""
    h = hashes[0]
    for x in hashes[1:]:
        h = mix(h * BASE + x)
    return h
