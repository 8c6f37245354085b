import hashlib
import struct
import zlib

import numpy as np
import pytest

from pagelens.llm import media

from .conftest import ODD


def padded(text):
    b = (text or "").encode()
    return b + bytes(-len(b) % 64 if b else 64)


def test_round_trip(spark, docs_of):
    rows = {r["doc_id"]: r for r in media.digest(media.pack_texts(docs_of(ODD))).collect()}
    for i, t in enumerate(ODD):
        p, r = padded(t), rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.pack(p)), hashlib.sha256(media.pack(p)).hexdigest())
    assert rows[5]["feature"] == rows[6]["feature"] and media.digest(media.pack_texts(docs_of([]))).count() == 0


@pytest.mark.parametrize("units", [1, 15, 16, 17, 32, 40])
def test_sample_tables(units):
    payload = bytes(range(64)) * units
    data = media.pack(payload)
    (track,) = media.walk(data)
    at, size = track.samples()
    assert (track.codec, track.kind, track.length, track.seconds(), len(at)) == ("raw ", "soun", units, units / media.RATE, units)
    assert b"".join(data[s : s + n] for s, n in zip(at, size)) == payload
    assert list(track.sync(units)) == list(range(0, units, 8))


def test_uneven_tables():
    t = media.Track(2000)
    t.tables = {b"stsz": memoryview(struct.pack(">IIIIIII", 0, 0, 4, 5, 6, 7, 8)), b"stsc": memoryview(struct.pack(">IIIIIIII", 0, 2, 1, 3, 1, 2, 1, 1)), b"co64": memoryview(struct.pack(">IIQQ", 0, 2, 100, 900))}
    at, size = t.samples()
    assert at.tolist() == [100, 105, 111, 900] and size.tolist() == [5, 6, 7, 8] and t.sync(4).tolist() == [0, 1, 2, 3]


def test_broken_files(spark):
    good = media.pack(bytes(128))
    broken = [None, b"", b"abc", good[:-1], good[:200], good.replace(b"stco", b"xxxx"), struct.pack(">I4s", 4, b"moov"), good[:36] + bytes(8) + good[36:], np.random.default_rng(1).bytes(500)]
    df = spark.createDataFrame([(i, b) for i, b in enumerate([good, *broken])], "codec long, media binary")
    rows = {r["codec"]: r["facts"] for r in media.scan_media(df).collect()}
    assert rows[0]["error"] is None and rows[0]["tracks"][0]["n_samples"] == 2 and rows[1]["error"] == "no data" and rows[2]["tracks"] == []
    assert len(rows) == 10 and all(rows[i]["error"] or not any(t["n_samples"] for t in rows[i]["tracks"]) for i in range(1, 10) if i != 8)
    assert media.scan_media(df, payload=False).where("exists(facts.tracks, t -> t.payload is not null)").count() == 0


def test_column_of_the_same_name(spark):
    df = spark.createDataFrame([(1, media.pack(bytes(64)), "mine")], "id long, media binary, Facts string")
    rows = media.scan_media(df)
    assert rows.columns == ["id", "media", "facts"] and rows.first()["facts"]["tracks"][0]["n_samples"] == 1


def box(kind, *content):
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, flags, *words):
    return box(kind, struct.pack(f">{1 + len(words)}I", flags, *words))


def trak(number, codec, handler, tables=b""):
    stbl = box(b"stbl", box(b"stsd", struct.pack(">II", 0, 1), box(codec, bytes(8))), tables)
    return box(b"trak", full(b"tkhd", 0, 0, 0, number, 0, 0), box(b"mdia", full(b"mdhd", 0, 0, 0, 10, 30, 0), box(b"hdlr", struct.pack(">II4s12x", 0, 0, handler)), box(b"minf", stbl)))


def facts(spark, data):
    return media.scan_media(spark.createDataFrame([(data,)], "media binary")).first()["facts"]


def test_every_track_is_read(spark):
    """Two tracks whose samples lie between each other's, in chunks of uneven sizes."""

    def tables(at, first, second):
        return full(b"stts", 0, 1, 2, 15) + full(b"stss", 0, 1, 2) + full(b"stsc", 0, 1, 1, 1, 1) + full(b"stsz", 0, 0, 2, first, second) + full(b"stco", 0, 2, *at)

    mdat = box(b"mdat", b"AAAbbAAAAb")
    data = mdat + box(b"moov", trak(1, b"avc1", b"vide", tables((8, 13), 3, 4)), trak(2, b"mp4a", b"soun", tables((11, 17), 2, 1)))
    got = facts(spark, data)
    assert got["error"] is None
    assert [(t["codec"], t["kind"], t["duration"], t["n_samples"], bytes(t["payload"]), [tuple(k) for k in t["keyframes"]]) for t in got["tracks"]] == [
        ("avc1", "vide", 3.0, 2, b"AAAAAAA", [(13, 17)]),
        ("mp4a", "soun", 3.0, 2, b"bbb", [(17, 18)]),
    ]


def test_fragments(spark):
    """Movie fragments: sizes, times and flags from runs, fragment headers and the movie's defaults."""
    moov = box(b"moov", trak(1, b"avc1", b"vide"), trak(2, b"mp4a", b"soun"), box(b"mvex", full(b"trex", 0, 1, 1, 5, 0, 0x10000), full(b"trex", 0, 2, 1, 4, 2, 0)))

    def moof(offset):
        first = box(b"traf", full(b"tfhd", 0x20000, 1), full(b"trun", 0x205, 3, offset, 0, 3, 1, 2))
        second = box(b"traf", full(b"tfhd", 0, 2), full(b"trun", 0, 2), full(b"trun", 0x100, 1, 7))
        third = box(b"traf", full(b"tfhd", 0x20008, 1, 9), full(b"trun", 0x601, 2, offset + 12, 1, 0x10000, 1, 0))
        return box(b"moof", first, second, third)

    fragment = moof(len(moof(0)) + 8)
    start = len(moov) + len(fragment) + 8
    got = facts(spark, moov + fragment + box(b"mdat", b"VVVwxxaabbccYZ"))
    assert got["error"] is None
    assert [(t["duration"], t["n_samples"], bytes(t["payload"]), [(k["start"] - start, k["end"] - start) for k in t["keyframes"]]) for t in got["tracks"]] == [
        (3.3, 5, b"VVVwxxYZ", [(0, 3), (13, 14)]),
        (1.5, 3, b"aabbcc", [(6, 8), (8, 10), (10, 12)]),
    ]
    assert "unknown track" in facts(spark, fragment + moov)["error"]


def test_tables_that_claim_too_much(spark):
    """Counts far beyond the file are an error, not memory."""
    many = (1 << 32) - 1
    fixed = full(b"stsc", 0, 1, 1, many, 1) + full(b"stsz", 0, 64, many) + full(b"stco", 0, 1, 8)
    chunk = full(b"stsc", 0, 1, 1, many, 1) + full(b"stsz", 0, 2, 2) + full(b"stco", 0, 1, 8)
    assert "outside" in facts(spark, box(b"moov", trak(1, b"avc1", b"vide", fixed)))["error"]
    got = facts(spark, box(b"mdat", b"aabb") + box(b"moov", trak(1, b"avc1", b"vide", chunk)))
    assert bytes(got["tracks"][0]["payload"]) == b"aabb"
    run = box(b"moof", box(b"traf", full(b"tfhd", 0, 1), full(b"trun", 0, many)))
    assert "outside" in facts(spark, box(b"moov", trak(1, b"avc1", b"vide")) + run)["error"]
