import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagelens.llm import simhash
from pagelens.llm.components import connected_components

from .conftest import ODD


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).translate({i: 32 for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps):
    """Smallest id reachable over links of 3 bits or fewer."""
    label, todo = {}, set(range(len(ids)))
    while todo:
        part, queue = set(), [todo.pop()]
        while queue:
            i = queue.pop()
            part.add(i)
            near = {j for j in todo if bin(fps[i] ^ fps[j]).count("1") <= 3}
            todo -= near
            queue += near
        for i in part:
            label[ids[i]] = min(ids[j] for j in part)
    return label


@pytest.mark.parametrize("text", ["", " \x0b ", "One", "One two", "A b c", "É A b\tc  d", "the cat sat on the mat the cat sat on"])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row["h"] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot", [4096, 2])
def test_components_against_brute_force(spark, rnd, hot):
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for c in centres:
        for _ in range(25):
            x = c
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    got = {r["node"]: r["component"] for r in connected_components(links).collect()}
    label = classes(signed, [f & (1 << 64) - 1 for f in signed])
    groups = lambda m: {frozenset(k for k in set(signed) if m.get(k, k) == v) for v in {m.get(k, k) for k in signed}}
    assert groups(got) == groups(label)


@pytest.mark.parametrize("unlinked", [True, False])
def test_very_many_fingerprints_that_share_five_bytes(rnd, unlinked):
    """Looked-up partners join what a search through all pairs joins, and links don't grow with the square."""
    free, n = (1, 4, 6), 3000
    spread = lambda x: sum((x >> 8 * k & 0xFF) << 8 * p for k, p in enumerate(free))
    values = rnd.sample(range(1 << 24), n) if unlinked else [c ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 4))) for c in rnd.sample(range(1 << 24), 10) for _ in range(n // 10)]
    base = rnd.getrandbits(64)
    base &= ~spread((1 << 24) - 1)
    fps = np.array(sorted({base | spread(v) for v in values}), np.uint64)

    def parts(links):
        root = {int(x): int(x) for x in fps}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for u, v in links:
            for a, b in zip(u.tolist(), v.tolist()):
                root[find(a)] = find(b)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return {frozenset(g) for g in groups.values()}

    links = simhash._by_flips(np.array(rnd.sample(fps.tolist(), len(fps)), np.uint64), free)
    assert all((np.bitwise_count(u ^ v) <= 3).all() for u, v in links)
    assert parts(links) == parts(simhash._forest(fps)) and sum(len(u) for u, _ in links) < 20 * n


def test_long_postings_in_place(spark, rnd, monkeypatch):
    monkeypatch.setattr(simhash, "MANY", 8)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(24), rnd.randint(0, 5))) for _ in range(400)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = pa.RecordBatch.from_arrays([pa.array([100 + simhash.FIVES.index((3, 4, 5, 6, 7))] * len(fps), pa.int16()), pa.array([0] * len(fps)), pa.array(signed)], ["design", "key", "fp"])
    (links,) = simhash._links_of_postings(iter([table]))
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links.to_pandas())).collect()}
    label = classes(signed, [f & (1 << 64) - 1 for f in signed])
    assert {(x, y) for x in signed for y in signed if got.get(x, x) == got.get(y, y)} == {(x, y) for x in signed for y in signed if label[x] == label[y]}


def test_odd_rows(spark, docs_of):
    rows = simhash.near_duplicates(docs_of(ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["fingerprint"] == "0" * 16 and {by[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert by[5]["component_id"] == by[6]["component_id"] == 5
    assert all(r["fp"] & (1 << 64) - 1 == simhash.fingerprint((t or "").encode()) for r, t in ((by[i], ODD[i]) for i in range(len(ODD))))
    assert simhash.near_duplicates(docs_of([])).count() == 0


def test_chain_of_links(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (3, 2), (1000, 1001)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert np.all([v == 0 for k, v in got.items() if k <= n])
