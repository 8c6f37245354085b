import hashlib
import tracemalloc
import uuid

import pyarrow as pa
import pytest

from pagelens.llm import suffix_dedup

from .conftest import ODD


def brute(texts, length):
    seen = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [1000, 2, 5])
def test_against_brute_force(docs_of, rnd, hot):
    base = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 300))) for _ in range(30)]
    texts = ["".join(x[rnd.randint(0, len(x) // 2) : rnd.randint(len(x) // 2, len(x))] for x in rnd.sample(base, rnd.randint(1, 4))) for _ in range(100)]
    texts += ["a" * 300, "ab" * 70, "abc" * 50, "", None, texts[3], texts[3]]
    want = brute([(t or "").encode() for t in texts], 40)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(texts), 40, 8, hot).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], bytes(got[i]["kept"])) for i in range(len(texts))] == want


def test_odd_rows(docs_of):
    texts = [*ODD, "q" * 399, "unique " + hashlib.sha256(b"x").hexdigest() * 10, "y" * 50 + "z" * 400, "w" * 30 + "z" * 400]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of(texts)).collect()}
    want = brute([(t or "")[:3000].encode() for t in texts], 400)
    for i, t in enumerate(texts):
        if len(t or "") <= 3000:
            assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == want[i][:3]
    assert got[4]["n_removed"] == 150_000 and suffix_dedup.remove_repeats(docs_of([])).count() == 0


def test_texts_longer_than_a_piece(docs_of, rnd, monkeypatch):
    filler = lambda n: "".join(rnd.choices("abcdefghij ", k=n))
    shared = filler(900)
    a, b = filler(1_060_000) + shared + filler(2000), filler(3000) + shared + filler(1_050_000)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs_of([a, b])).collect()}
    assert 900 <= got[0]["n_removed"] <= 904 and got[0]["n_removed"] == got[1]["n_removed"] and got[0]["n_spans"] == 1


def test_contexts_of_copies_are_cut_once(docs_of, rnd, tmp_path, monkeypatch):
    text = "".join(rnd.choices("abcdefghij ", k=300))
    edited = text[:150] + "#" + text[151:]
    cut = suffix_dedup._cut_contexts

    def counted(batches, **size):
        for b in cut(batches, **size):
            (tmp_path / str(uuid.uuid4())).write_text(str(b.num_rows - len(set(zip(*(b.column(c).to_pylist() for c in ("gram", "tk", "pos")))))))
            yield b

    monkeypatch.setattr(suffix_dedup, "_cut_contexts", counted)
    texts = [text] * 20 + [edited]
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs_of(texts).coalesce(1), 40, 8).collect()}
    assert [got[i] for i in range(21)] == [x[1] for x in brute([t.encode() for t in texts], 40)]
    more = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert more and not any(more)


def test_memory_does_not_follow_the_batch(rnd):
    """What a worker's arrays take at most over a batch of 4 000 texts, 12 MB; Arrow's own memory isn't counted."""
    words = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(2000)]
    texts = [" ".join(rnd.choices(words, k=375)) for _ in range(4000)]
    docs = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])

    def most(rows):
        tracemalloc.start()
        n = sum(b.num_rows for b in rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return n, peak / 1e6

    packed = pa.Table.from_batches(suffix_dedup._packed([docs])).combine_chunks().to_batches()[0]
    at = [[{"gram": i, "pos": 1000, "single": True, "hot": False}] for i in range(len(texts))]
    lists = pa.record_batch([packed["tk"], packed["z"], pa.array(at)], ["tk", "z", "at"])
    spans = pa.record_batch([packed["doc_id"], packed["z"], pa.array([[{"s": 0, "e": 400}]] * len(texts))], ["doc_id", "z", "spans"])
    for rows, bound in (
        (suffix_dedup._packed([docs]), 4),
        (suffix_dedup._cut_contexts([lists], 400, 64), 4),
        (suffix_dedup._remove([spans]), 3),
    ):
        n, mb = most(rows)
        assert n == len(texts) and mb < bound
    n, mb = most(suffix_dedup._find_anchors([docs.select(["text"]).slice(0, 600)], 400, 64))
    assert n > 600 and mb < 50
