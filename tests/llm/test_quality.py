import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import quality as q

from .conftest import ODD


def packed(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_passages_of_a_text_do_not_depend_on_the_others(rnd):
    texts = [t or "" for t in ODD] + [" ".join(rnd.choices(["Aa", "b!", "cc", "\n", "é"], k=rnd.randint(0, 300))) for _ in range(20)]
    x, count = q.passages(*packed(texts))
    assert [max(1, -(-len([w for w in t.split() if w]) // q.PASSAGE)) for t in texts] == count.tolist()
    at = 0
    for t, n in zip(texts, count):
        alone, one = q.passages(*packed([t]))
        assert one[0] == n and np.allclose(alone, x[at : at + n], atol=1e-6)
        at += n


def test_features_are_what_they_say():
    x, count = q.passages(*packed(["AB ab ab 1"]))
    k = q.N_CLASSES**2
    kinds = [1, 1, 3, 0, 0, 3, 0, 0, 3, 2]
    want = np.zeros(k)
    for a, b in zip(kinds, kinds[1:]):
        want[a * q.N_CLASSES + b] += 0.1
    assert count.tolist() == [1] and np.allclose(x[0, :k], np.sqrt(want), atol=1e-6) and np.isclose((x[0, k : k + q.TRIGRAMS] ** 2).sum(), 0.8)
    assert np.allclose(x[0, -q.STATS :], [1 / 4, 3 / 4, 7 / 40, np.sqrt(3.25 - 1.75**2) / 10, 1 / 4, 1, np.log(5) / 5, np.log(11) / 8], atol=1e-6)


def scalar(m, bag):
    """One text's logit and attention, passage by passage."""
    codes = [np.tanh(v @ m["W"] + m["b"]) for v in bag]
    e = [float(np.dot(np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"]))), m["w"])) for h in codes]
    a = np.exp(e) / np.exp(e).sum()
    return float(sum(w * h for w, h in zip(a, codes)) @ m["c"] + m["c0"][0]), a


def test_forward_and_gradients():
    rng = np.random.default_rng(3)
    m = q.initial(rng)
    count, label = np.array([1, 4, 2, 7]), np.array([1, 0, 0, 1])
    x = rng.normal(size=(count.sum(), q.WIDTH))
    logit, f = q.forward(m, x, count)
    at = np.cumsum(count) - count
    for i in range(4):
        one, a = scalar(m, x[at[i] : at[i] + count[i]])
        assert np.isclose(one, logit[i]) and np.allclose(a, f["a"][at[i] : at[i] + count[i]])
    loss = lambda: np.mean([np.log1p(np.exp(-v if y else v)) for v, y in zip(q.forward(m, x, count)[0], label)])
    g = q.gradients(m, x, count, label)
    for k in m:
        for _ in range(6):
            i = tuple(rng.integers(s) for s in m[k].shape)
            before = m[k][i]
            m[k][i] = before + 1e-5
            up = loss()
            m[k][i] = before - 1e-5
            slope = (up - loss()) / 2e-5
            m[k][i] = before
            assert np.isclose(slope, g[k][i], rtol=1e-3, atol=1e-7), k


def test_one_bad_passage_is_found(spark, docs_of, rnd):
    """Documents are bad for one passage among many; attention goes to it."""
    good = lambda n: " ".join(rnd.choices("alpha beta gamma delta epsilon zeta".split(), k=n))
    bad = " ".join(rnd.choices(["@@##", "$$%%", "&&**"], k=q.PASSAGE))
    texts, labels = [], []
    for i in range(240):
        parts = [good(q.PASSAGE) for _ in range(rnd.randint(2, 8))]
        labels.append(i % 2)
        if not i % 2:
            parts[rnd.randrange(len(parts))] = bad
        texts.append(" ".join(parts))
    d = docs_of(texts + [None, ""]).withColumn("Quality", F.lit("mine"))
    y = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    rows = q.score(d, q.fit(d, y))
    assert rows.columns == [*d.columns[:-1], "quality"]
    rows = {r["doc_id"]: r for r in rows.collect()}
    assert np.mean([(rows[i]["quality"]["score"] >= 0.5) == labels[i] for i in range(240)]) > 0.97
    hit = [int(np.argmax(rows[i]["quality"]["attention"])) == next(k for k in range(9) if texts[i].split()[k * q.PASSAGE][0] in "@$&") for i in range(0, 240, 2)]
    assert np.mean(hit) > 0.9 and all(abs(sum(r["quality"]["attention"]) - 1) < 1e-9 for r in rows.values())
    assert rows[240]["quality"] == rows[241]["quality"]


def test_labels_of_held_out_rows_are_not_read(spark, docs_of, rnd):
    texts = [" ".join(rnd.choices(["yes", "ok"] if i % 2 else ["NO!", "##"], k=30)) for i in range(120)]
    d = docs_of(texts)
    y = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    flipped = y.withColumn("quality", F.when(q.learnable(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (sorted(map(tuple, q.classify(d, labels).collect())) for labels in (y, flipped))
    assert a == b and 20 < sum(r[1] for r in a) < 60
    nothing = q.classify(d, y.where("doc_id < 0")).collect()
    assert {r["score"] for r in nothing} == {0.5} and {r["predicted"] for r in nothing} == {1} and q.classify(docs_of([]), y).count() == 0
    odd = q.classify(docs_of(ODD), y).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


def test_accuracy_on_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in q.classify(docs, labels).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert len(rows) > 15 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) > 0.85
