import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import decontaminate, language_id, toxicity
from pagelens.llm.common import word_hashes

from .conftest import ODD

WORDS = {"xx": "baba lolo kaka mimi".split(), "yy": "strunt flirk grost prelm".split(), "zz": "éàü îôé ñóá ççê".split()}


def corpus(rnd, n=240):
    langs = [sorted(WORDS)[i % 3] for i in range(n)]
    return [" ".join(rnd.choices(WORDS[x], k=rnd.randint(3, 40))) for x in langs], langs


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id(docs_of, rnd):
    texts, langs = corpus(rnd)
    texts += [*ODD[:4], "12 34 !!", "漢字漢字漢字漢字漢字漢字"]
    langs += [None, "xx", "xx", None, "yy", None]
    rows = {r["doc_id"]: r for r in language_id.identify(docs_of(texts, langs=langs)).collect()}
    assert all(rows[i]["held_out"] == held_out(i) and 0 <= rows[i]["score"] <= 1 for i in rows)
    assert np.mean([rows[i]["lang_pred"] == langs[i] for i in range(240) if held_out(i)]) > 0.98
    assert [rows[i]["lang_pred"] for i in (240, 241, 242, 244)] == ["und"] * 4 and all(rows[i]["rejected"] for i in (240, 241, 244))
    assert rows[245]["rejected"] and rows[245]["lang_pred"] in WORDS and not any(rows[i]["rejected"] for i in range(240))
    assert language_id.identify(docs_of([])).count() == 0


def test_language_id_against_plain_cosines(docs_of, rnd, monkeypatch):
    """TF-IDF by dictionaries: a text's score is its cosine with the nearest centroid, and centroids are means of like texts."""
    texts, langs = corpus(rnd, 90)
    monkeypatch.setattr(language_id, "_cluster", lambda x, k, rounds=12: x.mean(axis=0, keepdims=True))
    d = docs_of(texts, langs=langs)
    model = language_id.fit(d)
    got = {r["doc_id"]: r["language_id"] for r in language_id.predict(d, model).collect()}

    def counts(t):
        dims, n = language_id.gram_counts([t])
        assert n[0] == sum(c.isalpha() for c in t)
        return {int(i): float(dims[0, i]) for i in np.flatnonzero(dims[0])}

    grams = [counts(t) for t in texts]
    learn = [i for i in range(90) if not held_out(i)]
    df = Counter(g for i in learn for g in grams[i])
    idf = lambda g: math.log((1 + len(learn)) / (1 + df[g])) + 1

    def unit(v):
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    vectors = [unit({g: math.log(1 + n) * idf(g) for g, n in x.items()}) for x in grams]
    first = {texts[i]: i for i in reversed(learn)}  # copies of a text are learned from once
    centres = {}
    for lang in WORDS:
        own = [vectors[i] for i in first.values() if langs[i] == lang]
        centres[lang] = Counter()
        for v in own:
            for g, x in v.items():
                centres[lang][g] += x / len(own)
    for i, v in enumerate(vectors):
        cos = {lang: sum(x * c[g] for g, x in v.items()) for lang, c in centres.items()}
        best = max(cos, key=cos.get)
        assert got[i]["lang"] == best and abs(got[i]["score"] - cos[best]) < 2e-3


def grams_of(text):
    """Character n-grams of one to three letters, a space for what stands between letters, none across two words."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = []
    for w in words:
        out += list(w)
        for n in (2, 3):
            out += [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    return Counter(out)


def test_gram_counts(rnd):
    texts = ["Ab c", "", "x", "  12 é漢-z ", "aaa aaa", " ".join(rnd.choices(WORDS["xx"], k=50))]
    got, _ = language_id.gram_counts(texts)
    for row, t in zip(got, texts):
        want = grams_of(t)
        # between two words one space belongs to both, so the n-grams that only touch it are as many as the words
        assert row.sum() == sum(want.values()) and len(np.flatnonzero(row)) <= len(want)


def test_one_id_on_very_many_rows(spark, docs_of, rnd, monkeypatch):
    """The samples are bounded by rows, however often an id or a text is repeated."""
    seen = spark.sparkContext.accumulator(0)
    cluster, features = language_id._cluster, toxicity.features

    def counted(x, k, rounds=12):
        seen.add(len(x))
        return cluster(x, k, rounds)

    monkeypatch.setattr(language_id, "_cluster", counted)
    texts, langs = corpus(rnd, 60)
    one = next(i for i in range(100) if not held_out(i))
    many = spark.range(100_000).select(F.lit(one).cast("long").alias("doc_id"), F.concat(F.lit("baba lolo "), F.col("id") % 50_000).alias("text"), F.lit("xx").alias("lang"))
    d = docs_of(texts, langs=langs).select("doc_id", "text", "lang").unionByName(many)
    model = language_id.fit(d, max_rows=90)
    assert set(model.langs) == set(WORDS) and 30 <= seen.value <= 90
    assert set(language_id.fit(d, max_rows=90, max_langs=1).langs) == {"xx"}
    labels = spark.createDataFrame([(one, 1), (one, 1), (one, 0)], "doc_id long, toxic int")
    rows = spark.sparkContext.accumulator(0)

    def of(data, offsets):
        rows.add(len(offsets) - 1)
        return features(data, offsets)

    monkeypatch.setattr(toxicity, "features", of)
    toxicity.fit(d, labels, epochs=1)
    assert rows.value == 2


def test_prediction_uses_text_alone(docs_of, rnd):
    texts, langs = corpus(rnd, 60)
    model = language_id.fit(docs_of(texts, langs=langs))
    one = {r["text"]: r["language_id"] for r in language_id.predict(docs_of(texts, langs=langs), model).collect()}
    two = {r["text"]: r["language_id"] for r in language_id.predict(docs_of(texts[::-1], ids=[None] * 60, langs=[None] * 60).repartition(3), model).collect()}
    assert one.keys() == two.keys() and all(one[t]["lang"] == two[t]["lang"] and abs(one[t]["score"] - two[t]["score"]) < 2e-6 for t in one)


def test_toxicity(spark, docs_of, rnd):
    plain, bad = [f"w{i}" for i in range(60)], ["grr", "bah", "pfui"]
    texts, toxic = [], []
    for i in range(400):
        y = i % 4 == 0
        words = rnd.choices(plain, k=20)
        for _ in range(3 * y):
            words.insert(rnd.randint(0, 20), rnd.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(y))
    labels = spark.createDataFrame([(i, 0, y) for i, y in enumerate(toxic)] + [(None, 0, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    d = docs_of([*texts, *ODD])
    rows = {}
    for r in toxicity.classify(d, labels).collect():
        rows[r["doc_id"]] = r
    assert len(rows) == 400 + len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert np.mean([rows[i]["predicted"] == toxic[i] for i in range(400) if held_out(i)]) > 0.97
    assert rows[400]["score"] == rows[401]["score"] == rows[402]["score"]
    nothing = toxicity.classify(d, labels.where("doc_id < 0")).collect()
    assert {r["score"] for r in nothing} == {0.5} and toxicity.classify(docs_of([]), labels).count() == 0


def test_ftrl_against_one_weight_at_a_time(rnd):
    """McMahan et al. 2013, algorithm 1, with dictionaries."""
    z, n = defaultdict(float), defaultdict(float)
    model = toxicity.Ftrl()
    weight = lambda i: 0.0 if i != toxicity.DIMS and abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1 * (i != toxicity.DIMS), z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    for _ in range(400):
        y = rnd.randint(0, 1)
        at = sorted({rnd.randrange(30) + 20 * y for _ in range(8)})
        model.learn(np.array(at), y)
        w = {i: weight(i) for i in [*at, toxicity.DIMS]}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
            n[i] += g * g
    keys = [*range(50), toxicity.DIMS]
    assert np.allclose(model.weights(np.array(keys)), [weight(i) for i in keys]) and sum(weight(i) == 0 for i in keys) < 50


def test_accuracy_on_the_tables(spark, sf_dir):
    """Held-out rows of the given tables."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in language_id.identify(docs).collect() if r["held_out"] and truth[r["doc_id"]] is not None and r["lang_pred"] != "und"]
    assert len(rows) > 30 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) > 0.95
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.classify(docs, labels).collect() if r["held_out"] and toxic.get(r["doc_id"]) is not None]
    assert len(rows) > 20 and np.mean([r["predicted"] == toxic[r["doc_id"]] for r in rows]) > 0.9


def test_columns_of_the_same_name(spark, docs_of, rnd):
    """A column of the input that has the result's name is replaced."""
    texts, langs = corpus(rnd, 30)
    d = docs_of(texts, langs=langs)
    rows = language_id.predict(d.withColumn("Language_ID", F.lit("mine")), language_id.fit(d))
    assert rows.columns == [*d.columns, "language_id"] and rows.first()["language_id"]["lang"] in WORDS
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    rows = toxicity.score(d.withColumn("toxicity", F.lit("mine")), toxicity.fit(d, labels))
    assert rows.columns == [*d.columns, "toxicity"] and 0 <= rows.first()["toxicity"] <= 1


def hashes(text):
    b = np.frombuffer(text.lower().encode(), np.uint8)
    return word_hashes(b, np.array([0, len(b)]))[0]


def smith_waterman(a, b):
    s = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            s[i + 1, j + 1] = max(0, s[i, j] + (2 if a[i] == b[j] else -1), s[i, j + 1] - 1, s[i + 1, j] - 1)
    return s.max()


def test_alignment(rnd):
    for _ in range(60):
        a, b = (hashes(" ".join(rnd.choices("a b c d e f".split(), k=rnd.randint(1, 25)))) for _ in "ab")
        score, start, end = decontaminate.align(a, b)
        assert score == smith_waterman(a, b)
        if score:
            assert smith_waterman(a, b[start:end]) == score
    assert decontaminate.align(hashes("a b"), hashes("")) == (0, 0, 0)


def test_decontamination(spark, docs_of, rnd):
    vocabulary = [f"v{i}" for i in range(500)]
    passage = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [passage(30) for _ in range(20)] + [None, "", "Zap!", items_short := "one two"]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    edited = " ".join("new" if i % 7 == 3 else w for i, w in enumerate(items[4].split()))
    texts = [*ODD, passage(300), f"{passage(40)} {items[2].upper()} {passage(40)}", f"intro {edited} end", f"so ZAP it and {items_short} too", " ".join(items[5].split()[:8])]
    for block in (1_000_000, 100):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated_passages(docs_of(texts), b, block_words=block).collect()}
        assert set(got) == {(9, 2), (10, 4), (11, 22), (11, 23)}
        assert got[9, 2]["score"] == 1 and (got[9, 2]["start"], got[9, 2]["end"]) == (40, 70) and 0.5 < got[10, 4]["score"] < 1
        assert got[9, 2]["matched"] == items[2].lower()
        kept = decontaminate.drop_contaminated(docs_of(texts), b, block_words=block)
        assert sorted(r["doc_id"] for r in kept.collect()) == [*range(9), 12] and kept.columns[-1] == "score"
    assert decontaminate.contaminated_passages(docs_of(texts), b.where("item_id < 0")).count() == 0 and decontaminate.contaminated_passages(docs_of([]), b).count() == 0


def test_copies_of_an_edited_passage_are_found(spark, docs_of):
    words = [f"p{i}" for i in range(20)]
    edited = [f"new{i}" if i in (3, 7, 11, 15) else w for i, w in enumerate(words)]
    docs = docs_of([" ".join(words), *[" ".join(edited)] * 1000])
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert decontaminate.contaminated_passages(docs, b).count() == 1001 and decontaminate.drop_contaminated(docs, b).count() == 0


def exhaustive(texts, items, threshold=0.5):
    """{(text, item): score} of all pairs aligned as a whole."""
    words, out = [hashes(t or "") for t in texts], {}
    for k, item in enumerate(items):
        w = hashes(item or "")
        for i, t in enumerate(words):
            score = decontaminate.align(w, t)[0] / (2 * len(w)) if len(w) and len(t) else 0
            if score >= threshold and len(w):
                out[i, k] = score
    return out


def edited(rnd, words, share):
    return [f"e{rnd.randrange(9999)}" if rnd.random() < share else w for w in words]


def test_recall_against_exhaustive_alignment(spark, docs_of, rnd):
    """The exact way finds every pair, seeds all verbatim copies and nearly all copies of items of eight words or more."""
    vocabulary = [f"v{i}" for i in range(1000)]
    items = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 40))) for _ in range(25)]
    texts = [" ".join([*rnd.choices(vocabulary, k=30), *edited(rnd, rnd.choice(items).split(), rnd.choice([0, 0.1, 0.2, 0.3])), *rnd.choices(vocabulary, k=20)]) for _ in range(120)]
    want = exhaustive(texts, items)
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = lambda **more: {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated_passages(docs_of(texts), b, **more).collect()}
    exact = rows(rare=None, seed_words=1, min_seeds=1)
    assert exact.keys() == want.keys() and all(abs(exact[k] - want[k]) < 1e-9 for k in want)
    seeded = rows()
    assert all(abs(seeded[k] - want[k]) < 1e-9 for k in seeded) and seeded.keys() >= {k for k, v in want.items() if v == 1}
    long = {k for k in want if len(items[k[1]].split()) >= 8}
    assert len(seeded.keys() & long) >= 0.95 * len(long) and len(long) > 80


def test_recall_on_the_tables(spark, sf_dir):
    docs, b = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts, items = ({r[0]: r["text"] for r in d.collect()} for d in (docs.select("doc_id", "text"), b.select("item_id", "text")))
    want = exhaustive(list(texts.values()), list(items.values()))
    want = {(list(texts)[i], list(items)[k]): v for (i, k), v in want.items()}
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated_passages(docs, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_repeated_and_long_items(spark, docs_of):
    long = " ".join(f"w{i}" for i in range(400))
    b = spark.createDataFrame([(1, "one two three four five"), (2, "One two three four five"), (None, "one two three four five"), (3, long)], "item_id long, text string")
    d = docs_of(["so one two three four five six", long, "nothing"]).withColumnRenamed("score", "low")
    for block in (1_000_000, 50):
        got = [(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_passages(d, b, block_words=block).collect()]
        assert sorted(got, key=str) == sorted([(0, 1), (0, 2), (0, None), (1, 3)], key=str)
        kept = decontaminate.drop_contaminated(d, b, block_words=block)
        assert [r["doc_id"] for r in kept.collect()] == [2] and kept.columns == d.columns
