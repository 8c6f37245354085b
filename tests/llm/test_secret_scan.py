"""All ordinary text counts: the strings that tokens are held against, and the thresholds that follow from them."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagelens.llm import queries, secret_scan

from .conftest import ODD
from .test_native import base_spans, plain_step, size_class


def strings(text):
    """Ordinary strings of a text, cut off one by one."""
    left = re.sub("[^A-Za-z0-9]+", "", re.sub(secret_scan.TOKEN, "", text))
    out, whole = [], sum(secret_scan.LENGTHS)
    while len(left) >= whole:
        for n in secret_scan.LENGTHS:
            out.append(left[:n])
            left = left[n:]
    while fits := [n for n in secret_scan.LENGTHS if n <= len(left)]:
        out.append(left[: max(fits)])
        left = left[max(fits) :]
    return out


def all_random(texts, fdr=0.05):
    """(text, start, end) of the tokens that are reported when all ordinary text counts."""
    found, tokens, plain = [], defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for m in re.finditer(secret_scan.TOKEN, t):
            found.append((i, *m.span(), size_class(len(m[0])), plain_step(m[0])))
            tokens[found[-1][3]].add((found[-1][4], m[0]))
        for s in strings(t):
            plain[size_class(len(s))].add((plain_step(s), s))
    limit = {}
    for c, some in tokens.items():
        for step, _ in some:
            p = (1 + sum(x <= step for x, _ in plain[c])) / (1 + len(plain[c]))
            if p <= fdr * sum(x <= step for x, _ in some) / len(some):
                limit[c] = max(step, limit.get(c, -1))
    return {(i, s, e) for i, s, e, c, step in found if step <= limit.get(c, -1)}


def test_all_ordinary_text_is_cut(docs_of, rnd):
    words = lambda n: " ".join("".join(rnd.choices("etaoinshr", k=rnd.randint(1, 9))) for _ in range(n))
    texts = [t or "" for t in ODD] + [words(n) for n in (3, 20, 61, 62, 400)] + [words(30) + " " + "Ab3-_" * 9 + "== é" + words(40), "a" * 308, "b" * 307]
    got = {r["doc_id"]: r["o"] for r in docs_of(texts).select("doc_id", secret_scan.all_ordinary(F.col("text")).alias("o")).collect()}
    for i, t in enumerate(texts):
        want = strings(t)
        assert [(o["class"], o["step"]) for o in got[i]] == [(size_class(len(s)), plain_step(s)) for s in want]
    assert sum(len(got[i]) for i in range(len(ODD), len(texts))) > 40


@pytest.fixture()
def texts(rnd):
    """Ordinary text that looks even stands in the last part of the texts alone, which one string a text may miss."""
    even = lambda n: " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n))
    dull = lambda n: " ".join("".join(rnd.choices("et", k=8)) for _ in range(n))
    return [dull(300) + " " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=24)) + " " + (even(40) if i % 2 else dull(40)) for i in range(300)]


def test_query_and_stage_count_all_text(spark, texts, tmp_path):
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = all_random(texts)
    got = queries.queries()["op6_secret_scan"](spark, str(tmp_path)).collect()
    spans = {(r["doc_id"], *map(int, s.split(":")[1:])) for r in got for s in r["spans"].split(",") if s.startswith("random")}
    assert spans == want
    sampled = secret_scan.scan_secrets(spark.read.parquet(str(tmp_path / "documents.parquet"))).select("doc_id", F.explode("spans").alias("s")).where("s.kind = 'random'")
    assert {(r["doc_id"], r["s"]["start"], r["s"]["end"]) for r in sampled.collect()} != want
    clean = corpus_pipeline.redact_secrets(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    marked = {r["doc_id"] for r in clean.collect() if "[SECRET]" in r["text"]}
    assert marked == {i for i, *_ in want} | {i for i, t in enumerate(texts) if base_spans(t)}
