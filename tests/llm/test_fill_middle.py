import hashlib
import re

import duckdb

from pagelens.llm import fill_middle as fm
from pagelens.llm import queries

from .conftest import ODD

TEXTS = [*ODD, "a\nb\nc", "a\nb\nc\n", "\n", "\n\n\n", "has <S> inside\nso", "<P>", "é\r\n漢\n😀\n\nend", "<\n<P\nS>\n", "line\n" * 50_000]


def plain_rule(doc_id, text):
    """The rule stated line by line."""
    lines, n = re.findall(r"[^\n]*\n|[^\n]+", text), len(re.findall(r"[^\n]*\n|[^\n]+", text))
    x = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(x[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_against_the_rule(spark, docs_of, rnd):
    texts = TEXTS + ["".join(rnd.choices("ab\né<", k=rnd.randint(0, 40))) for _ in range(200)]
    d = docs_of(texts).withColumnRenamed("score", "FIM")
    rows = fm.fill_in_middle(d)
    assert rows.columns == [*d.columns[:-1], "fim"]
    got = {r["doc_id"]: r for r in rows.withColumn("back", fm.restored(rows["fim.output"], rows["fim.form"])).collect()}
    assert len(got) == len(texts) and {r["fim"]["form"] for r in got.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        assert tuple(got[i]["fim"]) == plain_rule(i, t or "") and got[i]["back"] == (t or "")


def test_rates_ids_and_empty_tables(spark, docs_of):
    d = docs_of(["a\nb\n"] * 400)
    forms = [r["fim"]["form"] for r in fm.fill_in_middle(d, rate=40, spm_rate=0).collect()]
    assert set(forms) == {"plain", "psm"} and 100 < forms.count("psm") < 220
    same = spark.createDataFrame([(None, "a\nb", 1), (None, "a\nb", 1), ("x", None, 1)], "doc_id string, text string, draws int")
    rows = fm.fill_in_middle(same).collect()
    assert rows[0]["fim"] == rows[1]["fim"] and rows[0]["draws"] == 1 and rows[2]["fim"]["form"] == "plain" and rows[2]["fim"]["n"] == 0
    assert fm.digest(fm.fill_in_middle(docs_of([]))).count() == 0


def test_a_text_of_very_many_lines(spark, docs_of):
    row = fm.digest(fm.fill_in_middle(docs_of(["x\n" * 2_000_000]))).first()
    assert row["n"] == 2_000_000 and row["restored_sha256"] == hashlib.sha256(b"x\n" * 2_000_000).hexdigest()


def test_sql(spark, tmp_path, docs_of):
    docs_of(TEXTS).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(fm.SQL.replace("FROM documents", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")).df()
    got = queries.op12_fill_in_middle(spark, str(tmp_path)).toPandas()[list(want.columns)]
    a, b = (x.sort_values("doc_id").reset_index(drop=True).astype(object).where(lambda v: v.notna(), None).values.tolist() for x in (got, want))
    assert a == b
