"""Every query with SQL against DuckDB over the smallest tables."""

import os

import duckdb
import pytest

from corpuscle.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(([cell(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.SQL:
        assert got
        return
    cur = duck.execute(catalogue.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(cur.fetchall(), names)


def test_whole_texts_are_translated(spark):
    want = {str(r.doc_id): r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = catalogue.QUERIES["hook_translate_judge"](spark, SF).collect()
    assert len(got) == 3 * len(want) and max(map(len, want.values())) > 40
    assert all(r.text.split(":", 2)[2] == want[r.unit_id] for r in got)


def test_whole_paragraphs_are_cleaned(spark, tmp_path):
    import re

    ends = ["", "#" * 3, "#" * 10, "#" * 11, "### $$$$ and %%%%", "x" * 500 + "*" * 9, "x" * 500 + "&" * 40]
    paras = ["é" * 70 + x + " end." for x in ends] + ["#" * 9 + " short.", "$" * 12]
    spark.createDataFrame([(k, t) for k, t in enumerate(paras)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.cleaned for r in catalogue.QUERIES["clean_not_rewrite"](spark, str(tmp_path)).collect()}
    # Noise is only taken out, so that the edits are as many as the characters that go.
    assert got == {k: len(t) - len(re.sub(r"[#$%&*]{3,}", "", t)) <= 10 for k, t in enumerate(paras)} and set(got.values()) == {True, False}


def test_gold_similarity_tells_letters_apart(spark, tmp_path):
    gold = "la élève è là où ñ東京 the hall of bronze"
    texts = [gold, f"x {gold}éé", f"{gold} and more than ten characters", f"y {gold}ab. {gold}", "none"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, gold)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r.similarity for r in catalogue.QUERIES["gold_similarity"](spark, str(tmp_path)).collect()}
    n = len(gold)
    # What is held begins with the gold text, so all edits are the characters behind it.
    tail = {0: 0, 1: 2, 2: 10, 3: 10}
    assert got.keys() == tail.keys() and all(abs(got[k] - (1 - t / (n + t))) < 1e-12 for k, t in tail.items())
