"""The split reader against Spark's own reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpuscle import schema
from corpuscle.sources import corpus_json, readers

ODD = ["a}b", '{"x": [1]}', "\\", '\\"', '"', "}]}", "\n", "é東👩", '"alignment_units": [{', "", "\\u007d ]", "[{", " ,{"]


@pytest.fixture()
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "10"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def unit(rng, i):
    src = {"museum": rng.choice(ODD), "image": "x}", "title_zh": rng.choice(ODD), "title_en": None}
    return {"id": f"u{i}", "source": src, "translations": {k: rng.choice(ODD) * rng.randrange(4) for k in ("zh", "en")} if i % 7 else {}}


def whole(spark, path):
    rows = spark.read.schema(schema.CORPUS).json(path, multiLine=True)
    return rows.select("corpus_id", "version", F.to_date("created").alias("created"), "languages", F.inline("alignment_units"))


HEAD = {"corpus_id": "c{", "name": 'n"}', "version": "1.0", "created": "2026-02-20", "languages": ["zh", "en"]}


@pytest.mark.parametrize("n,how,end", [(0, {}, ""), (1, {"indent": 2}, "\n"), (40, {}, ""), (40, {"indent": 2}, "\n"), (40, {"ensure_ascii": False, "indent": 1}, ""), (40, {"separators": (",", ":")}, "\n")])
def test_equals_the_reader_of_whole_files(spark, small_splits, tmp_path, n, how, end):
    rng = random.Random(n)
    units = [unit(rng, i) for i in range(n)]
    if len(end):
        doc = {"notes": [{"a": 1}, {"b": [2]}], "m": {"k": "]"}, "alignment_units": units, **HEAD}
    else:
        doc = {**HEAD, "alignment_units": units, "notes": [{"a": 1}, {"b": []}]}
    path = str(tmp_path / "doc.json")
    with open(path, "w") as f:
        f.write(json.dumps(doc, **how) + end)
    got = readers.corpus(spark, path)
    assert got.schema == whole(spark, path).schema
    assert sorted(map(str, got.collect())) == sorted(map(str, whole(spark, path).collect()))
    if n == 40:
        assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5


def test_several_documents(spark, small_splits, tmp_path):
    rng = random.Random(3)
    for k in range(3):
        with open(tmp_path / f"{k}.json", "w") as f:
            json.dump({**HEAD, "corpus_id": f"c{k}", "alignment_units": [unit(rng, i) for i in range(5 * k)]}, f)
    got = readers.corpus(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, whole(spark, str(tmp_path)).collect()))
    assert {r.corpus_id: r["count"] for r in got.groupBy("corpus_id").count().collect()} == {"c1": 5, "c2": 10}


@pytest.mark.parametrize("n", [0, 30])
def test_written_in_parts_and_read_back(spark, small_splits, tmp_path, n):
    rng = random.Random(n)
    rows = [(u["id"], tuple(u["source"].values()), u["translations"]) for u in (unit(rng, i % 20) for i in range(n))]
    df = spark.createDataFrame(rows, "id string, source struct<museum:string,image:string,title_zh:string,title_en:string>, translations map<string,string>").repartition(4)
    path = str(tmp_path / "parts")
    corpus_json.write(df, path, "c", "name", "2.0", "2026-03-01", ("zh", "en"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    assert len(json.loads(text)["alignment_units"]) == n
    got = readers.corpus(spark, path, parts=True)
    plain = lambda r: (r.id, tuple(r.source), sorted((r.translations or {}).items()))
    assert sorted(map(plain, got.collect()), key=repr) == sorted(map(plain, df.collect()), key=repr)
    assert all(r.created.isoformat() == "2026-03-01" and r.languages == ["zh", "en"] for r in got.collect())


def test_no_join_sends_a_document_to_one_task(spark, tmp_path):
    rows = [(str(i), (None, "x", None, None), {"zh": "a"}) for i in range(50)]
    df = spark.createDataFrame(rows, "id string, source struct<museum:string,image:string,title_zh:string,title_en:string>, translations map<string,string>")
    path = str(tmp_path / "parts")
    corpus_json.write(df, path, "c", "name", "2.0", "2026-03-01", ("zh",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = readers.corpus(spark, path, parts=True)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        assert got.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_quotes_and_brackets_of_a_piece_are_counted_over(spark):
    """What a piece does to the reader's state, by one pass over its text, against a reader of one character at a time."""
    rng = random.Random(8)
    chars = ['"', '"', "{", "[", "]", '\\"', "\\\\", "\\n", "\n", "a" * 9, "é東👩", ", ", "\r\n"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(30))) for _ in range(400)] + ["", '"', "\\", 'x\n"', '"\n', "x" * 100_000]

    def read(text, inside):
        depth, k = 0, 0
        while k < len(text):
            if text[k] == "\\":
                k += 1
            elif text[k] == '"':
                inside = not inside
            elif not inside:
                depth += (text[k] in "{[") - (text[k] == "]")
            k += 1
        return depth

    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("m", corpus_json._marks(F.col("t")))
    depth = lambda inside: corpus_json._depth(corpus_json._outside(F.col("m"), inside))
    rows = df.select("t", "m", depth(False).alias("out"), depth(True).alias("in"), corpus_json._count(F.col("m"), '"').alias("q")).collect()
    for r in rows:
        bare = r.t.replace("\\\\", "").replace('\\"', "")
        assert r.m.rstrip("\\") == "".join(c for c in bare if c in '"{[]')
        assert (r["out"], r["in"], r.q) == (read(r.t, False), read(r.t, True), bare.count('"'))
