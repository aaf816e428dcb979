import gzip
import json
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from corpuscle.functions import ids, scripts
from corpuscle.functions import text as X
from corpuscle.operators import align, coverage, grading, hooks, reference, repair, segment, select, units
from corpuscle.plans.build import build
from corpuscle.session import materialise, scratch_root
from corpuscle.sources import readers, writers
from corpuscle.streaming import incremental

LANGS = ("zh", "en", "ja", "es", "bg")


def one(df):
    return df.collect()[0]


def test_published_coverage(spark):
    """2,678 units with 371, 323, 50, 59 and 20 gaps, dealt round over 719 units: 1,959 are complete."""
    gaps = [x for x, n in zip(LANGS, (371, 323, 50, 59, 20)) for _ in range(n)]
    lost = {(k % 719, x) for k, x in enumerate(gaps)}
    assert len(lost) == 823
    blank = [None, "", " ", "\t", "　", " "]
    rows = [(u, x, blank[(u + len(x)) % 6] if (u, x) in lost else "t") for u in range(2678) for x in LANGS]
    df = spark.createDataFrame(rows, "unit long, lang string, text string")
    got = {r.lang: (r.completed, r.missing, round(r.coverage, 1)) for r in coverage.by_language(df, "unit", LANGS).collect()}
    assert got == {"zh": (2307, 371, 86.1), "en": (2355, 323, 87.9), "ja": (2628, 50, 98.1), "es": (2619, 59, 97.8), "bg": (2658, 20, 99.3)}
    assert coverage.unit_languages(df, "unit", LANGS).where("complete").count() == 1959


def test_nonblank(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("\t",), ("　",), (" ",), ("x",), ("中",)], "t string")
    assert [r[0] for r in df.select(X.nonblank(F.col("t"))).collect()] == [False] * 6 + [True] * 2


@pytest.mark.parametrize("museum,p,s", [("a", 0, 0), ("a_b_c", 12, 34), ("某馆_北", 1, 10)])
def test_ids(spark, museum, p, s):
    df = spark.createDataFrame([(museum, "IMG1", p, s)], "m string, i string, p int, s int")
    row = one(df.select(ids.parse_id(ids.compose_id(F.col("m"), F.col("i"), F.col("p"), F.col("s"))).alias("x")).select("x.*"))
    assert tuple(row) == (museum, "IMG1", p, s)
    assert one(spark.createDataFrame([("nonsense",)], "t string").select(ids.parse_id(F.col("t")).alias("x"))).x.p is None


def test_sentences(spark):
    cases = {"No end": ["No end"], "A. B!? C": ["A.", "B!?", "C"], "他说。“好！”走。": ["他说。", "“好！”", "走。"], "": [], None: [], "e.g. x": ["e.g.", "x"]}
    for text, want in cases.items():
        assert one(spark.createDataFrame([(text,)], "t string").select(X.sentences(F.col("t")))).asDict().popitem()[1] == want


def test_detect_language(spark):
    cases = {"漢字": "zh", "かな漢字": "ja", "abc": "en", "абв": "bg", "123 😀": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(scripts.detect_language(F.col("t"))).collect()] == list(cases.values())


def test_grades(spark):
    rows = [(0.8, None, "B"), (0.9, False, "B"), (0.7999, None, "C"), (0.95, None, "U"), (None, None, "U"), (0.1, True, "A")]
    df = spark.createDataFrame(rows, "c double, r boolean, want string")
    assert [r[0] for r in df.select(grading.grade(F.col("c"), F.col("r")) == F.col("want")).collect()] == [True] * 6


def test_board_flags_overlap(spark):
    rows = [("b", "长" * 10, "x" * 20), ("b", "长", None), ("b", "长" * 10, "x"), ("p", "a", "b")]
    flags = grading.board_flags(grading.pair_flags(spark.createDataFrame(rows, "k string, a string, b string"), "a", "b"), "k")
    assert {r.k: tuple(r)[1:] for r in flags.collect()} == {"b": (False, True, True), "p": (True, False, False)}


def test_review_overlay_latest(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "item string, text string")
    reviews = spark.createDataFrame([("a", "confirm", None, 1), ("a", "skip", None, 2), ("b", "skip", None, 1), ("b", "correct", "Y", 2)], "item string, action string, corrected_text string, at int")
    last = grading.latest(reviews, "item", F.col("at"))
    assert {r.item: r.final for r in grading.review_overlay(items, last, "item").collect()} == {"b": "Y", "c": "z"}


def test_judge_ties_and_single(spark):
    rows = [("u", 1, 0.5, "m1"), ("u", 2, 0.5, "m2"), ("v", 3, None, "m1"), ("v", 4, 0.1, "m2"), ("w", 5, None, "m1")]
    got = select.judge(spark.createDataFrame(rows, "unit string, id int, score double, model string"), ["unit"], "score", "id", "model")
    assert {r.unit: (r.id, r.model) for r in got.collect()} == {"u": (1, "m1"), "v": (4, "m2"), "w": (5, "m1")}


def test_repair_and_resume(spark):
    rows = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, None)], "id int, text string")
    fixes = spark.createDataFrame([(1, "rule", "r"), (2, "rule", "r"), (2, "model", "m"), (3, "model", "m")], "id int, method string, text string")
    assert {r.id: (r.final, r.method) for r in repair.fill(rows, fixes, ["id"]).collect()} == {1: ("a", "original"), 2: ("r", "rule"), 3: ("m", "model"), 4: (None, "none")}
    assert repair.pending(rows, rows, "id").count() == 0
    assert repair.pending(rows, rows.limit(0), "id").count() == 4


def test_nest_round_trip(spark):
    rows = [(d, p, s, f"{d}{p}{s}") for d in (1, 2) for p in range(11) for s in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, p int, s int, sentence string").repartition(3)
    assert sorted(tuple(r) for r in segment.flatten(segment.nest(df, "doc_id"), "doc_id").collect()) == sorted(rows)


def test_board_records(spark, tmp_path):
    board = {"board_title": {"zh": "t", "en": "T"}, "corrections": {"zh_changes": ["a"], "en_changes": []}, "paragraphs": [{"zh": "甲。乙。", "en": "A. B.", "sentences": [{"zh": "甲。", "en": "A."}, {"zh": "乙。", "en": "B."}]}]}
    (tmp_path / "b.json").write_text(json.dumps(board))
    boards = readers.boards(spark, str(tmp_path / "b.json")).withColumn("k", F.lit(1))
    flat = segment.flatten_boards(boards, "k")
    assert [tuple(r) for r in flat.sort("s").collect()] == [(1, 0, 0, "甲。", "A."), (1, 0, 1, "乙。", "B.")]
    assert one(segment.nest_boards(flat, "k")).paragraphs == one(boards).paragraphs


def test_glossary_and_corpus_json(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"glossary": [{"zh": "甲", "en": "a", "ja": "あ", "es": "e", "bg": "б"}]}))
    assert tuple(one(readers.glossary(spark, str(tmp_path / "g.json")))) == ("甲", "a", "あ", "e", "б")
    unit = {"id": "m_I_p0s0", "source": {"museum": "m", "image": "I.jpg", "title_zh": "", "title_en": ""}, "translations": {"zh": "甲", "en": "A"}}
    src = {"corpus_id": "c", "name": "n", "version": "1.0", "created": "2026-01-02", "languages": ["zh", "en"], "alignment_units": [unit]}
    (tmp_path / "c.json").write_text(json.dumps(src, ensure_ascii=False, indent=1))
    rows = readers.corpus(spark, str(tmp_path / "c.json"))
    assert one(rows).translations == unit["translations"]
    writers.root_json(units.root_document(rows.select("id", "source", "translations"), "c", "n", "1.0", "2026-01-02", ["zh", "en"]), str(tmp_path / "out"))
    back = json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part-*")))
    assert back == src


def test_tmx_escapes_and_single_language(spark, tmp_path):
    rows = [("1", "zh", 'a & <b> "c"'), ("1", "en", "x"), ("2", "zh", "only"), ("3", "zh", " ")]
    df = spark.createDataFrame(rows, "id string, lang string, text string")
    writers.tmx(df, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in readers.tmx(spark, str(tmp_path / "t")).collect()) == sorted(rows[:3])
    writers.tmx_document(df, str(tmp_path / "d"))
    assert sorted(tuple(r) for r in readers.tmx(spark, str(tmp_path / "d")).collect()) == sorted(rows[:3])


def test_gold_containment_partial_words(spark):
    docs = spark.createDataFrame([(1, "xx one two three four five sixes yy"), (2, "short gold"), (3, None)], "doc_id int, text string")
    gold = spark.createDataFrame([(7, "x one two three four five six"), (8, "ort go"), (9, "one three two four five six"), (10, None)], "item_id int, text string")
    assert {tuple(r) for r in reference.gold_containment(docs, gold, "doc_id", "item_id").collect()} == {(1, 7), (2, 8)}


def test_nearest_in_blocks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "k long, v array<double>")
    got = {r.k: r.nearest for r in reference.nearest(rows.where("k % 3 = 0"), rows, "k", "v", block=7).collect()}
    vec = {i: (i % 7, i % 5, 1) for i in range(60)}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b]))
    assert got == {i: min((j for j in vec if j != i), key=lambda j: (-dot(i, j), j)) for i in range(0, 60, 3)}


def test_evidence_disagreement(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, a string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (3, None)], "k int, b string")
    assert {r.k: r.agree for r in align.evidence(a, b, "k", "a", "b").collect()} == {1: True, 2: False, 3: True}


def test_resumable_stream(spark, tmp_path):
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    fields = "item string"
    for names in (["a", "b"], ["c"], []):
        if names:
            spark.createDataFrame([(n,) for n in names], fields).coalesce(1).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, fields)
        incremental.run_available(stream, incremental.once_per_batch(out), ck)
    assert sorted(r.item for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_watermarked_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2026-01-01 00:10:00' + make_interval(0,0,0,0,0,id,0) AS ts, 'x' AS k FROM range(10)").write.parquet(source)
    stream = incremental.file_stream(spark, source, spark.read.parquet(source).schema)
    incremental.windowed_counts(stream, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert one(spark.sql("SELECT sum(n) AS n FROM w")).n == 10


def test_enhance_reports_rewrites(spark):
    boards = spark.createDataFrame([("b", "甲。乙。", "A. B.")], "board string, zh string, en string")
    assert [(r.s, r.zh, r.en, r.kept) for r in hooks.enhance(boards).sort("s").collect()] == [(0, "甲。", "A.", True), (1, "乙。", "B.", True)]

    def rewriting(batch):
        out = hooks.stub_enhance(batch)
        out["zh_parts"] = [["改写。"] for _ in range(len(out))]
        return out

    assert not any(r.kept for r in hooks.enhance(boards, rewriting).collect())


def test_build_all_stages(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    for k, text in enumerate(("甲乙。丙丁。", "戊。")):
        (folder / f"IMG{k}.jpg").write_text(text)
    (folder / "bad.jpg").write_bytes(b"\xff\xfe")
    images = readers.images(spark, str(folder))
    result = build(spark, images, lambda c: F.lit("馆"), str(tmp_path / "out"))
    rows = {r.id: r.translations for r in result.collect()}
    assert set(rows) == {"馆_IMG0_p0s0", "馆_IMG0_p0s1", "馆_IMG1_p0s0"}
    assert all({"zh", "ja", "es", "bg"} <= set(t) for t in rows.values())
    done = readers.progress(spark, str(tmp_path / "out" / "progress")).select(F.col("item").alias("image"))
    assert build(spark, images, lambda c: F.lit("馆"), str(tmp_path / "again"), done=done).count() == 0


def test_build_leaves_no_stage_tables(spark, tmp_path):
    """Only the units stay beside the exports, which are packed; lines of all languages are in the same order."""
    root = pathlib.Path(scratch_root(spark).removeprefix("file:")) / "corpuscle"
    before = {p.name for p in root.glob("stage-*")}
    rows = [(f"I{k}.jpg", f"甲{k}。乙。".encode()) for k in range(40)]
    images = spark.createDataFrame(rows, "path string, content binary").repartition(3)
    result = build(spark, images, lambda c: F.lit("m"), str(tmp_path / "out"))
    assert [p.rsplit("-", 1)[0] for p in {p.name for p in root.glob("stage-*")} - before] == ["stage-units"]
    units_ = {r.id: r.translations for r in result.collect()}
    assert len(units_) == 80
    out = tmp_path / "out"
    for kind in ("graded", "json", "text", "tmx"):
        files = [p for p in (out / kind).rglob("part-*")]
        assert files and all(p.name.endswith(".gz") for p in files)
    assert {r.id: r.translations for r in spark.read.schema("id string, translations map<string,string>").json(str(out / "json")).collect()} == units_
    lines = {x: "".join(gzip.decompress(p.read_bytes()).decode() for p in sorted((out / "text" / x).glob("part-*"))).splitlines() for x in ("zh", "en", "ja", "es", "bg")}
    want = [units_[k] for k in sorted(units_)]
    assert lines == {x: [u.get(x, "") for u in want] for x in lines}
    assert {(r.id, r.lang): r.text for r in readers.tmx(spark, str(out / "tmx")).collect()} == {(k, x): t for k, u in units_.items() for x, t in u.items()}
    assert {r.item for r in readers.progress(spark, str(out / "progress")).collect()} == {r[0] for r in rows}


def test_build_writes_texts_once(spark, tmp_path, monkeypatch):
    """Exports apart, no more than three stage tables, and of texts one shuffle; translations are in no table but the units."""
    from corpuscle.plans import build as module

    tables, root = [], pathlib.Path(scratch_root(spark).removeprefix("file:")) / "corpuscle"
    before = set(root.glob("stage-*"))

    def seen(df, label, *rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        tables.append((label, plan.count("Exchange "), {p.name.rsplit("-", 1)[0] for p in set(root.glob("stage-*")) - before}))
        return materialise(df, label, *rest)

    monkeypatch.setattr(module, "materialise", seen)
    images = spark.createDataFrame([(f"I{k}.jpg", f"甲{k}。乙。\n丙。".encode()) for k in range(40)], "path string, content binary").repartition(3).localCheckpoint()
    result = build(spark, images, lambda c: F.lit("m"), str(tmp_path / "out"), keep=False)
    assert tables[:3] == [("stage-ocr", 0, set()), ("stage-enhance", 0, {"stage-ocr"}), ("stage-units", 1, {"stage-enhance"})]
    assert not set(root.glob("stage-*")) - before
    rows = result.collect()
    assert len(rows) == 120 and result.columns == ["id", "source", "translations", "grade"]
    assert {r.id for r in rows} == {f"m_I{k}_p{p}s{s}" for k in range(40) for p, s in ((0, 0), (0, 1), (1, 0))}
    assert all(r.translations.keys() == {"zh", "ja", "es", "bg"} and r.translations["ja"].endswith(":" + r.translations["zh"]) for r in rows)
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == 120


def test_offers_across_batches(spark):
    """Candidates of a unit_id that stands in several rows and batches are folded; what judge() takes of all is taken."""
    score = {"a": 0.5, "b": 0.5, "c": None, "d": float("nan"), "e": 0.4}

    def provider(batch):
        out = batch[batch["text"] != "none"].assign(score=[score[t[-1]] for t in batch["text"] if t != "none"])
        return out.assign(text=out["lang"] + out["model"] + out["text"])

    rows = [(f"u{k:03}", f"t{'abcde'[k % 5]}", k) for k in range(60)] + [("u007", f"{j}{'dcea'[j % 4]}", 100 + j) for j in range(50)] + [("u059", "9e", 200), ("u100", "none", 300)]
    units = spark.createDataFrame(rows, "unit_id string, text string, k int")
    near = units.repartitionByRange(3, "unit_id").sortWithinPartitions("unit_id")
    ours = hooks.offers(near, ("ja", "es"), ("m1", "m2", "m3"), provider)
    judged = hooks.offers(near, ("ja", "es"), ("m1", "m2", "m3"), lambda b: provider(b).assign(score=0.0), lambda b: b.assign(score=[score[t[-1]] for t in b["text"]]))
    every = hooks.translate(units, ("ja", "es"), ("m1", "m2", "m3"), provider).collect()
    best = {}
    for r in every:
        if r.score is not None and r.score == r.score:
            best[r.unit_id, r.lang] = max(best.get((r.unit_id, r.lang), 0), r.score)
    models = {r.lang: r.model for r in hooks.judge(hooks.translate(units.where("unit_id = 'u000'"), ("ja", "es"), ("m1", "m2", "m3"), provider)).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 4, 2000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
        try:
            for x in (ours, judged):
                got = x.withColumn("first", hooks.first_offers(F.col("offers"))).collect()
                assert sorted((r.unit_id, r.k) for r in got) == sorted((u, k) for u, _, k in rows)
                for r in got:
                    assert [f.lang for f in r.first] == ([] if r.unit_id == "u100" else ["es", "ja"])
                    for f in r.first:
                        assert f.text.startswith(f.lang + models[f.lang])
                        assert (r.unit_id, f.lang) not in best or score[f.text[-1]] == best[r.unit_id, f.lang]
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_build_shared_ids_and_repairs(spark, tmp_path):
    """Images of one name in two folders share unit ids; a repair fills what is blank."""
    images = spark.createDataFrame([("x/I.jpg", "甲。".encode()), ("y/I.jpg", "乙。".encode()), ("y/J.jpg", "丙。".encode())], "path string, content binary")
    museum = lambda c: F.lit("m")
    blank = lambda b: hooks.stub_translate(b).assign(text=[" " if x == "es" else t for x, t in zip(b["lang"], b["text"])])
    rows = build(spark, images, museum, str(tmp_path / "a"), providers={"translate": blank}).collect()
    first = min("甲。", "乙。")
    assert sorted((r.id, r.translations["zh"], sorted(r.translations)) for r in rows) == [("m_I_p0s0", first, ["bg", "ja", "zh"])] * 2 + [("m_J_p0s0", "丙。", ["bg", "ja", "zh"])]
    assert len({str(r.translations) for r in rows}) == 2
    fixes = spark.createDataFrame([("m_J_p0s0", "es", "model", "x"), ("m_J_p0s0", "es", "rule", "y"), ("m_J_p0s0", "ja", "rule", "z"), ("m_I_p0s0", "en", "model", "w")], "unit_id string, lang string, method string, text string")
    fixed = build(spark, images, museum, str(tmp_path / "b"), repairs=fixes, providers={"translate": blank}).collect()
    plain = {r.id: r.translations for r in rows}
    assert {r.id: r.translations for r in fixed} == {"m_J_p0s0": plain["m_J_p0s0"] | {"es": "y"}, "m_I_p0s0": plain["m_I_p0s0"] | {"en": "w"}}
    assert len(fixed) == 3


def test_corrections_and_offsets(spark):
    from corpuscle import schema

    rows = [(("t", "T"), (["a", "b"], []), []), (None, None, [])]
    got = grading.corrections_count(spark.createDataFrame(rows, schema.BOARD)).select("n_zh_changes", "n_en_changes").collect()
    assert sorted(tuple(r) for r in got) == [(0, 0), (2, 0)]
    assert one(spark.sql("SELECT 61.5D AS s").select(X.offset(F.col("s")).alias("x"))).x.total_seconds() == 61.5


def test_half_width_and_changes(spark):
    df = spark.createDataFrame([("ＡＢ１　ｘ", [("B", "C"), ("", "zz"), ("C1", None)])], "t string, c array<struct<before:string,after:string>>")
    assert one(df.select(X.half_width(F.col("t")).alias("x"))).x == "AB1 x"
    assert one(df.select(X.apply_changes(X.half_width(F.col("t")), F.col("c")).alias("x"))).x == "A x"


def test_glossary_and_speech(spark):
    docs = spark.createDataFrame([(1, "a bronze vase"), (2, None), (3, "100% b_x")], "k int, text string")
    assert {tuple(r) for r in reference.glossary_hits(docs, ["bronze", "%", "_"], "k").collect()} == {(1, "bronze"), (3, "%"), (3, "_")}
    units_ = spark.createDataFrame([("es", 0), ("es", 1), ("bg", 0)], "lang string, ordinal int")
    seg = spark.createDataFrame([("es", 0, 0.0, 1.5), ("bg", 0, 3.0, 2.0)], "lang string, ordinal int, start_s double, end_s double")
    assert {(r.lang, r.n, r.aligned, r.rate) for r in coverage.alignment_rate(align.speech(units_, seg), "lang", "aligned").collect()} == {("es", 2, 1, 50.0), ("bg", 1, 0, 0.0)}


def test_judge_win_rates_and_self_preference(spark):
    rows = [("u", 1, 0.9, "a"), ("u", 2, 0.1, "b"), ("v", 1, 0.2, "a"), ("v", 2, 0.3, "b")]
    df = spark.createDataFrame(rows, "unit string, id int, score double, model string")
    won = select.judge(df, ["unit"], "score", "id", "model")
    assert {r.model: (r.n, r.wins) for r in select.win_rates(df, won, ["unit"], "model", "id").collect()} == {"a": (2, 1), "b": (2, 1)}
    judged = won.withColumns({"lang": F.lit("ja"), "judge": F.lit("a")})
    assert tuple(one(select.self_preference(judged, "lang", "model", "judge"))) == ("ja", 2, 1)


def test_sessions_stream_and_merge(spark):
    rows = spark.sql("SELECT 'u' AS k, timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) AS ts FROM VALUES (0), (10), (45), (100) AS v(m)")
    assert sorted(r.n for r in incremental.sessions(rows, "ts", "k").collect()) == [1, 1, 2]
    parts = spark.createDataFrame([("a", 2, "x", None), ("a", 1, None, "p"), ("a", 3, "y", "q")], "k string, o int, f string, g string")
    assert tuple(one(repair.merge_partial(parts, "k", "o"))) == ("a", "x", "p")


def test_scratch(spark):
    from corpuscle import session

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        session.scratch_root(Cluster)
    table = session.materialise(spark.range(5), "numbers")
    path = table._corpuscle_path.removeprefix("file:")
    assert table.count() == 5 and path.startswith(session.scratch_root(spark).removeprefix("file:")) and os.path.isdir(path)
    session.discard(table)
    assert not os.path.exists(path)


def test_glossary_and_gold_of_any_length(spark):
    texts = ["", None, "a", "ab", "the bronze vase of the old king is here", "bronze", "甲乙丙丁戊", "x bronze  vase"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, texts[4])], "k int, text string")
    terms = ["a", "b", "甲乙", "bronze", "bronze vase", "", None, "vase of the old king is", "bronze vase of the old king is here"]
    glossary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "zh string, i int")
    got = {(r.k, r.i) for r in reference.glossary_lookup(docs, glossary, "k", "zh").collect()}
    assert got == {(k, i) for k, t in enumerate(texts) for i, g in enumerate(terms) if t and g and g in t}
    gold = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "i int, text string")
    got = [(r.k, r.i) for r in reference.gold_containment(docs, gold, "k", "i").collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, i) for k, t in enumerate(texts) for i, g in enumerate(terms) if t is not None and g is not None and g in t}


def test_nearest_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [5.0, 5.0, 5.0]), (5, None), (6, []), (7, [None, 1.0]), (8, [float("nan"), 1.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    for block in (1, 2048):
        assert {tuple(r) for r in reference.nearest(df, df, "k", "v", block).collect()} == {(1, 2, 2.0), (2, 1, 2.0), (3, 4, 5.0), (4, 3, 5.0)}


def test_verdicts_repairs_and_late_rows(spark, tmp_path):
    rows = [("u", 1, 0.9, "a"), ("u", 2, 0.1, "b"), ("v", 1, 0.2, "a"), ("v", 2, 0.3, "b"), ("w", 1, None, "a")]
    df = spark.createDataFrame(rows, "unit string, id int, score double, model string")
    verdicts = spark.createDataFrame([("u", 2), ("u", 2), ("v", 9), ("x", 1)], "unit string, id int")
    got = {r.unit: (r.id, r.model, r.n_candidates, r.judged) for r in select.judge_by_verdicts(df, verdicts, ["unit"], "id", "score", "model").collect()}
    assert got == {"u": (2, "b", 2, True), "v": (2, "b", 2, False), "w": (1, "a", 1, False)}
    gaps = spark.createDataFrame([("1", "ja", "x"), ("2", "es", None)], "unit_id string, lang string, source string")
    assert {tuple(r) for r in hooks.repair(gaps).collect()} == {("1", "ja", "model", "ja:x"), ("2", "es", "model", "es:")}
    limited = hooks.repair(gaps, lambda b: hooks.stub_repair(b).assign(text="t"), workers=1)
    assert {r.text for r in limited.collect()} == {"t"} and limited.rdd.getNumPartitions() == 1
    assert one(spark.range(1).select(units.complete(F.create_map(F.lit("ja"), F.lit("x")), ("ja",)).alias("x"))).x


def test_readers_of_documents_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"image": "i1", "museum": "m", "text": "t\nu", "confidence": 0.5}, {"image": "i2"}], indent=1))
    assert {(r.image, r.text, r.confidence) for r in readers.ocr_results(spark, str(tmp_path / "a.json")).collect()} == {("i1", "t\nu", 0.5), ("i2", None, None)}
    (tmp_path / "b.json").write_text('{"item": "x", "action": "confirm"}\n{"item": "y", "action": "skip", "reviewed_at": "2026-01-01T10:00:00"}\n')
    assert sorted((r.item, r.action, r.reviewed_at is None) for r in readers.reviews(spark, str(tmp_path / "b.json")).collect()) == [("x", "confirm", True), ("y", "skip", False)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.mp3").write_bytes(b"one\ntwo")
    (tmp_path / "s" / "a.txt").write_bytes(b"no")
    assert sorted((r.ordinal, r.text) for r in hooks.transcribe(readers.audio(spark, str(tmp_path / "s"))).collect()) == [(0, "one"), (1, "two")]


def test_batches_of_long_texts_are_small(spark):
    """A provider gets long texts in batches of some MB, not 2,000 at once."""
    rows = spark.range(0, 400, 1, 1).select(F.col("id").cast("string").alias("unit_id"), F.repeat(F.lit("x"), 100_000).alias("source"), F.lit("zh").alias("lang"))

    def sizes(batch):
        return hooks.stub_repair(batch).assign(text=str(int(batch["source"].str.len().sum())))

    got = hooks.repair(rows, sizes).select("unit_id", F.col("text").cast("long").alias("n")).collect()
    assert len(got) == 400 and max(r.n for r in got) <= 10_000_000


def test_candidates_are_folded_where_they_are_made(spark):
    """The same choices and counts as from all candidates, and no sort of whole texts before the shuffle."""
    def provider(batch):
        out = hooks.stub_translate(batch)
        k = batch["unit_id"].astype(int)
        out["score"] = [[None, 0.5, float("-inf"), s][i % 4] for i, s in zip(k, out["score"])]
        out.loc[(k % 4 == 2) & (batch["model"] == "m1"), "score"] = None
        return out

    # Units in many batches and twice in the table, with and without text.
    units = spark.createDataFrame([(str(i % 90), None if i % 11 == 0 else f"text {i}") for i in range(120)], "unit_id string, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        every = hooks.translate(units, ("ja", "es"), ("m1", "m2", "m3"), provider)
        want, some = hooks.judge(every).collect(), hooks.translate(units, ("ja", "es"), ("m1", "m2", "m3"), provider, fold=True)
        for got in (hooks.judge(some), hooks.judge(every, lambda batch: batch)):
            # Of a unit that is there twice and whose scores are equal, either text may stand.
            plain = lambda rows: sorted((r.unit_id, r.lang, r.score, r.model, r.text if int(r.unit_id) >= 30 else "", r.n_candidates) for r in rows)
            assert repr(plain(got.collect())) == repr(plain(want))
        assert some.count() < every.count() and sum(r.n_candidates for r in want) == 720
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = hooks.judge(some)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "Sort" not in below and "Aggregate" not in below
    with pytest.raises(ValueError):
        hooks.judge(some, provider)
