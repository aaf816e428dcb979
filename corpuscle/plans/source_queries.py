"""Queries that write files of every kind a reader takes, from the driver's tables, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions import text as X
from ..functions.text import nonblank
from ..operators import grading, hooks, reference, select, units
from ..session import scratch_root
from ..sources import readers, writers
from . import build
from .catalogue import _D_PARA, LANGS, TERMS, _corpus_back, _docs, _graded, _t, _units
from .registry import query

_GOOD_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}\s.,;:!?]'))::DOUBLE / nullif(length(text), 0)"


def _out(spark, name):
    return f"{scratch_root(spark)}/corpuscle/{name}-{uuid.uuid4().hex}"


def _bytes_by_folder(files, folder: str):
    name = F.regexp_extract("path", f"{folder}=([^/]+)/", 1)
    return files.groupBy(name.alias(folder)).agg(F.sum("length").cast("long").alias("n_bytes"), F.sum(F.octet_length("content")).cast("long").alias("n_read"))


@query("SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_read FROM documents GROUP BY source")
def image_scan(spark, sf):
    """Folders of several museums, scanned as one table of files."""
    path = _out(spark, "images")
    _docs(spark, sf).select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(path)
    return _bytes_by_folder(readers.images(spark, path, "*.txt"), "source")


@query("SELECT role, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_read FROM conversations GROUP BY role")
def audio_scan(spark, sf):
    path = _out(spark, "audio")
    _t(spark, sf, "conversations").select("role", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("role").text(path)
    return _bytes_by_folder(readers.audio(spark, path, "*.txt"), "role")


@query(f"SELECT doc_id::VARCHAR AS image, source AS museum, md5(text) AS digest, {_GOOD_SQL} AS confidence FROM documents")
def ocr_results_scan(spark, sf):
    path = _out(spark, "ocr")
    rows = _docs(spark, sf).select("doc_id", "source", "text").join(_graded(spark, sf).select(F.col("doc_id").alias("d"), "confidence"), F.col("doc_id") == F.col("d"))
    writers.json_rows(rows.select(F.col("doc_id").cast("string").alias("image"), F.col("source").alias("museum"), "text", "confidence"), path)
    return readers.ocr_results(spark, path, lines=True).select("image", "museum", F.md5("text").alias("digest"), "confidence")


@query("SELECT zh, en FROM (VALUES " + ", ".join(f"('{t}', '{t}-en')" for t in TERMS) + ") g(zh, en)")
def glossary_scan(spark, sf):
    return readers.glossary(spark, _glossary(spark)).select("zh", "en")


def _glossary(spark) -> str:
    path = _out(spark, "glossary")
    terms = spark.createDataFrame([([(t, f"{t}-en", None, None, None) for t in TERMS],)], schema.GLOSSARY)
    terms.select(F.to_json(F.struct("glossary")).alias("value")).coalesce(1).write.text(path)
    return path


@query("SELECT doc_id, g.en AS term FROM documents d JOIN (VALUES " + ", ".join(f"('{t}', '{t}-en')" for t in TERMS) + ") g(zh, en) ON contains(d.text, g.zh)")
def glossary_lookup(spark, sf):
    """The glossary as a table from its file, not as terms in the plan."""
    terms = readers.glossary(spark, _glossary(spark))
    return reference.glossary_lookup(_docs(spark, sf).select("doc_id", "text"), terms, "doc_id", "zh").select("doc_id", F.col("en").alias("term"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'skip' WHEN quality = 1 THEN 'confirm' ELSE 'correct' END AS action, CASE WHEN toxic = 1 OR quality = 1 THEN NULL ELSE md5(text) END AS digest
FROM labels JOIN documents USING (doc_id)""")
def reviews_scan(spark, sf):
    """Decisions as a file, each item decided twice; the later one counts."""
    path = _out(spark, "reviews")
    labels = _t(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    action = F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "confirm").otherwise("correct")
    at = lambda day: F.lit(f"2026-01-0{day} 10:00:00").cast("timestamp")
    last = labels.select(F.col("doc_id").cast("string").alias("item"), action.alias("action"), F.when(action == "correct", F.col("text")).alias("corrected_text"), at(2).alias("reviewed_at"))
    first = last.select("item", F.lit("confirm").alias("action"), F.lit("x").alias("corrected_text"), at(1).alias("reviewed_at"))
    writers.json_rows(last.unionByName(first), path)
    rows = grading.latest(readers.reviews(spark, path), "item", F.col("reviewed_at"))
    return rows.select(F.col("item").cast("long").alias("doc_id"), "action", F.md5("corrected_text").alias("digest"))


@query("SELECT event_type AS status, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS items FROM events GROUP BY event_type")
def progress_append(spark, sf):
    """Progress in two committed appends, read as one."""
    path = _out(spark, "progress")
    rows = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("item"), F.lit("s").alias("stage"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    failed = F.coalesce(F.col("status") == "error", F.lit(False))
    for part in (rows.where(failed), rows.where(~failed)):
        writers.append_progress(part, path)
    return readers.progress(spark, path).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("item").alias("items"))


@query("""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[#$%&*]{3,}'))::BIGINT AS n_zh_changes, len(regexp_extract_all(coalesce(text, ''), '[0-9]{4,}'))::BIGINT AS n_en_changes FROM documents""")
def corrections_per_board(spark, sf):
    """Boards with their lists of changes, as a file; boards without a change have none."""
    path = _out(spark, "boards")
    found = lambda p: F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
    changes = F.struct(found("[#$%&*]{3,}").alias("zh_changes"), found("[0-9]{4,}").alias("en_changes"))
    some = (F.size(changes["zh_changes"]) > 0) | (F.size(changes["en_changes"]) > 0)
    writers.json_rows(_docs(spark, sf).select(F.struct(F.col("doc_id").cast("string").alias("zh")).alias("board_title"), F.when(some, changes).alias("corrections")), path)
    rows = grading.corrections_count(readers.boards(spark, path, lines=True))
    return rows.select(F.col("board_title.zh").cast("long").alias("doc_id"), "n_zh_changes", "n_en_changes")


_NARROW = "".join(chr(c) for c in range(0x21, 0x7F))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


@query("SELECT doc_id, md5(replace(translate(text, '" + _WIDE + "', '" + _NARROW.replace("'", "''") + "'), chr(12288), ' ')) AS digest FROM documents")
def half_width(spark, sf):
    """Texts in full-width forms, brought back."""
    wide = F.translate("text", " " + _NARROW, "　" + _WIDE)
    return _docs(spark, sf).select("doc_id", F.md5(X.half_width(wide)).alias("digest"))


@query("SELECT event_id, (round(value, 3) * 1000)::BIGINT AS ms FROM events")
def speech_offsets(spark, sf):
    at = F.timestamp_seconds(F.lit(0)) + X.offset(F.col("value"))
    return _t(spark, sf, "events").select("event_id", F.unix_millis(at).alias("ms"))


@query("SELECT 'c' AS corpus_id, '1.0' AS version, DATE '2026-01-01' AS created, 4::BIGINT AS n_langs, count(*)::BIGINT AS n FROM documents")
def corpus_header(spark, sf):
    """The root document's own fields, with its date as a date."""
    return _corpus_back(spark, sf).groupBy("corpus_id", "version", "created", F.size("languages").cast("long").alias("n_langs")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT text, min(doc_id) AS low, max(doc_id) AS high, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text),
c AS (SELECT d.doc_id, d.source, d.text, quality::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.text IS NOT NULL),
v AS (SELECT k.text, k.high AS chosen FROM k WHERE n % 2 = 0),
r AS (SELECT c.*, row_number() OVER (PARTITION BY c.text ORDER BY coalesce(c.doc_id = v.chosen, false) DESC, score DESC NULLS LAST, c.doc_id) AS k, count(*) OVER (PARTITION BY c.text) AS n, v.chosen IS NOT NULL AS judged
      FROM c LEFT JOIN v ON v.text = c.text)
SELECT sha256(text) AS unit, doc_id, source, n::BIGINT AS n_candidates, judged FROM r WHERE k = 1""")
def judge_verdicts(spark, sf):
    """Verdicts of a judge as a table: its choice wins, and where there is none, the score."""
    labels = _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    docs = _docs(spark, sf).where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("unit"))
    by = docs.groupBy("unit").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n % 2 = 0").drop("n")
    rows = select.judge_by_verdicts(docs.join(labels, "doc_id", "left"), by, ["unit"], "doc_id", "score", "source")
    return rows.select("unit", "doc_id", "source", "n_candidates", "judged")


@query("""WITH u AS (SELECT doc_id // 5 AS unit, lang, text FROM documents), l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang),
k AS (SELECT unit, min(text) AS source FROM u GROUP BY unit), h AS (SELECT DISTINCT unit, lang FROM u WHERE regexp_matches(coalesce(text, ''), '[^\\s\\x{3000}\\x{00A0}]'))
SELECT k.unit, l.lang, md5(l.lang || ':' || coalesce(k.source, '')) AS digest FROM k CROSS JOIN l ANTI JOIN h ON h.unit = k.unit AND h.lang = l.lang""")
def hook_repair(spark, sf):
    """Missing translations of units, repaired by the model's stub."""
    rows = _units(spark, sf)
    filled = F.collect_set(F.when(nonblank(F.col("text")), F.col("lang")))
    by = rows.groupBy("unit").agg(F.min("text").alias("source"), filled.alias("filled"))
    gaps = by.select("unit", "source", F.explode(units.missing(F.col("filled"), LANGS)).alias("lang"))
    made = hooks.repair(gaps.select(F.col("unit").cast("string").alias("unit_id"), "lang", "source"))
    return made.select(F.col("unit_id").cast("long").alias("unit"), "lang", F.md5("text").alias("digest"))


@query(f"""WITH {_D_PARA}, x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL)
SELECT 'm_' || doc_id || '_p' || i || 's0' AS id, md5(line) AS zh, 4::BIGINT AS n_langs FROM x WHERE regexp_matches(line, '[^\\s\\x{{3000}}\\x{{00A0}}]')""")
def build_corpus(spark, sf):
    """All stages in one call, from images to exports; the corpus JSON that it wrote, read back."""
    images = _docs(spark, sf).where("text is not null").select(F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), F.col("text").cast("binary").alias("content"))
    out = _out(spark, "build")
    build.build(spark, images, lambda _: F.lit("m"), out, keep=False)
    rows = spark.read.schema("id string, translations map<string,string>").json(f"{out}/json")
    return rows.select("id", F.md5(F.element_at("translations", "zh")).alias("zh"), F.size("translations").cast("long").alias("n_langs"))
