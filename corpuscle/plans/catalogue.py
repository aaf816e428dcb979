"""Queries over the driver's tables, each with equivalent DuckDB SQL.

The tables hold no corpus of the kind this engine is for, so each query runs an operator on a structural stand-in:
documents as boards, doc_id div 5 with lang as alignment units, turns of a conversation as bilingual pairs, labels as
reviews, events as a progress log, benchmark as gold texts, rows of equal text as competing candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, scripts
from ..functions import text as X
from ..operators import align, coverage, grading, hooks, reference, repair, segment, select, units
from ..session import scratch_root
from ..sources import corpus_json, readers, writers
from ..streaming import incremental
from .registry import QUERIES, SQL, query

LANGS = ("de", "en", "es", "fr")

#: Terms of a small glossary: common pieces of the four languages.
TERMS = ("the", "and", "les", "ein", "con", "thand", "über", "ñ")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark, sf) -> DataFrame:
    return _t(spark, sf, "documents")


def _units(spark, sf) -> DataFrame:
    return _docs(spark, sf).select(F.floor(F.col("doc_id") / 5).cast("long").alias("unit"), "lang", "text", "doc_id")


_D_UNITS = "u AS (SELECT doc_id // 5 AS unit, lang, text, doc_id, regexp_matches(coalesce(text, ''), '[^\\s\\x{3000}\\x{00A0}]') AS ok FROM documents)"
_D_LANGS = "l AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS lang)"


# Coverage --------------------------------------------------------------------------------------------------------


@query(f"""WITH {_D_UNITS}, {_D_LANGS}, n AS (SELECT count(DISTINCT unit) AS n FROM u),
c AS (SELECT l.lang, count(DISTINCT u.unit) AS completed FROM l LEFT JOIN u ON u.lang = l.lang AND u.ok GROUP BY l.lang)
SELECT lang, completed::BIGINT AS completed, (n - completed)::BIGINT AS missing, 100.0::DOUBLE * completed / n AS coverage FROM c, n""")
def coverage_by_lang(spark, sf):
    return coverage.by_language(_units(spark, sf), "unit", LANGS)


@query(f"""WITH {_D_LANGS}, s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
c AS (SELECT source, lang, count(*) AS k FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\\s\\x{{3000}}\\x{{00A0}}]') GROUP BY source, lang)
SELECT s.source, l.lang, coalesce(k, 0)::BIGINT AS completed, (n - coalesce(k, 0))::BIGINT AS missing, 100.0::DOUBLE * coalesce(k, 0) / n AS coverage
FROM s CROSS JOIN l LEFT JOIN c ON c.source IS NOT DISTINCT FROM s.source AND c.lang = l.lang""")
def coverage_by_source_lang(spark, sf):
    return coverage.by_group_and_language(_docs(spark, sf), "source", LANGS)


@query(f"""WITH {_D_UNITS} SELECT unit, count(DISTINCT lang) FILTER (ok)::BIGINT AS n_langs,
count(DISTINCT lang) FILTER (ok AND lang IN ('de', 'en', 'es', 'fr')) = 4 AS complete FROM u GROUP BY unit""")
def complete_units(spark, sf):
    return coverage.unit_languages(_units(spark, sf), "unit", LANGS).select("unit", "n_langs", "complete")


@query(f"""WITH {_D_UNITS}, f AS (SELECT unit, list_distinct(list(lang) FILTER (ok)) AS filled FROM u GROUP BY unit)
SELECT unit, array_to_string(list_filter(['de', 'en', 'es', 'fr'], lambda x: NOT list_contains(filled, x)), ',') AS missing FROM f""")
def missing_langs(spark, sf):
    rows = coverage.unit_languages(_units(spark, sf), "unit", LANGS)
    return rows.select("unit", F.array_join(units.missing(F.col("filled"), LANGS), ",").alias("missing"))


@query(f"""WITH {_D_UNITS} SELECT unit, {', '.join(f"coalesce(min(doc_id) FILTER (lang = '{x}'), -1) AS {x}" for x in LANGS)} FROM u GROUP BY unit""")
def lang_pivot(spark, sf):
    return units.to_wide(_units(spark, sf), "unit", LANGS, value="doc_id").na.fill(-1)


@query(f"""WITH {_D_UNITS}, m AS (SELECT unit, lang, min(text) AS t FROM u WHERE lang IS NOT NULL GROUP BY ALL)
SELECT unit, string_agg(lang || ':' || md5(t), '|' ORDER BY lang) AS langs FROM m GROUP BY unit""")
def translations_map(spark, sf):
    rows = units.to_map(_units(spark, sf), "unit")
    entry = F.transform(F.map_entries("translations"), lambda e: F.concat(e["key"], F.lit(":"), F.md5(e["value"])))
    return rows.select("unit", F.array_join(F.array_sort(entry), "|").alias("langs"))


@query(f"""WITH {_D_UNITS}, {_D_LANGS}, k AS (SELECT DISTINCT unit FROM u), m AS (SELECT unit, lang, min(text) AS t FROM u GROUP BY ALL)
SELECT k.unit::VARCHAR AS id, l.lang, coalesce(length(m.t), -1)::BIGINT AS n FROM k CROSS JOIN l LEFT JOIN m ON m.unit = k.unit AND m.lang = l.lang""")
def translations_long(spark, sf):
    rows = units.to_map(_units(spark, sf), "unit").select(F.col("unit").cast("string").alias("id"), "translations")
    return units.explode_translations(rows, LANGS).select("id", "lang", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n"))


@query(f"""WITH {_D_UNITS}, a AS (SELECT unit, min(doc_id) AS en FROM u WHERE lang = 'en' GROUP BY unit), b AS (SELECT unit, min(doc_id) AS fr FROM u WHERE lang = 'fr' GROUP BY unit)
SELECT coalesce(a.unit, b.unit) AS unit, coalesce(en, -1) AS en, coalesce(fr, -1) AS fr FROM a FULL JOIN b ON a.unit = b.unit""")
def attach_targets(spark, sf):
    u = _units(spark, sf)
    side = lambda x: u.where(F.col("lang") == x).groupBy("unit").agg(F.min("doc_id").alias(x))
    return units.attach(side("en"), side("fr"), key="unit").na.fill(-1)


# Hierarchy -------------------------------------------------------------------------------------------------------

_D_PARA = """p AS (SELECT doc_id, rn, i - 1 AS p, para FROM (SELECT doc_id, rn, unnest(ls) AS para, generate_subscripts(ls, 1) AS i FROM
(SELECT doc_id, row_number() OVER () AS rn, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\s\\x{3000}\\x{00A0}]')) AS ls FROM documents)))"""
_D_SENT = (
    _D_PARA
    + """, q AS (SELECT doc_id, rn, p, list_filter(string_split(regexp_replace(regexp_replace(para, '([.!?]+["''”’)]*)\\s+', '\\1' || chr(1), 'g'), '([。！？]+[”’」』）]*)\\s*', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^\\s\\x{3000}\\x{00A0}]')) AS ss FROM p),
s AS (SELECT doc_id, rn, p, i - 1 AS s, sentence FROM (SELECT doc_id, rn, p, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM q))"""
)


def _paras(spark, sf):
    return segment.paragraphs(_docs(spark, sf).select("doc_id", "text"))


def _sents(spark, sf):
    return segment.sentences(_paras(spark, sf))


@query(f"WITH {_D_PARA} SELECT doc_id, p::BIGINT AS p, length(para)::BIGINT AS n_chars FROM p")
def paragraphs(spark, sf):
    return _paras(spark, sf).select("doc_id", F.col("p").cast("long").alias("p"), F.length("paragraph").cast("long").alias("n_chars"))


@query(f"WITH {_D_SENT} SELECT doc_id, p::BIGINT AS p, s::BIGINT AS s, md5(sentence) AS digest FROM s")
def sentences(spark, sf):
    return _sents(spark, sf).select("doc_id", F.col("p").cast("long").alias("p"), F.col("s").cast("long").alias("s"), F.md5("sentence").alias("digest"))


@query(f"WITH {_D_SENT} SELECT d.source || '_IMG' || s.doc_id || '_p' || p || 's' || s AS unit_id FROM s JOIN documents d ON d.doc_id = s.doc_id")
def unit_ids(spark, sf):
    rows = segment.sentences(segment.paragraphs(_docs(spark, sf).select("doc_id", "source", "text")))
    return rows.select(ids.compose_id(F.col("source"), F.concat(F.lit("IMG"), F.col("doc_id").cast("string")), F.col("p"), F.col("s")).alias("unit_id"))


@query(f"""WITH {_D_SENT}, i AS (SELECT d.source || '_x_IMG' || s.doc_id || '_p' || p || 's' || s AS unit_id FROM s JOIN documents d ON d.doc_id = s.doc_id),
x AS (SELECT unit_id, '^(.+)_([^_]+)_p(\\d+)s(\\d+)$' AS r FROM i)
SELECT unit_id, regexp_extract(unit_id, '^(.+)_([^_]+)_p(\\d+)s(\\d+)$', 1) AS museum, regexp_extract(unit_id, '^(.+)_([^_]+)_p(\\d+)s(\\d+)$', 2) AS stem,
regexp_extract(unit_id, '^(.+)_([^_]+)_p(\\d+)s(\\d+)$', 3)::INT AS p, regexp_extract(unit_id, '^(.+)_([^_]+)_p(\\d+)s(\\d+)$', 4)::INT AS s FROM x""")
def unit_id_parse(spark, sf):
    rows = segment.sentences(segment.paragraphs(_docs(spark, sf).select("doc_id", "source", "text")))
    made = ids.compose_id(F.concat("source", F.lit("_x")), F.concat(F.lit("IMG"), F.col("doc_id").cast("string")), F.col("p"), F.col("s"))
    return rows.select(made.alias("unit_id")).select("unit_id", ids.parse_id(F.col("unit_id")).alias("x")).select("unit_id", "x.*")


@query(f"""WITH {_D_SENT}, c AS (SELECT doc_id, p, count(*) AS n, min_by(md5(sentence), s) AS first FROM s GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS n_paragraphs, sum(n)::BIGINT AS n_sentences, max(n)::BIGINT AS longest, min_by(first, p) AS first FROM c GROUP BY doc_id""")
def hierarchy_sizes(spark, sf):
    rows = segment.nest(_sents(spark, sf).withColumn("sentence", F.md5("sentence")), "doc_id")
    n = F.transform("paragraphs", lambda p: F.size(p["sentences"]).cast("long"))
    return rows.select(
        "doc_id", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_sentences"),
        F.array_max(n).alias("longest"), F.get(F.get("paragraphs", F.lit(0))["sentences"], F.lit(0))["sentence"].alias("first"),
    )


@query(f"WITH {_D_SENT} SELECT doc_id, p::BIGINT AS p, s::BIGINT AS s, md5(sentence) AS digest FROM s")
def hierarchy_round_trip(spark, sf):
    rows = segment.flatten(segment.nest(_sents(spark, sf), "doc_id"), "doc_id")
    return rows.select("doc_id", F.col("p").cast("long").alias("p"), F.col("s").cast("long").alias("s"), F.md5("sentence").alias("digest"))


# Scripts and grades ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{r}'))::BIGINT AS {k}" for k, r in scripts.RANGES.items()) + " FROM documents")
def script_profile(spark, sf):
    return _docs(spark, sf).select("doc_id", *[scripts.script_count(F.col("text"), k).alias(k) for k in scripts.RANGES])


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[一-鿿]')) AS h, len(regexp_extract_all(text, '[぀-ヿ]')) AS k, len(regexp_extract_all(text, '[A-Za-zÀ-ɏ]')) AS l,
len(regexp_extract_all(text, '[Ѐ-ӿ]')) AS y FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
SELECT doc_id, CASE WHEN k > 0 THEN 'ja' WHEN greatest(h, l, y) = 0 THEN NULL WHEN h = greatest(h, l, y) THEN 'zh' WHEN y = greatest(h, l, y) THEN 'bg' ELSE 'en' END AS detected FROM c""")
def language_detect(spark, sf):
    return _docs(spark, sf).select("doc_id", scripts.detect_language(F.col("text")).alias("detected"))


_GOOD = r"[\p{L}\p{N}\s.,;:!?]"
_D_GRADE = f"""c AS (SELECT d.doc_id, source, text, len(regexp_extract_all(text, '{_GOOD}'))::DOUBLE / nullif(length(text), 0) AS confidence, coalesce(l.quality = 1 AND l.toxic = 0, false) AS reviewed
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
g AS (SELECT *, CASE WHEN reviewed THEN 'A' WHEN confidence BETWEEN 0.8 AND 0.9 THEN 'B' WHEN confidence < 0.8 THEN 'C' ELSE 'U' END AS grade FROM c)"""


def _graded(spark, sf):
    docs, labels = _docs(spark, sf), _t(spark, sf, "labels").select("doc_id", "quality", "toxic")
    share = F.try_divide(F.regexp_count("text", F.lit(_GOOD)).cast("double"), F.length("text").cast("double"))
    rows = docs.select("doc_id", "source", share.alias("confidence")).join(labels, "doc_id", "left")
    rows = rows.withColumn("reviewed", F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)))
    return rows.withColumn("grade", grading.grade(F.col("confidence"), F.col("reviewed")))


@query(f"WITH {_D_GRADE} SELECT doc_id, confidence, reviewed, grade FROM g")
def grade_assign(spark, sf):
    return _graded(spark, sf).select("doc_id", "confidence", "reviewed", "grade")


@query(f"WITH {_D_GRADE} SELECT grade, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM g GROUP BY grade")
def grade_distribution(spark, sf):
    return coverage.distribution(_graded(spark, sf), "grade")


@query(f"WITH {_D_GRADE} SELECT doc_id, grade FROM g WHERE grade IN ('A', 'B')")
def grade_at_least(spark, sf):
    return _graded(spark, sf).where(grading.at_least(F.col("grade"), "B")).select("doc_id", "grade")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'confirm' WHEN quality = 0 THEN 'correct' END AS action,
md5(CASE WHEN quality = 0 THEN 'c' || text ELSE text END) AS digest
FROM (SELECT d.doc_id, text, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE toxic = 0""")
def review_overlay(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    reviews = _t(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "skip").when(F.col("quality") == 1, "confirm").otherwise("correct").alias("action"))
    # The correction here is made from the item itself, so that it is deterministic.
    reviews = reviews.join(docs.select("doc_id", F.concat(F.lit("c"), "text").alias("corrected_text")), "doc_id")
    return grading.review_overlay(docs, reviews, "doc_id").select("doc_id", "action", F.md5("final").alias("digest"))


# Progress --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_status(spark, sf):
    return grading.latest(_t(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", F.col("ts"), F.col("event_id")).drop("ts")


@query("SELECT user_id, event_id AS first_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_status(spark, sf):
    rows = grading.first_by_window(_t(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", F.col("ts"), F.col("event_id"))
    return rows.select("user_id", F.col("event_id").alias("first_event"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = d.doc_id)")
def pending_items(spark, sf):
    return repair.pending(_docs(spark, sf).select("doc_id"), _t(spark, sf, "events").select(F.col("user_id").alias("doc_id")), "doc_id")


@query("""WITH s AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)
SELECT doc_id FROM documents d LEFT JOIN s ON s.user_id = d.doc_id WHERE event_type IS DISTINCT FROM 'error'""")
def drop_failed(spark, sf):
    last = grading.latest(_t(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), "user_id", F.col("ts"), F.col("event_id"))
    failed = last.where("event_type = 'error'").select(F.col("user_id").alias("doc_id"))
    return repair.pending(_docs(spark, sf).select("doc_id"), failed, "doc_id")


@query("SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS items FROM events GROUP BY event_type")
def incremental_progress(spark, sf):
    """A file stream in two runs under one checkpoint; the second finds nothing new."""
    import uuid

    root = f"{scratch_root(spark)}/corpuscle/progress-{uuid.uuid4().hex}"
    fields = _t(spark, sf, "events").schema
    for _ in range(2):
        stream = incremental.file_stream(spark, sf, fields, glob="events.parquet")
        incremental.run_available(stream, incremental.once_per_batch(f"{root}/out"), f"{root}/checkpoint")
    rows = spark.read.schema(fields).parquet(f"{root}/out")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("items"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def status_hourly(spark, sf):
    rows = incremental.windowed_counts(_t(spark, sf, "events"), "ts", "event_type")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def status_sessions(spark, sf):
    rows = incremental.sessions(_t(spark, sf, "events"), "ts", "user_id")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


# Pairs -----------------------------------------------------------------------------------------------------------

_D_PAIRS = """t AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS a, CASE WHEN r2 = 'assistant' THEN t2 END AS b FROM t WHERE role = 'user')"""
_D_FLAGS = (
    _D_PAIRS
    + """, o AS (SELECT *, regexp_matches(coalesce(a, ''), '[^\\s\\x{3000}\\x{00A0}]') AS x, regexp_matches(coalesce(b, ''), '[^\\s\\x{3000}\\x{00A0}]') AS y FROM p),
f AS (SELECT *, x AND y AS perfect, x != y AS monolingual, x AND y AND coalesce(length(b)::DOUBLE / nullif(length(a), 0) < 0.5, false) AS abbreviated FROM o)"""
)


def _pairs(spark, sf):
    return align.adjacent_pairs(_t(spark, sf, "conversations"), "conv_id", "turn", "role", "text", "user", "assistant")


def _flags(spark, sf):
    return grading.pair_flags(_pairs(spark, sf), "a", "b")


@query(f"WITH {_D_PAIRS} SELECT conv_id, turn, md5(a) AS a, md5(b) AS b FROM p WHERE b IS NOT NULL")
def turn_pairs(spark, sf):
    return _pairs(spark, sf).where("b is not null").select("conv_id", "turn", F.md5("a").alias("a"), F.md5("b").alias("b"))


@query(f"WITH {_D_PAIRS} SELECT conv_id, turn FROM p WHERE b IS NULL")
def unpaired_turns(spark, sf):
    return _pairs(spark, sf).where("b is null").select("conv_id", "turn")


@query(f"WITH {_D_FLAGS} SELECT conv_id, turn, length(b)::DOUBLE / nullif(length(a), 0) AS ratio, abbreviated FROM f")
def length_ratio_flags(spark, sf):
    return _flags(spark, sf).select("conv_id", "turn", X.length_ratio(F.col("a"), F.col("b")).alias("ratio"), "abbreviated")


@query(f"WITH {_D_FLAGS} SELECT conv_id, bool_and(perfect) AS perfect, bool_or(monolingual) AS monolingual, bool_or(abbreviated) AS abbreviated FROM f GROUP BY conv_id")
def board_flags(spark, sf):
    return grading.board_flags(_flags(spark, sf), "conv_id")


@query(f"""WITH {_D_FLAGS}, b AS (SELECT conv_id, bool_and(perfect) AS perfect, bool_or(monolingual) AS monolingual, bool_or(abbreviated) AS abbreviated FROM f GROUP BY conv_id)
SELECT count(*)::BIGINT AS boards, count(*) FILTER (perfect)::BIGINT AS perfect, count(*) FILTER (monolingual)::BIGINT AS monolingual, count(*) FILTER (abbreviated)::BIGINT AS abbreviated FROM b""")
def board_class_counts(spark, sf):
    n = {k: F.count_if(k) for k in ("perfect", "monolingual", "abbreviated")}
    return coverage.totals(grading.board_flags(_flags(spark, sf), "conv_id"), boards=F.count("*"), **n)


@query("""WITH t AS (SELECT role, conv_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations), u AS (SELECT * FROM t WHERE role = 'user'), a AS (SELECT * FROM t WHERE role = 'assistant')
SELECT u.conv_id % 3 AS lang, count(*)::BIGINT AS n, count(a.k)::BIGINT AS aligned, 100.0::DOUBLE * count(a.k) / count(*) AS rate FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.k = u.k GROUP BY 1""")
def speech_alignment_rate(spark, sf):
    from pyspark.sql import Window

    rows = _t(spark, sf, "conversations").select("conv_id", "role", "turn")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    unit = rows.where("role = 'user'").select(F.col("conv_id").alias("lang"), "ordinal")
    spoken = rows.where("role = 'assistant'").select(F.col("conv_id").alias("lang"), "ordinal", F.col("turn").cast("double").alias("start_s"), (F.col("turn") + 1.0).alias("end_s"))
    return coverage.alignment_rate(align.speech(unit, spoken).withColumn("lang", F.col("lang") % 3), "lang", "aligned")


# Selection and repair --------------------------------------------------------------------------------------------

_D_JUDGE = """c AS (SELECT d.doc_id, source, text, quality::DOUBLE AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE text IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC NULLS LAST, doc_id) AS k, count(*) OVER (PARTITION BY text) AS n FROM c)"""


def _candidates(spark, sf):
    labels = _t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("score"))
    docs = _docs(spark, sf).where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("unit"))
    return docs.join(labels, "doc_id", "left")


def _winners(spark, sf):
    return select.judge(_candidates(spark, sf), ["unit"], "score", "doc_id", "source")


@query(f"WITH {_D_JUDGE} SELECT sha256(text) AS unit, doc_id, score, source, n::BIGINT AS n_candidates FROM k WHERE k = 1")
def judge_select(spark, sf):
    return _winners(spark, sf)


@query(f"WITH {_D_JUDGE} SELECT source, count(*)::BIGINT AS n, count(*) FILTER (k = 1)::BIGINT AS wins, count(*) FILTER (k = 1)::DOUBLE / count(*) AS rate FROM k GROUP BY source")
def judge_win_rate(spark, sf):
    return select.win_rates(_candidates(spark, sf), _winners(spark, sf), ["unit"], "source", "doc_id")


@query(f"WITH {_D_JUDGE} SELECT (doc_id % 4)::BIGINT AS lang, count(*)::BIGINT AS n, count(*) FILTER (source = 'src' || (doc_id % 5))::BIGINT AS own FROM k WHERE k = 1 GROUP BY 1")
def judge_self_preference(spark, sf):
    w = _winners(spark, sf).withColumns({"lang": F.col("doc_id") % 4, "judge": F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string"))})
    return select.self_preference(w, "lang", "source", "judge")


_D_REPAIR = """g AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[#$%&*]{3,}') THEN '  ' WHEN regexp_matches(text, 'https?://') THEN NULL ELSE text END AS text,
CASE WHEN regexp_matches(text, '[#$%&*]{3,}') THEN regexp_replace(text, '[#$%&*]{3,}', '', 'g') END AS rule, (SELECT min('m' || quality) FROM labels l WHERE l.doc_id = d.doc_id) AS model FROM documents d)"""


@query(f"""WITH {_D_REPAIR} SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN 'original' WHEN rule IS NOT NULL THEN 'rule' WHEN model IS NOT NULL THEN 'model' ELSE 'none' END AS method,
md5(CASE WHEN regexp_matches(coalesce(text, ''), '[^\\s]') THEN text ELSE coalesce(rule, model) END) AS digest FROM g""")
def repair_fill(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "text")
    # Texts with recognition marks count as unreadable, those with addresses as missing; a rule repairs the former.
    noisy = F.rlike("text", F.lit(r"[#$%&*]{3,}"))
    gaps = docs.withColumn("text", F.when(noisy, "  ").when(F.rlike("text", F.lit("https?://")), None).otherwise(F.col("text")))
    rule = docs.where(noisy).select("doc_id", F.lit("rule").alias("method"), X.noise(F.col("text")).alias("text"))
    model = _t(spark, sf, "labels").select("doc_id", F.lit("model").alias("method"), F.concat(F.lit("m"), F.col("quality").cast("string")).alias("text"))
    return repair.fill(gaps, rule.unionByName(model), ["doc_id"]).select("doc_id", "method", F.md5("final").alias("digest"))


@query("""WITH p AS (SELECT doc_id // 5 AS unit, doc_id, CASE WHEN lang = 'en' THEN n_chars END AS en, CASE WHEN lang != 'en' THEN n_chars END AS other FROM documents)
SELECT unit, coalesce(min_by(en, doc_id) FILTER (en IS NOT NULL), -1) AS en, coalesce(min_by(other, doc_id) FILTER (other IS NOT NULL), -1) AS other FROM p GROUP BY unit""")
def merge_partial(spark, sf):
    rows = _docs(spark, sf).select(F.floor(F.col("doc_id") / 5).cast("long").alias("unit"), "doc_id", F.when(F.col("lang") == "en", F.col("n_chars")).alias("en"), F.when(F.col("lang") != "en", F.col("n_chars")).alias("other"))
    return repair.merge_partial(rows, "unit", "doc_id").na.fill(-1)


@query(r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[#$%&*]{3,}'))::BIGINT AS n_corrections, md5(regexp_replace(text, '[#$%&*]{3,}', '', 'g')) AS digest FROM documents""")
def noise_corrections(spark, sf):
    return _docs(spark, sf).select("doc_id", F.coalesce(F.regexp_count("text", F.lit(r"[#$%&*]{3,}")), F.lit(0)).cast("long").alias("n_corrections"), F.md5(X.noise(F.col("text"))).alias("digest"))


@query("""SELECT doc_id, md5(replace(replace(text, 'the', 'THE'), 'THE and', 'the &')) AS digest FROM documents""")
def apply_corrections(spark, sf):
    changes = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in (("the", "THE"), ("", "x"), ("THE and", "the &"))])
    return _docs(spark, sf).select("doc_id", F.md5(X.apply_changes(F.col("text"), changes)).alias("digest"))


@query(f"""WITH {_D_SENT}, j AS (SELECT rn, p, string_agg(sentence, '' ORDER BY s) AS t FROM s GROUP BY rn, p)
SELECT p.doc_id, p.p::BIGINT AS p, regexp_replace(para, '[\\s\\x{{3000}}\\x{{00A0}}]+', '', 'g') = regexp_replace(coalesce(t, ''), '[\\s\\x{{3000}}\\x{{00A0}}]+', '', 'g') AS kept,
length(para) - length(regexp_replace(para, '[#$%&*]{{3,}}', '', 'g')) <= 10 AS cleaned FROM p LEFT JOIN j ON j.rn = p.rn AND j.p = p.p""")
def clean_not_rewrite(spark, sf):
    """Whole paragraphs. Noise is only taken out, so that the SQL can count its edits as the characters that go."""
    rows = _paras(spark, sf)
    return rows.select(
        "doc_id", F.col("p").cast("long").alias("p"), X.keeps_text(F.col("paragraph"), X.sentences(F.col("paragraph"))).alias("kept"),
        X.only_cleaned(F.col("paragraph"), X.noise(F.col("paragraph")), F.lit(10)).alias("cleaned"),
    )


# Reference data --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def gold_containment(spark, sf):
    return reference.gold_containment(_docs(spark, sf).select("doc_id", "text"), _t(spark, sf, "benchmark"), "doc_id", "item_id")


@query()
def gold_similarity(spark, sf):
    """Held passages with what follows them against the gold text, in characters of any script; SQL here counts bytes."""
    docs, gold = _docs(spark, sf).select("doc_id", "text"), _t(spark, sf, "benchmark")
    hit = reference.gold_containment(docs, gold, "doc_id", "item_id")
    rows = hit.join(docs, "doc_id").join(gold.select("item_id", F.col("text").alias("gold")), "item_id")
    held = F.call_function("substr", F.col("text"), F.call_function("locate", F.col("gold"), F.col("text")), F.length("gold") + 10)
    return reference.gold_similarity(rows.withColumn("held", held), "gold", "held").select("doc_id", "item_id", "similarity")


@query("SELECT doc_id, term FROM documents d JOIN (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") g(term) ON contains(d.text, g.term)")
def glossary_hits(spark, sf):
    return reference.glossary_hits(_docs(spark, sf), list(TERMS), "doc_id")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT q.vec_id, r.vec_id AS nearest, list_inner_product(q.v, r.v) AS similarity FROM e q JOIN e r ON q.vec_id != r.vec_id WHERE q.vec_id % 20 = 0)
SELECT vec_id, nearest, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, nearest) AS k FROM s) WHERE k = 1""")
def nearest_vector(spark, sf):
    rows = _t(spark, sf, "embeddings").select("vec_id", "embedding")
    return reference.nearest(rows.where("vec_id % 20 = 0"), rows, "vec_id", "embedding").withColumn("similarity", F.round("similarity", 6))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS html_lang, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS url_lang,
regexp_extract(html, '<html lang="([a-z]+)"', 1) IS NOT DISTINCT FROM regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS agree FROM pages""")
def evidence_agreement(spark, sf):
    pages = _t(spark, sf, "pages")
    seen = pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("html_lang"))
    named = pages.select("page_id", F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("url_lang"))
    return align.evidence(seen, named, "page_id", "html_lang", "url_lang")


# Totals and sets -------------------------------------------------------------------------------------------------


@query(f"""WITH {_D_GRADE}, n AS (SELECT 0 AS ordinal, 'documents' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'labelled', count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL SELECT 2, 'reviewed', count(*) FROM g WHERE grade = 'A')
SELECT ordinal::BIGINT AS ordinal, stage, n::BIGINT AS n, n::DOUBLE / nullif(lag(n) OVER (ORDER BY ordinal), 0) AS rate FROM n""")
def stage_funnel(spark, sf):
    docs = _docs(spark, sf).select("doc_id")
    labelled = docs.join(_t(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return coverage.funnel(("documents", docs), ("labelled", labelled), ("reviewed", _graded(spark, sf).where("grade = 'A'")))


@query(f"""WITH {_D_SENT} SELECT (SELECT count(*) FROM documents)::BIGINT AS boards, (SELECT count(DISTINCT source) FROM documents)::BIGINT AS museums,
(SELECT count(*) FROM p)::BIGINT AS paragraphs, (SELECT count(*) FROM s)::BIGINT AS sentences, (SELECT count(DISTINCT text) FROM documents)::BIGINT AS texts""")
def corpus_stats(spark, sf):
    docs = _docs(spark, sf)
    parts = X.paragraphs(F.col("text"))
    rows = docs.select("source", F.sha2("text", 256).alias("t"), F.size(parts).cast("long").alias("p"), F.aggregate(F.transform(parts, lambda x: F.size(X.sentences(x))), F.lit(0), lambda a, x: a + x).cast("long").alias("s"))
    return coverage.totals(rows, boards=F.count("*"), museums=F.countDistinct("source"), paragraphs=F.sum("p"), sentences=F.sum("s"), texts=F.countDistinct("t"))


@query("SELECT source, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars, min(doc_id) AS first FROM documents GROUP BY source")
def museum_stats(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))


@query("SELECT source, lang, grouping_id(source, lang)::BIGINT AS level, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (source, lang)")
def rollup_source_lang(spark, sf):
    return _docs(spark, sf).rollup("source", "lang").agg(F.grouping_id("source", "lang").alias("level"), F.count("*").alias("n"))


@query("""SELECT doc_id, 'rule' AS method FROM documents WHERE regexp_matches(text, '[#$%&*]{3,}') UNION ALL SELECT doc_id, 'model' FROM labels""")
def combine_repairs(spark, sf):
    rule = _docs(spark, sf).where(X.noise(F.col("text")) != F.col("text")).select("doc_id", F.lit("rule").alias("method"))
    return rule.unionByName(_t(spark, sf, "labels").select("doc_id", F.lit("model").alias("method")))


@query("SELECT doc_id, sha256(coalesce(source, chr(2)) || chr(1) || coalesce(text, chr(2))) AS digest FROM documents")
def content_digest(spark, sf):
    return _docs(spark, sf).select("doc_id", X.content_hash(F.col("source"), F.col("text")).alias("digest"))


# Exports, read back ----------------------------------------------------------------------------------------------


def _export_rows(spark, sf):
    rows = _pairs(spark, sf).where("b is not null")
    key = F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    return rows.select(key.alias("id"), F.explode(F.array(F.struct(F.lit("zh").alias("lang"), F.col("a").alias("text")), F.struct(F.lit("en").alias("lang"), F.col("b").alias("text")))).alias("x")).select("id", "x.*")


def _out(spark, name):
    import uuid

    return f"{scratch_root(spark)}/corpuscle/{name}-{uuid.uuid4().hex}"


_D_EXPORT = f"WITH {_D_PAIRS}, e AS (SELECT conv_id || '_' || turn AS id, 'zh' AS lang, a AS text FROM p WHERE b IS NOT NULL UNION ALL SELECT conv_id || '_' || turn, 'en', b FROM p WHERE b IS NOT NULL)"


@query(f"{_D_EXPORT} SELECT id, lang, md5(text) AS digest FROM e")
def export_json_rows(spark, sf):
    rows, path = units.to_map(_export_rows(spark, sf), "id"), _out(spark, "json")
    writers.json_rows(rows, path)
    back = spark.read.schema("id string, translations map<string,string>").json(path)
    return units.explode_translations(back, ("zh", "en")).select("id", "lang", F.md5("text").alias("digest"))


@query(f"{_D_EXPORT} SELECT id, lang, md5(regexp_replace(text, '\\s+', ' ', 'g')) AS digest FROM e")
def export_tmx_rows(spark, sf):
    path = _out(spark, "tmx")
    writers.tmx(_export_rows(spark, sf), path)
    return readers.tmx(spark, path).select("id", "lang", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("digest"))


@query(f"{_D_EXPORT} SELECT lang, count(*)::BIGINT AS n, count(DISTINCT regexp_replace(text, '[\\r\\n]+', ' ', 'g'))::BIGINT AS lines FROM e GROUP BY lang")
def export_text_rows(spark, sf):
    path = _out(spark, "text")
    writers.parallel_text(units.to_wide(_export_rows(spark, sf), "id", ("zh", "en")), path, "id", ("zh", "en"))
    back = [spark.read.text(f"{path}/{x}").withColumn("lang", F.lit(x)) for x in ("zh", "en")]
    return back[0].unionByName(back[1]).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("value").alias("lines"))


@query(f"WITH {_D_GRADE} SELECT grade, count(*)::BIGINT AS n, sum(doc_id)::BIGINT AS ids FROM g GROUP BY grade")
def export_by_grade(spark, sf):
    path = _out(spark, "graded")
    writers.by_grade(_graded(spark, sf).select("doc_id", "grade"), path)
    return readers.graded(spark, path, "doc_id long").groupBy("grade").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT source AS museum, count(*)::BIGINT AS n, min(doc_id)::VARCHAR AS first, count(DISTINCT text)::BIGINT AS texts FROM documents GROUP BY source""")
def root_document(spark, sf):
    """One JSON document of all units with their texts, written in parts and read back as rows."""
    back = _corpus_back(spark, sf)
    text = F.md5(F.get(F.map_values("translations"), F.lit(0)))
    return back.groupBy(F.col("source.museum").alias("museum")).agg(F.count("*").alias("n"), F.min(F.col("id").cast("long")).cast("string").alias("first"), F.countDistinct(text).alias("texts"))


@query("SELECT doc_id::VARCHAR AS id, source AS museum, doc_id || '.jpg' AS image, lang, md5(text) AS digest FROM documents")
def corpus_json_units(spark, sf):
    """Every unit of the written document, field by field."""
    back = _corpus_back(spark, sf)
    lang = F.get(F.map_keys("translations"), F.lit(0))
    return back.select("id", "source.museum", "source.image", lang.alias("lang"), F.md5(F.element_at("translations", lang)).alias("digest"))


def _corpus_back(spark, sf):
    path = _out(spark, "root")
    src = F.struct(F.col("source").alias("museum"), F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("image"), F.lit('a "title"}').alias("title_zh"), F.lit("{[").alias("title_en"))
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), src.alias("source"), F.create_map(F.coalesce("lang", F.lit("")), F.col("text")).alias("translations"))
    corpus_json.write(rows, path, "c", "corpus", "1.0", "2026-01-01", LANGS)
    return readers.corpus(spark, path, parts=True)


# Hooks with their offline stubs ----------------------------------------------------------------------------------


@query("SELECT doc_id::VARCHAR AS image, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def hook_ocr(spark, sf):
    images = _docs(spark, sf).where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return hooks.ocr(images).where("text is not null").select("image", F.md5("text").alias("digest"))


@query(f"WITH {_D_PAIRS} SELECT conv_id || '_' || turn AS board, bool_and(length(a) % 2 = 0) AS kept FROM p WHERE b IS NOT NULL GROUP BY 1")
def hook_enhance(spark, sf):
    """A provider that adds to texts of odd length: the check must find them."""
    rows = _pairs(spark, sf).where("b is not null").select(F.concat_ws("_", "conv_id", "turn").alias("board"), F.col("a").alias("zh"), F.col("b").alias("en"))

    def adding(batch):
        out = hooks.stub_enhance(batch)
        odd = set(batch["board"][batch["zh"].str.len() % 2 == 1])
        out["zh_parts"] = [[*z, "x"] if b in odd else z for b, z in zip(out["board"], out["zh_parts"])]
        out["en_parts"] = [[*e, ""] if b in odd else e for b, e in zip(out["board"], out["en_parts"])]
        return out

    return hooks.enhance(rows, adding).groupBy("board").agg(F.bool_and("kept").alias("kept"))


@query("""WITH c AS (SELECT doc_id::VARCHAR AS unit_id, l.lang, model, l.lang || ':' || model || ':' || coalesce(text, '') AS text
FROM documents CROSS JOIN (SELECT unnest(['ja', 'es', 'bg']) AS lang) l CROSS JOIN (SELECT unnest(['m1', 'm2']) AS model)),
s AS (SELECT *, ('0x' || substr(md5(text), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS score FROM c)
SELECT unit_id, lang, score, model, text, 2::BIGINT AS n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, lang ORDER BY score DESC, model) AS k FROM s) WHERE k = 1""")
def hook_translate_judge(spark, sf):
    rows = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("unit_id"), "text")
    return hooks.judge(hooks.translate(rows, ("ja", "es", "bg"), ("m1", "m2"), fold=True))


@query("SELECT doc_id::VARCHAR AS image, length(text) % 3 != 0 AS ok FROM documents WHERE text IS NOT NULL")
def hook_visual_check(spark, sf):
    """Every third text or so was changed since it was read from its image."""
    text = F.when(F.length("text") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    rows = _docs(spark, sf).where("text is not null").select(F.col("doc_id").cast("string").alias("image"), F.col("text").cast("binary").alias("content"), text.alias("text"))
    return hooks.visual_check(rows).select("image", "ok")


@query(f"WITH {_D_PARA} SELECT doc_id::VARCHAR AS path, count(*)::BIGINT AS n FROM p GROUP BY doc_id")
def hook_transcribe(spark, sf):
    rows = _docs(spark, sf).where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return hooks.transcribe(rows).where(X.nonblank(F.col("text"))).groupBy("path").agg(F.count("*").alias("n"))


from . import source_queries as source_queries  # noqa: E402  registers its queries, which use the helpers above
from . import alignment_queries as alignment_queries  # noqa: E402
from . import evaluation_queries as evaluation_queries  # noqa: E402
from . import order_queries as order_queries  # noqa: E402
from . import state_queries as state_queries  # noqa: E402
from . import table_queries as table_queries  # noqa: E402
