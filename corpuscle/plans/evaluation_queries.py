"""The corpus as an evaluation standard: translations scored against the gold side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits, glossary, scores
from .catalogue import _docs, _t
from .registry import query

#: What the stand-in for a translation system gets wrong.
_SLIPS = ((" the ", " a "), ("que", "qe"), (" und ", " and "), ("ment", "mnet"))
_WORDS = "[^\\s\\x{3000}\\x{00A0}]+"


def _sql_slips(c: str) -> str:
    for a, b in _SLIPS:
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _sql_words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '{_WORDS}')"


def _sql_chars(c: str) -> str:
    return f"list_filter(string_split(array_to_string({_sql_words(c)}, ''), ''), lambda x: x != '')"


def _sql_side(kind: str, top: int, symbols, glue: str) -> str:
    grams = lambda side: f"SELECT rn, n, unnest(list_transform(range(1, len({side}) - n + 2), lambda i: array_to_string({side}[i:i + n - 1], '{glue}'))) AS g FROM {kind}s, range(1, {top + 1}) t(n)"
    return f"""{kind}s AS (SELECT rn, {symbols('hyp')} AS hyp, {symbols('ref')} AS ref FROM t),
{kind}h AS (SELECT rn, n, g, count(*) AS k FROM ({grams('hyp')}) GROUP BY ALL), {kind}r AS (SELECT rn, n, g, count(*) AS k FROM ({grams('ref')}) GROUP BY ALL),
{kind}b AS (SELECT role, n, sum(least({kind}h.k, {kind}r.k)) AS both_n FROM {kind}h JOIN {kind}r USING (rn, n, g) JOIN t USING (rn) GROUP BY role, n),
{kind}n AS (SELECT role, n, sum(greatest(len({kind}s.hyp) - n + 1, 0)) AS hyp_n, sum(greatest(len({kind}s.ref) - n + 1, 0)) AS ref_n FROM {kind}s JOIN t USING (rn), range(1, {top + 1}) q(n) GROUP BY role, n),
{kind} AS (SELECT role, n, coalesce(both_n, 0)::DOUBLE AS both_n, hyp_n::DOUBLE AS hyp_n, ref_n::DOUBLE AS ref_n FROM {kind}n LEFT JOIN {kind}b USING (role, n))"""


@query(f"""WITH t AS (SELECT row_number() OVER () AS rn, role, {_sql_slips('text')} AS hyp, text AS ref FROM conversations),
{_sql_side('w', 4, _sql_words, ' ')},
{_sql_side('c', 6, _sql_chars, '')},
x AS (SELECT role, exp(least(0, 1 - max(ref_n) FILTER (n = 1) / max(hyp_n) FILTER (n = 1)) + avg(ln(both_n / hyp_n))) * 100 AS bleu FROM w GROUP BY role),
y AS (SELECT role, avg(both_n / hyp_n) AS p, avg(both_n / ref_n) AS r FROM c WHERE hyp_n > 0 AND ref_n > 0 GROUP BY role)
SELECT role, round(bleu, 6) AS bleu, round(100 * 5 * p * r / (4 * p + r), 6) AS chrf FROM x JOIN y USING (role)""")
def corpus_scores(spark, sf):
    """BLEU and chrF of turns with slips against the turns themselves, by role."""
    pairs = _t(spark, sf, "conversations").select("role", F.col("text").alias("ref"), X.apply_changes(F.col("text"), F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in _SLIPS])).alias("hyp"))
    rows = scores.added(scores.statistics(pairs, ["role"], "hyp", "ref"), "role")
    return rows.select("role", F.round(scores.bleu(), 6).alias("bleu"), F.round(scores.chrf(), 6).alias("chrf"))


@query(r"""WITH c AS (SELECT doc_id, text, regexp_replace(text, '[#$%&*]{3,}', '', 'g') AS clean FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (length(text) - length(clean))::BIGINT AS deleted, 0::BIGINT AS inserted, md5(clean) AS digest,
CASE WHEN text = clean THEN 'same' WHEN length(text) - length(clean) > 0.1 * length(text) THEN 'rewritten' ELSE 'cleaned' END AS verdict FROM c""")
def found_corrections(spark, sf):
    """What cleaning did to every text, found from the two texts alone and played back on the first."""
    rows = _docs(spark, sf).where("text is not null").withColumn("clean", X.noise(F.col("text")))
    rows = edits.with_script(rows, ["doc_id", "text"], "text", "clean")
    s = F.col("script")
    return rows.select("doc_id", edits.deleted(s).alias("deleted"), edits.inserted(s).alias("inserted"), F.md5(edits.play(F.col("text"), s)).alias("digest"), edits.verdict(F.col("text"), s).alias("verdict"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(text, ' the ', ' a '), 'que', 'qe'), ' und ', ' and '), 'ment', 'mnet')) AS digest FROM documents WHERE text IS NOT NULL""")
def replayed_corrections(spark, sf):
    """Slips of all kinds, found as a script and played back."""
    slips = F.array(*[F.struct(F.lit(a).alias("before"), F.lit(b).alias("after")) for a, b in _SLIPS])
    rows = _docs(spark, sf).where("text is not null").withColumn("after", X.apply_changes(F.col("text"), slips))
    rows = edits.with_script(rows, ["doc_id", "text"], "text", "after")
    return rows.select("doc_id", F.md5(edits.play(F.col("text"), F.col("script"))).alias("digest"))


@query(r"""WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\s]{5,}')) AS term FROM benchmark)
SELECT doc_id, term, min(strpos(text, term))::BIGINT AS first FROM documents JOIN g ON contains(text, term) GROUP BY doc_id, term""".replace("\\\\", "\\"))
def glossary_places(spark, sf):
    """Words of the gold texts as terms, and where each text first holds them."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\s]{5,})"), F.lit(1))).alias("term"))
    rows = glossary.term_places(_docs(spark, sf), words, ["doc_id"])
    return rows.groupBy("doc_id", "term").agg((F.min("start") + 1).cast("long").alias("first"))


@query()
def glossary_longest(spark, sf):
    """The same terms, without overlaps."""
    words = _t(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\s]{5,})"), F.lit(1))).alias("term"))
    return glossary.term_places(_docs(spark, sf), words, ["doc_id"], longest=True)
