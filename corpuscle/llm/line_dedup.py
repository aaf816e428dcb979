"""Operator 6: remove multi-line passages that repeat anywhere in the corpus, in DataFrame functions only.

A document's lines are hashed; a rolling hash over each line and the one before it ends a chunk where it is
divisible by ``divisor``, so a passage is cut alike wherever it stands, whatever precedes it. Chunks are judged at
two levels. Each carries the ``min_lines`` - 1 lines before it too, so that every window of ``min_lines`` lines lies
in just one chunk:

1. Chunks with equal digests are counted over the corpus; all copies but the first (smaller doc_id, hash of the
   text, place) go as they are.
2. What is left, one copy of each distinct chunk, is cut after each line: chunks of ``min_lines`` lines. These find
   the repeated runs that end or begin inside a chunk, however short.

A window that occurs earlier lies in a later copy of a chunk, or its chunk and that of its first occurrence are both
at level 2; so a line goes if and only if it lies in ``min_lines`` consecutive lines or more that occur earlier, and
the result does not depend on ``divisor``. Digests only find candidates: what goes was compared, byte by byte, with
the first copy. (Two chunks of different bytes and equal 128-bit digests would both stay, uncut at level 2.)

Defined results: null text stays null and has no lines; "" has one empty line, never removed; null doc_id sorts last;
rows of one doc_id with different texts are ordered by the hash of the text; rows that repeat doc_id and text get
equal results; lines end at "\n" alone, "\r" and blank lines are ordinary; an empty table gives an empty result;
further columns are carried through, whatever their names (own columns carry the prefix ``__l_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise
from .columns import apart

DIVISOR = 4
MIN_LINES = 2
_P = "__l_"
_LAST = (1 << 63) - 1


def _hash(x: Column) -> Column:
    """60 bits of md5: SQL engines can repeat it."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it and wherever the optimizer puts it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ord(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.lit(_LAST))


def _digest(lines: Column, start: Column, n: Column) -> list[Column]:
    part = F.slice(lines, start + 1, n)
    return [F.xxhash64(part).alias("d1"), F.xxhash64(F.lit(1), part).alias("d2")]


def _chunks(text: Column, divisor: int, min_lines: int) -> Column:
    """array<struct<s, n, d1, d2, w>>: first line, number of lines and digest of each chunk with the lines before it, and
    in ``w`` the digests of its windows of ``min_lines`` lines; chunks without a window are left out."""

    def windows(lines: Column, c: Column) -> Column:
        starts = F.sequence(c["s"], c["s"] + c["n"] - min_lines)
        return F.transform(starts, lambda i: F.struct(*_digest(lines, i, F.lit(min_lines))))

    def cut(lines: Column, ends: Column) -> Column:
        start = lambda k: F.greatest(F.coalesce(F.get(ends, k - 1), F.lit(-1)) + 2 - min_lines, F.lit(0))
        spans = F.transform(
            F.sequence(F.lit(0), F.size(ends) - 1),
            lambda k: F.struct(start(k).alias("s"), (F.get(ends, k) - start(k) + 1).alias("n")),
        )
        return F.transform(
            F.filter(spans, lambda c: c["n"] >= min_lines),
            lambda c: F.struct(c["s"].alias("s"), c["n"].alias("n"), *_digest(lines, c["s"], c["n"]), windows(lines, c).alias("w")),
        )

    def ends(hashes: Column) -> Column:
        last = F.size(hashes) - 1
        short = lambda i: F.coalesce(F.get(hashes, i), F.lit(0))
        return F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == last) | (F.pmod(short(i) * 31 + short(i - 1), F.lit(divisor)) == 0),
        )

    def of(lines: Column) -> Column:
        hashed = F.transform(lines, lambda x: F.pmod(F.xxhash64(x), F.lit(1000003)))
        return _let(hashed, lambda h: _let(ends(h), lambda e: cut(lines, e)))

    return _let(F.split(text, "\n"), of)


def _often(rows: DataFrame) -> DataFrame:
    """Digests that occur more than once: partial counts, one narrow shuffle."""
    return rows.groupBy("d1", "d2").agg(F.count("*").alias("times")).where("times > 1").select("d1", "d2")


def _candidates(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """(__l_ord, __l_h, __l_at): for each document that has any, its chunks of both levels (s: first line, n: how many) whose digests
    repeat. ``__l_ord`` is doc_id with null last, ``__l_h`` the hash of the text. Only digests travel here."""
    docs = docs.where("text IS NOT NULL").select(_ord(docs).alias("ord"), _hash(docs["text"]).alias("h"), "text")
    place = F.struct("ord", "h", "s")
    cuts = materialise(docs.select("ord", "h", F.explode(_chunks(docs["text"], divisor, min_lines)).alias("c")).select("ord", "h", "c.*"), "line-cuts")
    copies = materialise(cuts.drop("w").join(_often(cuts), ["d1", "d2"], "left_semi"), "line-copies")
    least = copies.groupBy("d1", "d2").agg(F.min(place).alias("least"))
    once = cuts.join(least, ["d1", "d2"], "left").where(F.col("least").isNull() | (place <= F.col("least")))
    fine = once.select("ord", "h", "s", F.posexplode("w").alias("i", "w")).select(
        "ord", "h", (F.col("s") + F.col("i")).alias("s"), F.lit(min_lines).alias("n"), "w.d1", "w.d2"
    )
    fine = materialise(fine, "line-windows")
    spans = copies.unionByName(fine.join(_often(fine), ["d1", "d2"], "left_semi"))
    own = [F.col(c).alias(_P + c) for c in ("ord", "h")]
    at = materialise(spans.groupBy(*own).agg(F.collect_set(F.struct("s", "n", "d1", "d2")).alias(_P + "at")), "line-at")
    discard(cuts, copies, fine)
    return at


def _repeated(some: DataFrame) -> DataFrame:
    """(__l_ord, __l_h, __l_spans): the spans of lines that occur earlier, of documents with candidates ``__l_at``.

    Each candidate is compared with the first copy of its bytes, one row per distinct chunk, so that a chunk held by a
    third of all documents meets one row. Candidates are written before that join, which can so split a hot digest.
    """
    p = _P
    place = F.struct(p + "ord", p + "h", "s")
    body = lambda ls, x: F.array_join(F.slice(ls, x["s"] + 1, x["n"]), "\n")
    bodies = _let(F.split("text", "\n"), lambda ls: F.transform(p + "at", lambda x: F.struct(*[x[c].alias(c) for c in ("s", "n", "d1", "d2")], body(ls, x).alias("body"))))
    held = materialise(some.select(p + "ord", p + "h", F.explode(bodies).alias("x")).select(p + "ord", p + "h", "x.*"), "line-held")
    firsts = materialise(held.groupBy("d1", "d2", F.col("body").alias("first_body")).agg(F.min(place).alias("first")), "line-firsts")
    later = held.join(firsts, ["d1", "d2"]).where((F.col("body") == F.col("first_body")) & (place > F.col("first")))
    dead = materialise(later.groupBy(p + "ord", p + "h").agg(F.collect_set(F.struct("s", "n")).alias(p + "spans")), "line-dead")
    discard(held, firsts)
    return dead


def marked(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with ``__l_lines``, ``__l_dead`` (numbers of removed lines) and ``__l_text`` (what stays).

    All texts are shuffled once, to their candidates, and written in two parts; only those with candidates are read
    for the comparison and shuffled again to its result.
    """
    p = _P
    at = _candidates(docs, divisor, min_lines)
    key = (_ord(docs) == at[p + "ord"]) & (_hash(docs["text"]) == at[p + "h"])
    texts = materialise(docs.join(at, key, "left").withColumn(p + "some", F.col(p + "at").isNotNull()), "line-texts", (p + "some",))
    discard(at)
    some, rest = (texts.where(x).drop(p + "some") for x in (F.col(p + "some"), ~F.col(p + "some")))
    judged = some.join(_repeated(some), [p + "ord", p + "h"], "left")
    numbers = F.array_distinct(F.flatten(F.transform(p + "spans", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1))))
    both = judged.unionByName(rest.withColumn(p + "spans", F.lit(None).cast(judged.schema[p + "spans"].dataType)))
    return _without(both, numbers).drop(p + "at", p + "spans")


def _without(df: DataFrame, numbers: Column) -> DataFrame:
    """df with the lines of its texts, the numbers of those that go, and the text that stays."""
    p = _P
    df = df.withColumns({p + "lines": F.split("text", "\n"), p + "dead": F.coalesce(numbers, F.array().cast("array<int>"))})
    left = F.array_except(F.sequence(F.lit(0), F.size(p + "lines") - 1), p + "dead")
    kept = F.when(F.size(p + "lines") > 0, F.transform(left, lambda k: F.get(p + "lines", k)))
    return df.withColumns({p + "text": F.when(F.size(p + "dead") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))}).drop(p + "ord", p + "h")


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the repeated passages taken out of text (and n_chars brought up to date, where there is one).

    Documents that lose everything go.
    """
    return apart(docs, _P, lambda d: _shortened(d, divisor, min_lines))


def _shortened(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    p = _P
    df = marked(docs, divisor, min_lines).where((F.size(p + "dead") == 0) | (F.length(p + "text") > 0))
    n = F.length(p + "text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    changed = {"text": F.col(p + "text"), "n_chars": F.when(F.size(p + "dead") == 0, F.col("n_chars")).otherwise(n) if n is not None else None}
    return df.select(*[changed[c].alias(c) if changed.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])


def _pairs(text: Column, value) -> Column:
    """value(line, next line) of each line that has a next one."""
    pairs = lambda ls: F.transform(F.sequence(F.lit(0), F.size(ls) - 2), lambda i: value(F.get(ls, i), F.get(ls, i + 1)))
    return _let(F.split(text, "\n"), lambda ls: F.when(F.size(ls) > 1, pairs(ls)))


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """(ord, h, dead): for each document that has any, the first lines of the pairs of lines that occur earlier.

    As ``repeated_chunks``, but digests travel without bytes first, since each line is in two pairs: only the
    documents and positions of repeated digests are then read again with their bytes.
    """
    docs = docs.select(F.coalesce("doc_id", F.lit(_LAST)).alias("ord"), F.xxhash64("text").alias("h"), "text")
    digests = _pairs(docs["text"], lambda a, b: F.struct(F.xxhash64(a, b).alias("d1"), F.xxhash64(F.lit(1), a, b).alias("d2")))
    ids = docs.select("ord", "h", F.posexplode(digests).alias("i", "d")).select("ord", "h", "i", "d.d1", "d.d2")
    often = ids.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2")
    at = ids.join(often, ["d1", "d2"], "left_semi").groupBy("ord", "h").agg(F.collect_set(F.struct("i", "d1", "d2")).alias("at"))
    at = at.select(F.col("ord").alias("o"), F.col("h").alias("g"), "at")
    two = lambda ls: F.transform("at", lambda x: F.struct(x["i"].alias("i"), x["d1"].alias("d1"), x["d2"].alias("d2"), F.concat_ws("\n", F.get(ls, x["i"]), F.get(ls, x["i"] + 1)).alias("body")))
    met = docs.join(at, (docs["ord"] == at["o"]) & (docs["h"] == at["g"]))
    held = materialise(met.select("ord", "h", F.explode(_let(F.split("text", "\n"), two)).alias("x")).select("ord", "h", "x.*"), "line-pairs")
    firsts = materialise(held.groupBy("d1", "d2", F.col("body").alias("first_body")).agg(F.min(F.struct("ord", "i")).alias("first")), "line-firsts")
    dead = held.join(firsts, ["d1", "d2"]).where((F.col("body") == F.col("first_body")) & (F.struct("ord", "i") > F.col("first")))
    return dead.groupBy("ord", "h").agg(F.collect_set("i").alias("dead"))


def run_marked(docs: DataFrame) -> DataFrame:
    """docs with ``__l_lines``, ``__l_dead`` (numbers of removed lines) and ``__l_text`` (what stays).

    The whole job, without cuts by content: a line goes where it lies in a run of two lines or more whose bytes
    occur earlier. Such a run is a chain of pairs of lines, so pairs find every run, whatever surrounds it.
    """
    p = _P
    dead = repeated_pairs(docs).select(F.col("ord").alias(p + "ord"), F.col("h").alias(p + "h"), F.col("dead").alias(p + "dead"))
    key = (F.coalesce(docs["doc_id"], F.lit(_LAST)) == dead[p + "ord"]) & (F.xxhash64(docs["text"]) == dead[p + "h"])
    both = F.array_distinct(F.flatten(F.transform(p + "dead", lambda i: F.array(i, i + 1))))
    return _without(docs.join(dead, key, "left"), both)


def _counts(df: DataFrame) -> DataFrame:
    p = _P
    return df.select(
        "doc_id",
        F.coalesce(F.size(p + "lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size(p + "dead").cast("long").alias("n_removed"),
        F.sha2(F.coalesce(p + "text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op6_line_runs(spark, sf_dir: str) -> DataFrame:
    return _counts(run_marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return _counts(marked(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rn, coalesce(doc_id, 9223372036854775807) AS ord, ('0x' || substr(md5(text), 1, 15))::BIGINT AS h,
             unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
p AS (SELECT *, lead(line) OVER (PARTITION BY rn ORDER BY i) AS after FROM l),
f AS (SELECT *, after IS NOT NULL AND (ord, h, i) > min((ord, h, i)) OVER (PARTITION BY line, after) AS dead FROM p),
g AS (SELECT *, dead OR coalesce(lag(dead) OVER (PARTITION BY rn ORDER BY i), false) AS gone FROM f),
o AS (SELECT rn, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY rn)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.rn = d.rn
"""

OP6_RUNS_SQL = """
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT rn, coalesce(doc_id, 9223372036854775807) AS ord, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM d),
p AS (SELECT *, lead(line) OVER (PARTITION BY rn ORDER BY i) AS after FROM l),
f AS (SELECT *, after IS NOT NULL AND (ord, i) > min((ord, i)) OVER (PARTITION BY line, after) AS dead FROM p),
g AS (SELECT *, dead OR coalesce(lag(dead) OVER (PARTITION BY rn ORDER BY i), false) AS gone FROM f),
o AS (SELECT rn, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
             string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY rn)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON o.rn = d.rn
"""
