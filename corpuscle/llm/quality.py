r"""Operator 10: quality rules with host-level verdicts, in DataFrame functions only.

Every document is judged by rules of its own; the failures are summed per host (here the ``source``
column), each host's failure rate is shrunk towards an empirical beta prior fitted over all hosts by
moments, and the host verdict is joined back. The moments are those of a beta-binomial: hosts count by
their documents, and the variance that mere counting causes is taken off, so that hosts of few documents
are drawn to the mean and only what hosts really differ by keeps them from it.

Defined results: null or empty text has no words and fails the base rule; null doc_id and null source
are ordinary values (null sources form one host); repeated rows are judged alike, each for itself; a
single host has the mean as its rate; an empty table gives an empty result; further columns are carried
through untouched, whatever their names (own columns carry the prefix ``__q_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .columns import apart
from .words import words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: A host whose shrunk failure rate is above this loses all its documents.
HOST_LIMIT = 0.5
#: A document that fails a soft rule goes too if its host's shrunk rate reaches the mean over all documents, but for rounding.
ROUNDING = 1e-9
WINDOW = 5
SYMBOLS = "#*$%&|<>"
_POS_BITS = 12
_PRE = "__q_"


def _repeat_words(w: Column, grams: Column, hash_at, pos_at) -> Column:
    """Words covered by 5-word windows that occur at least twice.

    ``grams`` is the array of (hash, position) of all windows, sorted. Neighbours with equal hashes are compared word by
    word; if any such pair differs (a hash collision) the exact quadratic form is used instead.
    """
    window = lambda p: F.slice(w, p + 1, WINDOW)
    pairs = F.filter(F.sequence(F.lit(0), F.size(grams) - 2), lambda i: hash_at(i) == hash_at(i + 1))
    collided = F.exists(pairs, lambda i: window(pos_at(i)) != window(pos_at(i + 1)))
    fast = F.flatten(F.transform(pairs, lambda i: F.array(pos_at(i), pos_at(i + 1))))
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    slow = F.filter(starts, lambda p: F.exists(starts, lambda q: (q != p) & (window(p) == window(q))))
    hit = F.array_sort(F.array_distinct(F.when(collided, slow).otherwise(fast)))
    ends = F.aggregate(
        hit,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(grams) >= 2, ends).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rule inputs in columns of prefix ``__q_``; every text is read whole, once."""
    p = _PRE
    body = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({p + "w": words(F.col(text))})
    df = df.withColumns({p + "wh": F.transform(p + "w", lambda x: F.xxhash64(x))})
    gram = lambda i: F.xxhash64(*[F.get(F.col(p + "wh"), i + k) for k in range(WINDOW)])
    n = F.size(p + "w")
    at = F.sequence(F.lit(0), n - WINDOW)
    # Position and hash share a long, which sorts fast; texts with more windows keep them apart.
    small = (n >= WINDOW) & (n <= 1 << _POS_BITS)
    packed = F.sort_array(F.transform(at, lambda i: F.shiftleft(gram(i), _POS_BITS).bitwiseOR(i.cast("long"))))
    apart = F.sort_array(F.transform(at, lambda i: F.struct(gram(i).alias("h"), i.alias("p"))))
    df = df.withColumns({p + "g": F.when(small, packed), p + "long": F.when(n > 1 << _POS_BITS, apart)})
    g, big = F.col(p + "g"), F.col(p + "long")
    mask = (1 << _POS_BITS) - 1
    in_small = _repeat_words(F.col(p + "w"), g, lambda i: F.shiftright(F.get(g, i), _POS_BITS), lambda i: F.get(g, i).bitwiseAND(F.lit(mask)).cast("int"))
    in_big = _repeat_words(F.col(p + "w"), big, lambda i: F.get(big, i)["h"], lambda i: F.get(big, i)["p"])
    repeat = F.when(big.isNotNull(), in_big).when(g.isNotNull(), in_small).otherwise(F.lit(0).cast("long"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.regexp_replace(x, r"[\x20\x09-\x0D]+", "")) > 0)
    df = df.withColumns({p + "lines": lines})
    df = df.withColumns(
        {
            p + "n_words": F.size(p + "w").cast("long"),
            p + "word_chars": F.length(F.array_join(p + "w", "")).cast("long"),
            p + "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
            p + "n_lines": F.size(p + "lines").cast("long"),
            p + "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"),
            p + "n_repeat_words": repeat,
        }
    )
    n = F.col(p + "n_words")
    return df.withColumns(
        {
            p + "base": (n < MIN_WORDS) | (100 * F.col(p + "n_repeat_words") > MAX_REPEAT_PERCENT * n),
            p + "soft": (100 * F.col(p + "n_symbols") > MAX_SYMBOL_PERCENT * n)
            | (100 * F.col(p + "n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col(p + "n_lines")),
        }
    ).drop(*[p + c for c in ("w", "wh", "g", "long", "lines")])


def host_rates(feats: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: its failure rate shrunk by the beta prior that fits all hosts, and the prior's mean.

    The prior comes from one row of sums over hosts, so only that row is joined to the hosts. It is kept as mean and
    ``rho`` = 1 / (a + b + 1), the part of a document's variance that is its host's: 0 where hosts differ no more than
    by chance (all get the mean), 1 where they are all or nothing (each keeps its own rate).
    """
    p = _PRE
    fail = (F.col(p + "base") | F.col(p + "soft")).cast("long")
    hosts = feats.groupBy(F.col(host).alias(p + "host")).agg(F.count("*").alias("n"), F.sum(fail).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    sums = hosts.agg(F.count("*").alias("h"), F.sum(n).alias("sn"), F.sum(k).alias("sk"), F.sum(n * n).alias("nn"), F.sum(k * k / n).alias("kk"))
    mean = F.col("sk") / F.col("sn")
    spread, chance = F.col("kk") - F.col("sk") * mean, mean * (1 - mean)
    scale = chance * (F.col("sn") - F.col("nn") / F.col("sn") - (F.col("h") - 1))
    rho = F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (spread - chance * (F.col("h") - 1)) / scale))).otherwise(F.lit(0.0))
    prior = sums.select(mean.alias(p + "mean"), rho.alias("rho"))
    rate = (F.col("rho") * k + (1 - F.col("rho")) * F.col(p + "mean")) / (F.col("rho") * n + (1 - F.col("rho")))
    return hosts.crossJoin(F.broadcast(prior)).select(p + "host", p + "mean", rate.alias(p + "rate"))


def judged(feats: DataFrame, host: str = "source", rates: DataFrame | None = None) -> DataFrame:
    """feats with ``__q_kept``: the base rule and the host's verdict; rates: those of host_rates(), if they are written already.

    The joined side has one row per host; Spark broadcasts it only below its size threshold and otherwise splits a
    skewed host's documents.
    """
    p = _PRE
    rates = host_rates(feats, host) if rates is None else rates
    poor = F.col(p + "rate") + ROUNDING >= F.col(p + "mean")
    rejected = F.col(p + "base") | (F.col(p + "rate") > HOST_LIMIT) | (F.col(p + "soft") & poor)
    rows = feats.join(rates, feats[host].eqNullSafe(rates[p + "host"]), "left")
    return rows.withColumn(p + "kept", ~F.coalesce(rejected, F.lit(False))).drop(p + "host", p + "mean")


def judge(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """All rows and columns of docs with the rule inputs, ``base_failed`` and ``kept`` (prefix ``__q_``).

    The rule inputs are written once to the shared folder, since both the host sums and the verdicts read them; so are the
    hosts' rates, whose size Spark then knows before it would shuffle the texts for the join.
    """
    feats = materialise(features(docs, text), "quality")
    return judged(feats, host, materialise(host_rates(feats, host), "quality-hosts"))


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    return apart(docs, _PRE, lambda d: judge(d, host).where(F.col(_PRE + "kept")).select(*[F.col(f"`{c}`") for c in d.columns]))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    p = _PRE
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = judged(materialise(features(docs).drop("text"), "quality"))
    return rows.select(
        "doc_id",
        *[F.col(p + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(p + "base").alias("base_failed"),
        F.col(p + "kept").alias("kept"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, source, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
g AS (SELECT rn, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram
      FROM (SELECT rn, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM d WHERE len(ws) >= 5)),
r AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rn, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 5)) AS k) GROUP BY rn),
f AS (
  SELECT d.rn, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN c ON c.rn = d.rn),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS soft FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR soft)::INT)::DOUBLE AS k FROM b GROUP BY source),
m AS (SELECT count(*) AS h, sum(n) AS sn, sum(k) AS sk, sum(n * n) AS nn, sum(k * k / n) AS kk, sum(k) / sum(n) AS m FROM h),
v AS (SELECT m, CASE WHEN m * (1 - m) * (sn - nn / sn - (h - 1)) > 0
      THEN greatest(0.0, least(1.0, (kk - sk * m - m * (1 - m) * (h - 1)) / (m * (1 - m) * (sn - nn / sn - (h - 1))))) ELSE 0.0 END AS rho FROM m),
s AS (SELECT source, m, (rho * k + (1 - rho) * m) / (rho * n + (1 - rho)) AS rate FROM h, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR rate > 0.5 OR (soft AND rate + 1e-9 >= m)) AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source
"""
