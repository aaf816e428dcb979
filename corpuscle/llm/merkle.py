"""Operator 13: a Merkle manifest of a dataset, with a proof for every row.

Leaves are numbered by one range sort per tree. The tree of a language is cut into aligned blocks of ``ARITY ** height``
leaves. Going up, a treehash stack folds each block to its root, and block roots are the leaves of the next pass, until one
node a tree remains; the languages' roots then form a tree of their own. Going down, each block is traversed leaf by leaf:
per level one run of siblings is current while a treehash stack builds the run that follows it, one leaf a level and step,
so that a block's state is logarithmic in its leaves. The path above a block is the same for all its leaves; it is computed
once, by the pass over the block's own root, and appended.

Nothing larger than a block meets in one task, whatever the share of one language. Blocks are found again by (tree, block),
numbers that are written before they are used, so lost executors change nothing.

Defined results: null columns are hashed as ``-``; null lang is a tree of its own, first in order; null doc_ids come last in
their tree and are never tampered with; rows that share doc_id are ordered by their leaf, so equal rows get neighbouring
leaves and their own proofs; one leaf alone is its tree's root and has no sibling there; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import string
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship

ARITY = 8
#: Levels of a block: 8 ** 4 leaves.
HEIGHT = 4
#: Every so many-th row, by the crc32 of its doc_id, is checked against a tampered text.
TAMPER_MODULUS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def node(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """Digest of one row's values: each as its length in UTF-8 bytes, a colon and itself; null as ``-``."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def tampered(text: Column) -> Column:
    """A text whose ASCII capitals have become small."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def levels_of(n: int, arity: int = ARITY) -> int:
    """Levels of runs above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // arity), out + 1
    return out


class Treehash:
    """Folds leaves, fed in order, into nodes of ``height`` levels; keeps one unfinished run a level."""

    def __init__(self, height: int, arity: int = ARITY):
        self.arity, self.runs = arity, [[] for _ in range(height)]
        self.done: list[str] = []

    def feed(self, digest: str) -> None:
        for run in self.runs:
            run.append(digest)
            if len(run) < self.arity:
                return
            digest = node(run)
            run.clear()
        self.done.append(digest)

    def close(self) -> list[str]:
        """The nodes of the top level, the last of which may stand for fewer leaves."""
        for j, run in enumerate(self.runs):
            if run:
                digest = node(run)
                run.clear()
                if j + 1 < len(self.runs):
                    self.runs[j + 1].append(digest)
                else:
                    self.done.append(digest)
        return self.done


def block_root(leaves: list[str], height: int, arity: int = ARITY) -> str:
    stack = Treehash(height, arity)
    for digest in leaves:
        stack.feed(digest)
    return stack.close()[0]


def traverse(get: Callable[[int], str], n: int, height: int, arity: int = ARITY) -> Iterator[list[list[str]]]:
    """For each of a block's n leaves in turn, the runs that hold its ancestors, level by level from the leaves.

    get(i): the i-th leaf. The state is, for each level, the current run and the stack of the next one: no level is stored.
    """
    spans = [arity**j for j in range(height)]  # leaves below a node of level j

    def build(j: int, run: int) -> list[str]:
        stack = Treehash(j, arity)
        for i in range(run * spans[j] * arity, min(n, (run + 1) * spans[j] * arity)):
            stack.feed(get(i))
        return stack.close()

    current = [build(j, 0) for j in range(height)]
    coming = [Treehash(j, arity) for j in range(height)]
    for i in range(n):
        for j, span in enumerate(spans):
            wide = span * arity
            if i and i % wide == 0:
                current[j], coming[j] = coming[j].close(), Treehash(j, arity)
            if i + wide < n:
                coming[j].feed(get(i + wide))
        yield current


def siblings(runs: list[list[str]], i: int, arity: int = ARITY) -> tuple[list[str], list[int]]:
    """(the run's others, joined; the own place among them) by level."""
    sides, places = [], []
    for run in runs:
        k = i % arity
        sides.append("".join(run[:k] + run[k + 1 :]))
        places.append(k)
        i //= arity
    return sides, places


def fold(digest: str, sides: list[str], places: list[int]) -> str:
    for side, k in zip(sides, places):
        digest = node([side[: 64 * k], digest, side[64 * k :]])
    return digest


# Numbering -------------------------------------------------------------------------------------------------------


def ranked(rows: DataFrame, tree: list[str], order: list[Column], label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with pid and at, written in order; runs): runs has (tree, pid, first, idx, n), one row for each tree in each
    written partition: the place of its first row in the file order, that row's number in the tree, the tree's size.

    One range sort of narrow rows; a tree with most of the rows spreads over partitions like any other.
    """
    keys = [F.col(c).asc_nulls_first() for c in tree] + order
    by_range = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    written = materialise(by_range.withColumn("at", F.monotonically_increasing_id()), label).withColumn("pid", F.shiftright("at", 33))
    runs = written.groupBy(*tree, "pid").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    earlier = Window.partitionBy(*tree).orderBy("pid")
    runs = runs.withColumns({"idx": F.sum("k").over(earlier) - F.col("k"), "n": F.sum("k").over(Window.partitionBy(*tree))}).drop("k")
    return written, materialise(runs, label + "-runs")


def numbered(written: DataFrame, runs: DataFrame, tree: list[str]) -> DataFrame:
    """written with idx, n and the further columns of runs. Each pair of keys holds one written partition's rows at most."""
    r = runs.select(*[F.col(c).alias(f"r_{c}") for c in tree], F.col("pid").alias("r_pid"), F.col("idx").alias("r_idx"), *[c for c in runs.columns if c not in (*tree, "pid", "idx")])
    same = F.col("pid") == F.col("r_pid")
    for c in tree:
        same = same & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return written.join(r, same).withColumn("idx", F.col("at") - F.col("first") + F.col("r_idx")).drop("at", "pid", "first", "r_pid", "r_idx", *[f"r_{c}" for c in tree])


# Up and down -----------------------------------------------------------------------------------------------------

_NODES = "tree long, idx long, n long, node string"
_PATHS = "tree long, idx long, sides array<string>, places array<int>, subroot string, root string"


def _up(nodes: DataFrame, height: int) -> DataFrame:
    """Nodes (tree, idx, n, node) to the roots of their blocks, numbered again."""
    size = ARITY**height

    def run(key, table):
        block, n = key[1].as_py(), table["n"][0].as_py()
        leaves = table.sort_by("idx")["node"].to_pylist()
        root = block_root(leaves, min(height, levels_of(n)))
        return pa.table({"tree": [key[0]], "idx": pa.array([block], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "node": [root]})

    by_block = nodes.select("tree", "idx", "n", "node", F.floor(F.col("idx") / size).cast("long").alias("block"))
    return by_block.groupBy("tree", "block").applyInArrow(run, _NODES)


def _climb(nodes: DataFrame, height: int, label: str) -> list[DataFrame]:
    """[nodes, roots of their blocks, roots of those, ...] until every tree has one node; each is a written table."""
    out = [nodes]
    n = nodes.agg(F.max("n")).head()[0] or 0
    while n > 1:
        out.append(materialise(_up(out[-1], height), f"{label}-up"))
        n = -(-n // ARITY**height)
    return out


def _walk(table: pa.Table, above: pa.Table, height: int):
    """Rows of one block in order, each with the runs of its ancestors in the block and the one row that stands above it."""
    table = table.sort_by("idx")
    digests, n = table["node"].to_pylist(), table["n"][0].as_py()
    upper = above.to_pylist()[0]
    runs = traverse(digests.__getitem__, len(digests), min(height, levels_of(n)))
    return table, digests, upper, runs


def _down(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """Paths of nodes, from those of their blocks' roots."""

    def run(key, table, paths):
        table, _, upper, walk = _walk(table, paths, height)
        sides, places = [], []
        for i, runs in enumerate(walk):
            s, p = siblings(runs, i)
            sides.append(s + upper["sides"])
            places.append(p + upper["places"])
        m = len(sides)
        return pa.table(
            {
                "tree": table["tree"], "idx": table["idx"], "sides": pa.array(sides, pa.list_(pa.string())), "places": pa.array(places, pa.list_(pa.int32())),
                "subroot": pa.array([upper["subroot"]] * m, pa.string()), "root": pa.array([upper["root"]] * m, pa.string()),
            }
        )

    return _by_block(nodes, height).cogroup(_paths(above)).applyInArrow(run, _PATHS)


def _paths(above: DataFrame):
    own = above.select(F.col("tree").alias("p_tree"), F.col("idx").alias("p_idx"), "sides", "places", "subroot", "root")
    return own.groupBy("p_tree", "p_idx")


def _by_block(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.floor(F.col("idx") / ARITY**height).cast("long")).groupBy("tree", "block")


_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(leaves: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """The proof of every leaf, folded from the tampered leaf where there is one."""

    def run(key, table, paths):
        table, digests, upper, walk = _walk(table, paths, height)
        changed = table["changed"].to_pylist()
        proofs, folded = [], []
        for i, runs in enumerate(walk):
            sides, places = siblings(runs, i)
            sides, places = sides + upper["sides"], places + upper["places"]
            proofs.append(node(sides))
            folded.append(fold(changed[i] or digests[i], sides, places))
        m, root = len(proofs), upper["root"]
        return pa.table(
            {
                "doc_id": table["doc_id"], "leaf": table["node"], "subroot": pa.array([upper["subroot"]] * m, pa.string()), "root": pa.array([root] * m, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
            }
        )

    return _by_block(leaves, height).cogroup(_paths(above)).applyInArrow(run, _PROOFS)


def manifest(docs: DataFrame, height: int = HEIGHT, modulus: int = TAMPER_MODULUS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    height: levels of a block; changes the work's shape, not its result. modulus: rows whose crc32 it divides are folded
    from their tampered text.
    """
    ship(docs.sparkSession)
    doc = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long"), F.col("text")]
    hit = (F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % modulus == 0) & (tampered(F.col("text")) != F.col("text"))
    # The only pass over the texts; all that follows moves digests.
    rows = materialise(
        docs.select(F.col("lang").alias("lang"), doc[0].alias("doc_id"), leaf(*doc).alias("node"), F.when(hit, leaf(*doc[:4], tampered(F.col("text")))).alias("changed")), "merkle-leaves"
    )
    written, runs = ranked(rows, ["lang"], [F.col("doc_id").asc_nulls_last(), F.col("node")], "merkle-order")
    # Languages in order: the number of a language is its tree's and its leaf's in the tree of languages.
    langs, order = ranked(runs.select("lang").distinct().withColumn("all", F.lit(0)), ["all"], [F.col("lang").asc_nulls_first()], "merkle-langs")
    langs = numbered(langs, order, ["all"]).select(F.col("lang").alias("tree_lang"), F.col("idx").alias("tree"), F.col("n").alias("n_trees"))
    runs = materialise(runs.join(langs, F.col("lang").eqNullSafe(F.col("tree_lang"))).drop("tree_lang", "n_trees"), "merkle-trees")
    leaves = materialise(numbered(written, runs, ["lang"]).select("tree", "idx", "n", "node", "changed", "doc_id"), "merkle-numbered")
    climb = _climb(leaves, height, "merkle")
    subroots = climb[-1].select("tree", "node").join(langs.select("tree", "n_trees"), "tree")
    top = _climb(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("n_trees").alias("n"), "node"), height, "merkle-top")
    # The root stands above nothing; from there down.
    none = lambda t: F.array().cast(t)
    above = top[-1].select("tree", "idx", none("array<string>").alias("sides"), none("array<int>").alias("places"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    for below in reversed(top[:-1]):
        above = materialise(_down(below, above, height), "merkle-down")
    path = above.select(F.col("idx").alias("p_tree"), "sides", "places", "root")
    above = climb[-1].join(path, F.col("tree") == F.col("p_tree")).select("tree", "idx", "sides", "places", F.col("node").alias("subroot"), "root")
    for below in reversed(climb[1:-1]):
        above = materialise(_down(below, above, height), "merkle-down")
    if len(climb) == 1:  # every tree is one leaf: each is its own block, without levels
        return _prove(leaves, above, 0)
    return _prove(leaves, above, height)


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS))


# SQL -------------------------------------------------------------------------------------------------------------

#: Levels that the SQL writes out: 8 ** 7 leaves a tree.
_SQL_LEVELS = 7


def _crc_step(x: int) -> int:
    for _ in range(4):
        x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return x


def _sql_crc(text: str) -> str:
    """crc32 of an ASCII string, by nibbles."""
    table = "[" + ", ".join(f"{_crc_step(i)}::BIGINT" for i in range(16)) + "]"
    nibbles = f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda c: [(ascii(c) & 15)::BIGINT, (ascii(c) >> 4)::BIGINT]))"
    step = f"xor(xor(c, x) >> 4, {table}[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {nibbles}), lambda c, x: {step}), 4294967295::BIGINT)"


def _sql() -> str:
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    own = [field("doc_id::VARCHAR"), field("source"), field("lang"), field("n_chars::VARCHAR")]
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        f"""d AS (SELECT doc_id, lang, sha256({' || '.join([*own, field('text')])}) AS leaf,
CASE WHEN {_sql_crc('doc_id::VARCHAR')} % 3 = 0 THEN sha256({' || '.join([*own, field(low)])}) END AS changed FROM documents)""",
        "i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i FROM d)",
        "n0 AS (SELECT lang, i AS k, leaf AS h FROM i)",
    ]

    def climb(prefix: str, key: str):
        for j in range(_SQL_LEVELS):
            group = f"{key + ', ' if key else ''}k // 8"
            over = f"PARTITION BY {key}" if key else ""
            parts.append(f"{prefix}r{j} AS (SELECT {key + ', ' if key else ''}k // 8 AS k, list(h ORDER BY k) AS hs, any_value(c) AS c FROM (SELECT *, count(*) OVER ({over}) AS c FROM {prefix}n{j}) GROUP BY {group})")
            parts.append(f"{prefix}n{j + 1} AS (SELECT {key + ', ' if key else ''}k, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {prefix}r{j})")

    climb("", "lang")
    parts.append(f"s AS (SELECT lang, h AS subroot FROM n{_SQL_LEVELS}), o AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM s)")
    parts.append("tn0 AS (SELECT t AS k, subroot AS h FROM o)")
    climb("t", "")
    # f: the folded digest so far; p: the siblings so far.
    parts.append("f0 AS (SELECT i.*, o.t, o.subroot, coalesce(changed, leaf) AS f, '' AS p FROM i JOIN o ON i.lang IS NOT DISTINCT FROM o.lang)")
    for j in range(2 * _SQL_LEVELS):
        low_half = j < _SQL_LEVELS
        at, level = ("i", j) if low_half else ("t", j - _SQL_LEVELS)
        run = f"{'' if low_half else 't'}r{level}"
        same = f"r.k = f.{at} // {8 ** (level + 1)}" + (" AND r.lang IS NOT DISTINCT FROM f.lang" if low_half else "")
        place = f"(f.{at} // {8 ** level}) % 8"
        before, after = f"array_to_string(hs[1:{place}], '')", f"array_to_string(hs[{place} + 2:], '')"
        parts.append(f"f{j + 1} AS (SELECT f.* EXCLUDE (f, p), CASE WHEN c > 1 THEN sha256({before} || f || {after}) ELSE f END AS f, CASE WHEN c > 1 THEN p || {before} || {after} ELSE p END AS p FROM f{j} f JOIN {run} r ON {same})")
    return (
        "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, (SELECT h FROM tn{_SQL_LEVELS}) AS root, sha256(p) AS proof_sha256, f AS folded_root, f = (SELECT h FROM tn{_SQL_LEVELS}) AS verified FROM f{2 * _SQL_LEVELS}"""
    )


OP13_SQL = _sql()
