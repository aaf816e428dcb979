"""Operator 4: near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length one, so that a cosine of ``limit`` is a distance of epsilon = sqrt(2 - 2 * limit). They
are projected to their leading principal dimensions (of all vectors, from sums of products) and cut into a grid of
cells of side epsilon there; a projection never lengthens a distance, so vectors whose cells differ by more than one
in any of these dimensions are not linked. Sorted by label and grid order, the vectors become a sequence of blocks
with bounding boxes. Pairs of blocks that are not provably distant are joined recursively: an interval pair splits in
halves, halves whose boxes are further apart than epsilon are skipped, and leaves are compared exactly. Block pairs
are dealt out by the intervals of GROUP blocks that they lie in, so that a block travels once to each pair of
intervals and not once to each partner.

No pair of vectors is ever emitted: each pair of intervals yields the number of links of each of its vectors and a
spanning forest of the links, which keeps every component whole. Equal vectors of one label fold to one row with a
count. Vectors are scaled by powers of two, which is exact, so that very small or large components neither vanish nor
overflow.

Defined results: null, zero, and not finite vectors, and rows with a null label, link with nothing, nor do vectors of
different lengths; rows that repeat vec_id are vectors of their own, each in the component of its own links; a null
vec_id is never a component's least one: such a row is not kept if its component has a vec_id, else it has
component_id null and is kept; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .components import components
from .workers import frugal

LIMIT = 0.98
LEAD = 6  # principal dimensions of the grid
BLOCK = 512
LEAF = 64
#: Blocks of an interval, or as many as hold GROUP_BYTES of vectors.
GROUP = 16
GROUP_BYTES = 16_000_000
#: Keeps rounding in the projections from hiding a link.
SLACK = 1e-6


def _array(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors, each scaled by the power of two that brings its largest component to between 1/2 and 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0, keepdims=True))[1])


def _groups(batch):
    """(dim, rows) of a batch by its column ``dim``."""
    dims = batch.column("dim").to_numpy()
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _moments(batches):
    """(dim, n, one, two): number, sum and sum of products of the unit vectors of each length."""
    total: dict[int, list] = {}
    for batch in batches:
        for d, rows in _groups(batch):
            x = _array(batch.column("v").take(pa.array(rows)), d)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            have = total.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            have[0] += len(x)
            have[1] += x.sum(0)
            have[2] += x.T @ x
    yield from _moment_rows(total)


def _moment_rows(total):
    for d, (n, one, two) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d], pa.int64()), pa.array([n], pa.int64()), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (one, two))], ["dim", "n", "one", "two"]
        )


def _add_moments(batches):
    """Rows of _moments to one row for each vector length."""
    total: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dim"]
            have = total.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
            have[0] += row["n"]
            have[1] += np.frombuffer(row["one"])
            have[2] += np.frombuffer(row["two"]).reshape(d, d)
    yield from _moment_rows(total)


def principal_axes(vectors: DataFrame, lead: int = LEAD) -> dict[int, np.ndarray]:
    """For each vector length the leading principal axes of all vectors of that length.

    The matrices are summed by the executors in two rounds; what reaches the driver is one for each length.
    """
    schema = "dim long, n long, one binary, two binary"
    parts = vectors.select("dim", "v").mapInArrow(frugal(_moments), schema)
    sums = parts.repartition(32).mapInArrow(frugal(_add_moments), schema).repartition("dim").mapInArrow(frugal(_add_moments), schema)
    axes = {}
    for row in sums.toArrow().to_pylist():
        d, count = row["dim"], row["n"]
        mean = np.frombuffer(row["one"]) / count
        second = np.frombuffer(row["two"]).reshape(d, d) / count
        _, vectors_ = np.linalg.eigh(second - np.outer(mean, mean))
        axes[d] = np.ascontiguousarray(vectors_[:, ::-1][:, : min(lead, d)])
    return axes


def _cells(axes, epsilon, lead):
    """Adds the grid cells of each vector: array<int> of ``lead`` numbers."""

    def run(batches):
        table = axes.value
        for batch in batches:
            cells = np.zeros((batch.num_rows, lead), np.int32)
            for d, rows in _groups(batch):
                x = _array(batch.column("v").take(pa.array(rows)), d)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ table[d]
                cells[rows[:, None], np.arange(y.shape[1])] = np.floor(y / epsilon)
            out = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, lead, dtype=np.int32)), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "cells"])

    return run


def _pack(axes, block):
    """Rows in grid order to blocks: (block, label, dim, lo, hi, ids, counts, data): the box of the projections, and
    the block's vectors as bytes."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        table, seq = axes.value, 0
        held, size = [], 0

        def emit(rows):
            nonlocal seq
            t = pa.Table.from_batches(rows).combine_chunks()
            key = np.stack([t["label"].to_numpy(), t["dim"].to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                d = int(key[s, 1])
                x = _array(t["v"].combine_chunks().slice(s, e - s), d)
                y = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ table[d]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part << 32 | seq], pa.int64()),
                        pa.array([int(key[s, 0])], pa.int64()),
                        pa.array([d], pa.int64()),
                        pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                        pa.array([y.max(0).tolist()], pa.list_(pa.float64())),
                        pa.array([t["node"].to_numpy()[s:e].tobytes()], pa.binary()),
                        pa.array([t["copies"].to_numpy()[s:e].tobytes()], pa.binary()),
                        pa.array([x.astype("<f8").tobytes()], pa.binary()),
                    ],
                    ["block", "label", "dim", "lo", "hi", "ids", "counts", "data"],
                )
                seq += 1

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(block - size, batch.num_rows - at)
                held.append(batch.slice(at, take))
                size, at = size + take, at + take
                if size == block:
                    yield from emit(held)
                    held, size = [], 0
        if held:
            yield from emit(held)

    return run


class Joiner:
    """Joins two sequence intervals of one grid order."""

    def __init__(self, axes: np.ndarray, limit: float):
        self.axes, self.limit = axes, limit
        self.epsilon = np.sqrt(2 - 2 * limit) + SLACK

    def prepare(self, x: np.ndarray):
        length = np.linalg.norm(x, axis=1)
        return x, length, (x / length[:, None]) @ self.axes

    def _apart(self, a, b) -> bool:
        gap = np.maximum(0, np.maximum(a.min(0) - b.max(0), b.min(0) - a.max(0)))
        return bool(gap @ gap > self.epsilon**2)

    def pairs(self, a, b, same: bool):
        """Yields index arrays (i, j) of links between a and b; each pair once if both are the same interval."""
        stack = [(0, len(a[0]), 0, len(b[0]))]
        while stack:
            s, e, p, q = stack.pop()
            if s >= e or p >= q or (same and q <= s) or self._apart(a[2][s:e], b[2][p:q]):
                continue
            if e - s > LEAF or q - p > LEAF:
                m, n = (s + e) // 2, (p + q) // 2
                if e - s <= LEAF:
                    stack += [(s, e, p, n), (s, e, n, q)]
                elif q - p <= LEAF:
                    stack += [(s, m, p, q), (m, e, p, q)]
                else:
                    stack += [(s, m, p, n), (s, m, n, q), (m, e, p, n), (m, e, n, q)]
                continue
            cosine = (a[0][s:e] @ b[0][p:q].T) / (a[1][s:e, None] * b[1][None, p:q])
            i, j = np.nonzero(cosine >= self.limit)
            i, j = i + s, j + p
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray):
    """Positions of links that join all that the links (i, j) join: a spanning forest."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    # Links of one vector first make stars, which are cheap to follow.
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, np.int64)


def _join(axes, limit):
    """Rows (ix, iy, block, dim, ids, counts, data, pairs), sorted, to rows (kind, a, b): kind 0 has node a with b links,
    kind 1 a link of nodes of the forest. The row of a pair of intervals (and length) without block lists its pairs of
    blocks."""

    def group(rows):
        pairs, held = [], {}
        for row in rows:
            if row["block"] is None:
                pairs += [(row["dim"], x["block_x"], x["block_y"]) for x in row["pairs"]]
            else:
                held[row["block"]] = row
        joiners = {d: Joiner(axes.value[d], limit) for d in {p[0] for p in pairs}}
        ids, counts, at, ready = [], [], {}, {}
        for block, row in held.items():
            at[block] = sum(map(len, ids))
            ids.append(np.frombuffer(row["ids"], "<i8")), counts.append(np.frombuffer(row["counts"], "<i8"))
            ready[block] = joiners[row["dim"]].prepare(np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"]))
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        links = np.zeros(len(ids), np.int64)
        us, vs = [], []
        for d, x, y in pairs:
            found = [(i + at[x], j + at[y]) for i, j in joiners[d].pairs(ready[x], ready[y], x == y)]
            if not found:
                continue
            i, j = (np.concatenate(k) for k in zip(*found))
            np.add.at(links, i, counts[j])
            np.add.at(links, j, counts[i])
            k = _forest(len(ids), i, j)
            us.append(i[k]), vs.append(j[k])
        if not us:
            return None
        i, j = np.concatenate(us), np.concatenate(vs)
        k = _forest(len(ids), i, j)
        x = np.flatnonzero(links)
        kind = np.concatenate([np.zeros(len(x), np.int64), np.ones(len(k), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([ids[x], ids[i[k]]])), pa.array(np.concatenate([links[x], ids[j[k]]]))], ["kind", "a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(k)[r].as_py() for k, c in enumerate(batch.schema.names)}
                if at is not None and at != (row["ix"], row["iy"]):
                    if (out := group(held)) is not None:
                        yield out
                    held = []
                at = row["ix"], row["iy"]
                held.append(row)
        if held and (out := group(held)) is not None:
            yield out

    return run


def near_vectors(rows: DataFrame, limit: float = LIMIT, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    ship(spark)
    epsilon = float(np.sqrt(2 - 2 * limit) + SLACK)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    fit = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & sound, F.lit(False))
    tagged = rows.withColumn("key", F.when(fit, F.sha2(F.concat_ws(",", "label", F.transform("v", lambda x: F.hex(F.encode((x + F.lit(0.0)).cast("string"), "utf-8")))), 256)))
    # Equal vectors of a label are one node, named by the least vec_id; null vec_ids only after all others.
    folded = tagged.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    folded = materialise(folded.withColumns({"node": F.xxhash64("key"), "dim": F.size("v").cast("long")}), "ego-vectors")
    axes = spark.sparkContext.broadcast(principal_axes(folded, lead))
    schema = "node long, copies long, label long, dim long, v array<double>"
    cells = folded.select("node", "copies", "label", "dim", "v").mapInArrow(frugal(_cells(axes, epsilon, lead)), schema + ", cells array<int>")
    grid = [F.col("cells")[k] for k in range(lead)]
    ordered = cells.repartitionByRange("label", "dim", *grid, "node").sortWithinPartitions("label", "dim", *grid, "node")
    blocks = ordered.drop("cells").mapInArrow(
        frugal(_pack(axes, block)), "block long, label long, dim long, lo array<double>, hi array<double>, ids binary, counts binary, data binary"
    )
    blocks = materialise(blocks, "ego-blocks")
    pairs = materialise(block_pairs(blocks, epsilon), "ego-block-pairs")
    # Intervals of the grid order within a partition; the block's number there is the lower half of its id.
    size = F.greatest(F.lit(1), F.least(F.lit(GROUP), F.floor(F.lit(GROUP_BYTES) / (block * 8 * F.col("dim")))))
    interval = lambda c: F.shiftleft(F.shiftright(c, 32), 32) + F.floor(F.col(c).bitwiseAND(F.lit((1 << 32) - 1)) / size)
    pairs = pairs.withColumns({"ix": interval("block_x"), "iy": interval("block_y")})
    lists = pairs.groupBy("ix", "iy", "dim").agg(F.collect_list(F.struct("block_x", "block_y")).alias("pairs"))
    used = pairs.select("ix", "iy", F.explode(F.array("block_x", "block_y")).alias("block")).distinct()
    work = used.join(blocks.select("block", "dim", "ids", "counts", "data"), "block").select("ix", "iy", "block", "dim", "ids", "counts", "data")
    work = work.unionByName(lists, allowMissingColumns=True).repartition("ix", "iy").sortWithinPartitions("ix", "iy")
    found = materialise(work.mapInArrow(frugal(_join(axes, limit)), "kind long, a long, b long"), "ego-links")
    links = found.where("kind = 0").groupBy(F.col("a").alias("l_node")).agg(F.sum("b").alias("links"))
    part = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")), "ego-components")
    nodes = folded.select("node", "key", "low", "copies").join(part.withColumnsRenamed({"node": "c_node"}), F.col("node") == F.col("c_node"), "left")
    nodes = nodes.join(links, F.col("node") == F.col("l_node"), "left").withColumn("group", F.coalesce("component", "node"))
    least = nodes.groupBy(F.col("group").alias("g")).agg(F.min("low").alias("component_id"))
    nodes = nodes.join(least, F.col("group") == F.col("g")).select(F.col("key").alias("k"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), "component_id")
    out = tagged.join(nodes, F.col("key") == F.col("k"), "left")
    cid = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"), F.col("vec_id").eqNullSafe(cid).alias("kept"))


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """(block_x, block_y, dim), x <= y, of one label whose boxes are not further apart than epsilon.

    Blocks meet by the cells of their first two grid dimensions, widened by one on one side; the boxes decide.
    """
    cell = lambda c, k: F.floor(F.get(F.col(c), F.lit(k)) / F.lit(epsilon))
    span = lambda k, wide: F.sequence(cell("lo", k) - wide, cell("hi", k) + wide)
    second = lambda wide: F.when(F.size("lo") > 1, span(1, wide)).otherwise(F.array(F.lit(0).cast("long")))
    meta = blocks.select("block", "label", "dim", "lo", "hi")
    x = meta.withColumn("c0", F.explode(span(0, 0))).withColumn("c1", F.explode(second(0)))
    y = meta.withColumn("c0", F.explode(span(0, 1))).withColumn("c1", F.explode(second(1)))
    y = y.select("label", "dim", "c0", "c1", F.col("block").alias("block_y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    x = x.withColumnRenamed("block", "block_x")
    gap = F.zip_with(F.zip_with("lo", "hi_y", lambda a, b: a - b), F.zip_with("lo_y", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    square = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return x.join(y, ["label", "dim", "c0", "c1"]).where("block_x <= block_y").where(square <= epsilon**2).select("block_x", "block_y", "dim").distinct()


def op4_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rn, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.rn AS a, b.rn AS b FROM s a JOIN s b ON a.label = b.label AND a.rn <> b.rn
      AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END),
r(a, b) AS (SELECT rn, rn FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
c AS (SELECT r.a, min(v.vec_id) AS c FROM r JOIN v ON v.rn = r.b GROUP BY r.a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, v.vec_id IS NOT DISTINCT FROM c.c AS kept
FROM v JOIN c ON c.a = v.rn LEFT JOIN n ON n.a = v.rn
"""
