"""Connected components of a table of links, by local contraction and alternating large and small stars.

In each round every task first contracts the links that it holds (LOCAL of them or so, never more with the data) to
stars; links that fit one task are then done. Else a large and a small star follow: each is a minimum per node (with
partial minima) and a join back to the links, so a node with very many links is never gathered, and the join splits it
where it is skewed. Every round is written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .workers import frugal

LOCAL = 500_000


def contract(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(node, least node joined to it) for the nodes of the links (u, v) that are not the least themselves."""
    coded = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ends = rank[coded.indices.to_numpy()]
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(order))
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    nodes = coded.dictionary.take(order)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes.take(pa.array(moved)), nodes.take(pa.array(label[moved]))


def _contract(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        node, low = contract(one(table["u"]), one(table["v"]))
        yield pa.RecordBatch.from_arrays([node, low], ["u", "v"])


def _lowest(links: DataFrame) -> DataFrame:
    """links (u, v) with m: the least of u and all its v."""
    low = links.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
    return links.join(low, F.col("u") == F.col("w")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _lowest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links with u > v."""
    low = _lowest(links)
    moved = low.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, label: str = "components", local: int = LOCAL) -> DataFrame:
    """(node, component) for every node of links (u, v) that is not the least of its component.

    u and v are of one orderable type; null ends are ignored, loops and repeated links do no harm, no links give no
    rows.
    """
    ship(links.sparkSession)
    links = links.where("u != v").select("u", "v")
    state = materialise(links, label)
    mark = None
    while True:
        now = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        tasks = -(-now[0] // local)
        state = materialise(state.coalesce(tasks).mapInArrow(frugal(_contract), state.schema), label)
        if tasks == 1:
            break
        state = materialise(_small_star(_large_star(state)), label)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component"))
