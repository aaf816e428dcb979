"""Nearest vectors of a query set by an inverted file that leaves nothing out.

Centroids are fitted on a bounded sample; every row goes to the list of its nearest centroid. A query q is answered first
in the list that promises most, which gives it a score s. A row x of a list with centre c is at most |x - c| away from it,
so that q.x <= q.c + |q| |x - c|: lists whose greatest distance cannot bring q.c up to s are not looked at, nor are
blocks, which hold rows of one list with like distances. What is left is compared, so the answer is that of all pairs;
where no bound helps, the work is that of all pairs too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship

#: Lists for vectors of one length, and vectors of the sample for each list.
LISTS, PER_LIST = 256, 64
#: Bytes of vectors in a block: batches of joined blocks pass through Python's pipe.
BLOCK_BYTES = 1 << 16
#: Blocks of one list that one task compares a block of queries with.
SHARE = 64
#: Room for rounding in bounds, against |q| |x|.
_SLACK = 1e-9


def _fit(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centres by Lloyd's rounds from rows of the sample, the same for the same sample."""
    k = max(1, min(lists, len(sample) // 4))
    centres = sample[np.random.default_rng(0).permutation(len(sample))[:k]]
    for _ in range(rounds):
        home = _home(sample, centres)[0]
        n = np.bincount(home, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres = sums[n > 0] / n[n > 0][:, None]
    return centres


def _home(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row (any will do) and the distance to it, worked out without cancellation."""
    at = np.empty(len(x), np.int32)
    for i in range(0, len(x), 1024):
        at[i : i + 1024] = np.argmin((centres**2).sum(1) - 2 * (x[i : i + 1024] @ centres.T), 1)
    return at, np.sqrt(((x - centres[at]) ** 2).sum(1))


def _sound(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(k, v, n) of the vectors that take part."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("k is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return rows.select("k", "v", F.size("v").alias("n"))


def _parts(batch, extra=()):
    """For each length of vector in the batch: (length, keys, vectors, further columns)."""
    t = pa.Table.from_batches([batch])
    dims = t["n"].to_numpy()
    for d in np.unique(dims):
        at = pa.array(np.flatnonzero(dims == d))
        x = t["v"].take(at).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, d)
        yield int(d), t["k"].take(at).to_numpy(), x, [t[c].take(at).to_numpy() for c in extra]


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _blocks(rows: DataFrame, extra: str, block: int) -> DataFrame:
    """Rows (n, list, extra, k, v) as blocks of one list with like ``extra``: (n, list, top, ks, xs, es), where top is the greatest extra."""

    def run(batches):
        kept: list = []
        now, size = None, 0

        def out():
            ks, xs, es = (np.concatenate(c) for c in zip(*kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([float(es.max())]), *(pa.array([a.tobytes()]) for a in (ks.astype("<i8"), xs, es.astype("<f8")))],
                ["n", "list", "top", "ks", "xs", "es"],
            )

        for batch in batches:
            for d, ks, xs, (ls, es) in _parts(batch, ("list", extra)):
                most = max(1, min(block, BLOCK_BYTES // (8 * d)))
                cuts = [0, *(np.flatnonzero(np.diff(ls)) + 1).tolist(), len(ls)]
                for lo, hi in zip(cuts, cuts[1:]):
                    while lo < hi:
                        of = (d, int(ls[lo]))
                        if kept and (now != of or size >= most):
                            yield from out()
                            kept, size = [], 0
                        now, take = of, min(hi - lo, most - size)
                        kept.append((ks[lo : lo + take], xs[lo : lo + take], es[lo : lo + take]))
                        lo, size = lo + take, size + take
        if kept:
            yield from out()

    order = ["n", "list", extra, "k"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, "n int, list int, top double, ks binary, xs binary, es binary")


def _compare(centres):
    """Best row of each query of a block among a block's rows, and how many it was compared with."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                d, ls, top = (batch.column(c)[r].as_py() for c in ("n", "list", "top"))
                q, x, s, i, y = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("qks", "<i8"), ("qxs", "<f8"), ("qes", "<f8"), ("ks", "<i8"), ("xs", "<f8")))
                x, y = x.reshape(-1, d), y.reshape(-1, d)
                size = np.sqrt((x * x).sum(1))
                c = centres(d)[ls]
                near = x @ c + size * top + _SLACK * size * (np.sqrt(c @ c) + top) >= s
                if not near.any():
                    continue
                q, x, size = q[near], x[near], size[near]
                dots = x @ y.T
                dots[q[:, None] == i[None, :]] = -np.inf
                best = dots.max(1)
                room = _SLACK * size * np.sqrt((y * y).sum(1).max())
                # Sums by another order differ in the last places, so that those that may be best are summed again, all alike.
                a, b = np.nonzero((dots >= (best - room)[:, None]) & np.isfinite(dots))
                exact = np.empty(len(a))
                for lo in range(0, len(a), 1 << 14):
                    exact[lo : lo + (1 << 14)] = (x[a[lo : lo + (1 << 14)]] * y[b[lo : lo + (1 << 14)]]).sum(1)
                order = np.lexsort((i[b], -exact, a))
                first = order[np.r_[True, np.diff(a[order]) > 0]] if len(a) else order
                nearest, score = np.zeros(len(q), np.int64), np.full(len(q), np.nan)
                nearest[a[first]], score[a[first]] = i[b[first]], exact[first]
                none = np.isnan(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q), pa.array(nearest, mask=none), pa.array(score, mask=none), pa.array(np.full(len(q), len(i)))], ["k", "near", "s", "seen"]
                )

    return run


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = 2048, lists: int = LISTS, counted: bool = False) -> DataFrame:
    """(key, nearest, similarity): for every query the other row of greatest inner product, ties by least key.

    Null keys, and vectors that are empty, null or hold null or non-finite components, take no part; vectors of different
    lengths are not compared; rows of the query's own key are not its neighbours, and a query without any has no row.
    Queries that repeat a key must repeat its vector. ``counted`` adds ``examined``, the rows compared with the query.

    To the driver go the sample (``lists`` times PER_LIST vectors or about that) and one row a list. Lists are the same for
    every length of vector that the sample holds; rows of other lengths lie in one list a length, around the origin.
    """
    spark = rows.sparkSession
    ship(spark)
    base, asked = _sound(rows, key, vector), _sound(queries, key, vector).dropDuplicates(["k"])
    n = base.select("k").count()
    share = max(1, n // (lists * PER_LIST))
    sample = base.where(F.pmod(F.xxhash64("k"), F.lit(share)) == 0).limit(2 * lists * PER_LIST).select("n", "v").toPandas()
    fitted = {int(d): _fit(np.stack(g["v"].to_list()).astype("f8"), lists) for d, g in sample.groupby("n")}
    centres = lambda d: fitted[d] if d in fitted else np.zeros((1, d))

    def assign(batches):
        for batch in batches:
            for d, ks, xs, _ in _parts(batch):
                at, far = _home(xs, centres(d))
                yield pa.RecordBatch.from_arrays([pa.array(ks), _vectors(xs), pa.array(np.full(len(ks), d, np.int32)), pa.array(at), pa.array(far)], ["k", "v", "n", "list", "far"])

    placed = base.mapInArrow(assign, "k long, v array<double>, n int, list int, far double")
    held = materialise(_blocks(placed, "far", block), "vector-lists")
    stats = held.groupBy("n", "list").agg(F.max("top").alias("far"), F.count("*").alias("blocks")).toPandas()
    radius = {int(d): (g["list"].to_numpy(), g["far"].to_numpy(), g["blocks"].to_numpy()) for d, g in stats.groupby("n")}

    def send(first: bool):
        """Each query to the list of greatest bound, or to the others whose bound reaches what it has found."""

        def run(batches):
            for batch in batches:
                for d, ks, xs, (home, found) in _parts(batch, ("home", "found")):
                    if d not in radius:
                        continue
                    ls, far, _ = radius[d]
                    c = centres(d)[ls]
                    size = np.sqrt((xs * xs).sum(1))[:, None]
                    dots = xs @ c.T
                    if first:
                        a, b = np.arange(len(ks)), np.argmax(dots, 1)
                    else:
                        bound = dots + size * far + _SLACK * size * (np.sqrt((c * c).sum(1)) + far)
                        a, b = np.nonzero((bound >= found[:, None]) & (ls[None, :] != home[:, None]))
                    for lo in range(0, len(a), 2000):
                        p, r = a[lo : lo + 2000], b[lo : lo + 2000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ks[p]), _vectors(xs[p]), pa.array(np.full(len(p), d, np.int32)), pa.array(ls[r].astype(np.int32)), pa.array(found[p])], ["k", "v", "n", "list", "found"]
                        )

        return run

    shares = spark.createDataFrame([(int(d), int(x), int(-(-b // SHARE))) for d, (xs, _, bs) in radius.items() for x, b in zip(xs, bs)], "n int, list int, shares int")
    spread: Column = F.pmod(F.xxhash64("ks"), F.col("shares")).cast("int")
    # One row a list, so that a broadcast has a bound.
    dealt = held.join(F.broadcast(shares), ["n", "list"]).withColumn("share", spread).select("n", "list", "share", "top", "ks", "xs")

    def search(sent: DataFrame) -> DataFrame:
        packed = _blocks(sent, "found", block).select("n", "list", F.col("ks").alias("qks"), F.col("xs").alias("qxs"), F.col("es").alias("qes"))
        copied = packed.join(F.broadcast(shares), ["n", "list"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        met = copied.join(dealt, ["n", "list", "share"]).mapInArrow(_compare(centres), "k long, near long, s double, seen long")
        best = F.max_by(F.struct("near", "s"), F.when(F.col("near").isNotNull(), F.struct("s", -F.col("near"))))
        return met.groupBy("k").agg(best.alias("x"), F.sum("seen").alias("seen")).select("k", "x.near", "x.s", "seen")

    routed = "k long, v array<double>, n int, list int, found double"
    least = F.lit(float("-inf"))
    homes = materialise(asked.select("*", F.lit(-1).alias("home"), least.alias("found")).mapInArrow(send(True), routed), "query-lists")
    one = materialise(search(homes), "first-answers")
    back = homes.drop("found").withColumnRenamed("list", "home").join(one.select("k", F.col("s").alias("found")), "k", "left").fillna({"found": float("-inf")})
    two = search(back.mapInArrow(send(False), routed))
    both = one.unionByName(two)
    best = F.max_by(F.struct("near", "s"), F.when(F.col("near").isNotNull(), F.struct("s", -F.col("near"))))
    out = both.groupBy("k").agg(best.alias("x"), F.sum("seen").alias("examined")).where("x.near is not null")
    out = out.select(F.col("k").alias(key), F.col("x.near").alias("nearest"), F.col("x.s").alias("similarity"), "examined")
    return out if counted else out.drop("examined")
