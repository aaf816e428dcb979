"""Operator 9: near-duplicates by BagMinHash.

A text is the bag of its five-word shingles, with their counts as weights. Each pair of a shingle and a dyadic block
of weight levels (1; 2; 3-4; 5-8; ...) owns a Poisson process whose rate is the block's size and whose points carry
a signature component and a level. A shingle of weight w contributes the points with levels up to w: whole blocks
below w, and the block that holds w thinned by level. A component's first point (its process and its number in it) is
its signature, and two bags agree in a component with the probability of their weighted Jaccard similarity. Processes run only to a
time by which all components should have a point (later for the few texts where one has none).

Signatures are banded. In each bucket every text is proposed to the bucket's least text; proposals pass an estimate
from the signatures (BOUND, more than four standard errors below the limit) and then the exact overlap of the two
bags decides. Texts of one bucket that are still in different classes after that are compared in blocks (BLOCK texts and
BLOCK_BYTES bytes at most), by signature and then exactly, without a pair leaving the block unless it joins two
classes. The bucket's largest class is one side of its own: its members meet the others, never each other, so that a
bucket of one great class and a few strangers costs its size once. Classes are the connected components of the exact
links. Equal texts (by 128 bits of their SHA-256) fold to one before any of this, so copies are never paired.

Defined results: a text of one to four words has one shingle, all its words; null and empty texts have none and
are each a class of their own, whatever their doc_id; null doc_id sorts last; of rows that repeat doc_id and text
one is kept; an empty table gives an empty result; further columns are carried through, whatever their names (own
columns carry the prefix ``__n_``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, ship
from .anchors import M, Words, mix, unit_grams, word_hashes
from .columns import apart
from .components import components
from .pretoken import slices, text_buffers
from .workers import frugal

SHINGLE = 5
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
LIMIT = 0.8
BOUND = 0.65
BLOCK = 1_500
BLOCK_BYTES = 12_000_000
SLICE = 2_000_000
_MAX_TEXTS = 4_000
_P = "__n_"
_LAST = (1 << 63) - 1
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bags(b: np.ndarray, offsets: np.ndarray, bits: int = 52):
    """(text, shingle, count), ascending by text and shingle; up to 4,096 texts. Shingles are hashes of ``bits`` bits."""
    w = Words(b, offsets)
    n = len(offsets) - 1
    if w.n == 0:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    h = word_hashes(w.b, w.starts, w.ends)
    sizes = np.diff(w.offsets)
    text = np.repeat(np.arange(n), sizes)
    g = unit_grams(h, SHINGLE)
    start = np.arange(len(g))
    whole = start + SHINGLE <= w.offsets[1:][text[: len(g)]]
    keys = (text[: len(g)][whole].astype(np.uint64) << np.uint64(bits)) | (g[whole] >> np.uint64(64 - bits))
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    if len(short):
        one = np.array([int(mix(np.array([np.bitwise_xor.reduce(h[w.offsets[i] : w.offsets[i + 1]] * (np.arange(sizes[i], dtype=np.uint64) * M[2] | np.uint64(1)))]))[0]) for i in short], np.uint64)
        keys = np.concatenate([keys, (short.astype(np.uint64) << np.uint64(bits)) | (one >> np.uint64(64 - bits))])
    keys, count = np.unique(keys, return_counts=True)
    return (keys >> np.uint64(bits)).astype(np.int64), keys & np.uint64((1 << bits) - 1), count


def _times(k: int, m: int) -> np.uint64:
    return np.uint64(k * int(M[m]) & 0xFFFFFFFFFFFFFFFF)


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from the upper bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """n x size signature of the bags (text ascending); rows of texts without shingles are full of ones."""
    best = np.full(n * size, _FULL)
    total = np.bincount(text, weight, n)
    horizon = np.where(total > 0, size / np.maximum(total, 1) * (np.log(size) + 3), 0)
    todo = total > 0
    while todo.any():
        mine = todo[text]
        t0, d0, w0 = text[mine], shingle[mine], weight[mine]
        best.reshape(n, size)[todo] = _FULL
        for block in range(int(w0.max()).bit_length() + 1):
            floor = 0 if block == 0 else 1 << (block - 1)
            on = w0 > floor
            if not on.any():
                break
            t, w = t0[on], w0[on]
            rate = float(max(1, floor))
            # The stream of the process of (shingle, block).
            seed = mix(d0[on] * M[0] + _times(block + 1, 1))
            # Points of one process differ by their number, which tells bags apart that share a shingle with other weights.
            winner = seed >> np.uint64(32)
            time, k = np.zeros(len(t)), 0
            while len(t):
                k += 1
                x = mix(seed + _times(k, 2))
                time = time - np.log(_uniform(x)) / rate
                live = time <= horizon[t]
                t, w, seed, winner, time = t[live], w[live], seed[live], winner[live], time[live]
                point = (winner + _times(k, 6)) & np.uint64(0xFFFFFFFF)
                if not len(t):
                    break
                y = mix(seed ^ _times(k, 3))
                at = t * size + ((y & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
                value = (time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | point
                if floor > 1:
                    level = floor + 1 + ((y >> np.uint64(32)) * np.uint64(floor) >> np.uint64(32)).astype(np.int64)
                    ok = level <= w
                    at, value = at[ok], value[ok]
                np.minimum.at(best, at, value)
        todo &= (best.reshape(n, size) == _FULL).any(1)
        horizon = horizon * 2
    return best.reshape(n, size) & np.uint64(0xFFFFFFFF)


def _sign(batches):
    """(key, text) to (key, bands, sig, bytes); texts without words give no row."""
    for batch in batches:
        b, offsets = text_buffers(batch.column(1))
        for i, j in slices(offsets, SLICE):
            for p in range(i, j, _MAX_TEXTS):
                q = min(j, p + _MAX_TEXTS)
                text, shingle, count = _bags(b[offsets[p] : offsets[q]], offsets[p : q + 1] - offsets[p])
                some = np.unique(text)
                if len(some) == 0:
                    continue
                sig = signatures(text, shingle, count, q - p)[some]
                bands = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * M[5], len(sig), 0)
                for r in range(ROWS):
                    bands = bands * M[0] + sig[:, r::ROWS]
                bands = mix(bands).view(np.int64)
                flat = np.ascontiguousarray(sig.astype("<u2"))
                size = np.diff(offsets[p : q + 1])[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(p, q - p).take(pa.array(some)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sig) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                        pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, len(sig) * SIZE * 2 + 1, SIZE * 2, dtype=np.int32)), pa.py_buffer(flat)]),
                        pa.array(size),
                    ],
                    ["key", "bands", "sig", "bytes"],
                )


def overlaps(b1, o1, b2, o2):
    """(sum of minima, sum of maxima) of the counts of the i-th texts' shingles."""
    n = len(o1) - 1
    bits = 52
    t1, g1, c1 = _bags(b1, o1, bits)
    t2, g2, c2 = _bags(b2, o2, bits)
    k1 = (t1.astype(np.uint64) << np.uint64(bits)) | g1
    k2 = (t2.astype(np.uint64) << np.uint64(bits)) | g2
    _, i, j = np.intersect1d(k1, k2, assume_unique=True, return_indices=True)
    low = np.bincount(t1[i], np.minimum(c1[i], c2[j]), n)
    return low, np.bincount(t1, c1, n) + np.bincount(t2, c2, n) - low


def _verify(batches):
    """(u, v, text of u, text of v) to the (u, v) whose similarity is LIMIT or more."""
    for batch in batches:
        b1, o1 = text_buffers(batch.column(2))
        b2, o2 = text_buffers(batch.column(3))
        for i, j in slices(o1 + o2, 2 * SLICE):
            for p in range(i, j, _MAX_TEXTS):
                q = min(j, p + _MAX_TEXTS)
                low, high = overlaps(b1[o1[p] : o1[q]], o1[p : q + 1] - o1[p], b2[o2[p] : o2[q]], o2[p : q + 1] - o2[p])
                good = pa.array(np.flatnonzero((10 * low >= 8 * high) & (high > 0)))
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(p, q - p).take(good) for k in (0, 1)], ["u", "v"])


def _matrix(column, size: int = SIZE) -> np.ndarray:
    b, _ = text_buffers(column)
    return np.ascontiguousarray(b).view("<u2").reshape(-1, size)


def _estimate(batches):
    """(u, v, sig of u, sig of v) to (u, v, est), where the estimate is BOUND or more."""
    for batch in batches:
        est = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
        good = np.flatnonzero(est >= BOUND * SIZE)
        yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(good)) for k in (0, 1)], pa.array(est[good])], ["u", "v", "est"])


def _elements(b: np.ndarray, offsets: np.ndarray):
    """(elements, offsets): each text's bag as an ascending set, the k-th copy of a shingle being an element of its own."""
    text, shingle, count = _bags(b, offsets)
    t = np.repeat(text, count)
    k = np.arange(len(t)) - np.repeat(np.cumsum(count) - count, count)
    e = mix(np.repeat(shingle, count) + k.astype(np.uint64) * M[7])
    order = np.lexsort((e, t))
    return e[order], np.searchsorted(t, np.arange(len(offsets)))


def _block_links(table: pa.Table):
    """Links (u, v) between the rows of one (bucket, i, j) in different classes; links that would join what is already
    joined are left out."""
    table = table.combine_chunks()
    same = table["i"][0].as_py() == table["j"][0].as_py()
    band = table["band"][0].as_py()
    side = table["side"].to_numpy()
    sig = _matrix(table["sig"])
    bands = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    _, cls = np.unique(table["class"].to_numpy(zero_copy_only=False).astype("S33"), return_inverse=True)
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    near = {}
    for x in left:
        other = right[right > x] if same else right
        other = other[cls[other] != cls[x]]
        other = other[(sig[other] == sig[x]).sum(1) >= BOUND * SIZE]
        # Each pair in the first bucket that it shares.
        other = other[np.argmax(bands[other] == bands[x], 1) == band]
        if len(other):
            near[x] = other
    us, vs = [], []
    # Only texts that may have a link are cut into shingles.
    used = np.unique(np.concatenate([np.array([*near], np.int64), *near.values()])) if near else np.zeros(0, np.int64)
    elements, at = _elements(*text_buffers(table["text"].take(pa.array(used))))
    for x, other in near.items():
        i, js = np.searchsorted(used, x), np.searchsorted(used, other)
        mine, sizes = elements[at[i] : at[i + 1]], at[js + 1] - at[js]
        # No more than the smaller bag is shared, and no less than LIMIT of the larger must be.
        fit = (cls[other] != cls[x]) & (10 * np.minimum(sizes, len(mine)) >= 8 * np.maximum(sizes, len(mine)))
        other, js, sizes = other[fit], js[fit], sizes[fit]
        if not len(other):
            continue
        theirs = np.concatenate([elements[at[k] : at[k + 1]] for k in js])
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
        for y in other[10 * shared >= 8 * (sizes + len(mine) - shared)]:
            if cls[y] != cls[x]:
                us.append(x), vs.append(y)
                cls[cls == cls[y]] = cls[x]
    key = table["key"].combine_chunks()
    return pa.RecordBatch.from_arrays([key.take(pa.array(np.array(k, np.int64))) for k in (us, vs)], ["u", "v"])


def _blocks(batches):
    """Rows (bucket, i, j, band, side, key, class, bands, sig, text), sorted, to links; a group has 2 * BLOCK rows or so."""
    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if at is not None and at != tuple(ids[s]):
                yield _block_links(pa.Table.from_batches(held))
                held = []
            at = tuple(ids[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield _block_links(pa.Table.from_batches(held))


def _decide(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of keys whose texts are similar enough, written."""
    left = texts.select(F.col("key").alias("u"), F.col("text").alias("t1"))
    right = texts.select(F.col("key").alias("v"), F.col("text").alias("t2"))
    rows = pairs.join(left, "u").join(right, "v").select("u", "v", "t1", "t2")
    return materialise(rows.mapInArrow(frugal(_verify), "u binary, v binary"), "near-links")


def _labelled(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs (u, v, ...) that are still in different classes."""
    cu, cv = (classes.select(F.col("node").alias(f"n{s}"), F.col("component").alias(f"c{s}")) for s in "uv")
    rows = pairs.join(cu, F.col("u") == F.col("nu"), "left").join(cv, F.col("v") == F.col("nv"), "left")
    return rows.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).drop("nu", "nv", "cu", "cv")


def _key(text):
    """The first 16 bytes of the text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def text_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, component) of 16-byte text digests: every text that is not its component's least one."""
    ship(docs.sparkSession)
    keyed = docs.select(_key("text").alias("key"), "text").where("text is not null")
    sigs = materialise(keyed.mapInArrow(frugal(_sign), "key binary, bands array<long>, sig binary, bytes long").dropDuplicates(["key"]), "near-signatures")
    rows = sigs.select(F.posexplode("bands").alias("band", "bucket"), "key")
    lead = rows.groupBy("bucket").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1")
    member = materialise(rows.join(lead, "bucket"), "near-buckets")
    offered = member.where("key != lead").select(F.col("key").alias("u"), F.col("lead").alias("v")).distinct()
    sig = sigs.select("key", "sig")
    offered = offered.join(sig.select(F.col("key").alias("u"), F.col("sig").alias("s1")), "u").join(sig.select(F.col("key").alias("v"), F.col("sig").alias("s2")), "v")
    offered = materialise(offered.select("u", "v", "s1", "s2").mapInArrow(frugal(_estimate), "u binary, v binary, est long"), "near-offers")
    busy = member.select("key").distinct()
    texts = materialise(keyed.dropDuplicates(["key"]).join(busy, "key", "left_semi"), "near-texts")
    # First the likeliest offer of each text, then those that this leaves between classes, then what the leaders missed.
    best = offered.groupBy("u").agg(F.max(F.struct("est", "v")).alias("b")).select("u", F.col("b.v").alias("v"))
    links = _decide(best, texts)
    classes = components(links)
    links = links.unionByName(_decide(_labelled(offered.select("u", "v").join(best, ["u", "v"], "left_anti"), classes), texts))
    classes = components(links)
    return components(links.unionByName(_missed(member, sigs, texts, classes, block)))


def _missed(member: DataFrame, sigs: DataFrame, texts: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Links of one bucket, without its leader, between different classes: all that the leaders missed.

    A bucket's largest class is dealt to blocks of side 1, all its other texts to blocks of side 0; each block of side 0
    meets itself, the later ones of its side and those of side 1, and each such pair of blocks is one group. A group is
    judged inside and only links that join classes come out.
    """
    rows = member.where("key != lead").select("bucket", "band", "key").join(classes, F.col("key") == F.col("node"), "left")
    rows = rows.select("bucket", "band", "key", F.coalesce("component", "key").alias("class")).join(sigs.select("key", "bytes"), "key")
    held = rows.groupBy("bucket", "class").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    by = held.groupBy("bucket").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.max(F.struct("n", "class", "b")).alias("top")).where("k > 1")
    blocks = lambda n, b: F.greatest(F.ceil(n / block), F.ceil(b / BLOCK_BYTES)).cast("int")
    mixed = by.select(
        F.col("bucket").alias("of"), F.col("top.class").alias("great"),
        blocks(F.col("n") - F.col("top.n"), F.col("b") - F.col("top.b")).alias("few"), blocks(F.col("top.n"), F.col("top.b")).alias("many"),
    )
    rows = rows.drop("bytes").join(mixed, F.col("bucket") == F.col("of"))
    big = F.col("class") == F.col("great")
    mine = F.pmod(F.xxhash64("key"), F.when(big, F.col("many")).otherwise(F.col("few"))).cast("int")
    # Blocks of side 1 are numbered after those of side 0.
    rows = rows.withColumn("mine", F.when(big, F.col("few") + mine).otherwise(mine))
    others = F.sequence(F.lit(0), F.when(big, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("other", F.explode(others)).join(sigs.drop("bytes"), "key").join(texts, "key")
    rows = rows.select(
        "bucket", F.least("mine", "other").cast("long").alias("i"), F.greatest("mine", "other").cast("long").alias("j"), "band",
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "key", F.hex("class").alias("class"), "bands", "sig", "text",
    )
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.mapInArrow(frugal(_blocks), "u binary, v binary")


def classified(docs: DataFrame) -> DataFrame:
    """docs with ``__n_class`` (least doc_id of the class, null if it has none), ``__n_size``, ``__n_first`` (whether the
    row is the class's first), ``__n_same`` (rows that repeat its doc_id and text, if it is) and ``__n_own``, their key."""
    p = _P
    classes = text_classes(docs.select("doc_id", "text"))
    body = F.col("text")
    some = F.coalesce(F.rlike(body, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("o"), F.xxhash64("doc_id", "text").alias("r"), _key("text").alias("k"), some.alias("s")).where("s")
    own = own.join(classes, F.col("k") == F.col("node"), "left").withColumn("c", F.coalesce("component", "k"))
    rows_of = own.groupBy("c", "k", "o", "r").agg(F.count("*").alias("m"))
    by = rows_of.groupBy("c", "k").agg(F.min(F.struct("o", "r", "m")).alias("f"), F.sum("m").alias("n"))
    total = by.groupBy("c").agg(F.min("f").alias("f"), F.sum("n").alias("n"))
    of = materialise(by.select("c", F.col("k").alias(p + "k")).join(total, "c").select(p + "k", F.col("f.o").alias(p + "o"), F.col("f.r").alias(p + "r"), F.col("f.m").alias(p + "m"), F.col("n").alias(p + "n")), "near-classes")
    # Keys are made before the join, so that texts which the caller does not use are not shuffled.
    rows = docs.withColumns({p + "key": F.when(some, _key("text")), p + "own": F.xxhash64("doc_id", "text")})
    rows = rows.join(of, F.col(p + "key") == F.col(p + "k"), "left")
    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    alone = F.col(p + "k").isNull()
    return rows.withColumns(
        {
            p + "class": F.when(alone, F.col("doc_id").cast("long")).otherwise(F.nullif(p + "o", F.lit(_LAST))),
            p + "size": F.when(alone, F.lit(1)).otherwise(F.col(p + "n")).cast("long"),
            p + "first": alone | ((ord_ == F.col(p + "o")) & (F.col(p + "own") == F.col(p + "r"))),
            p + "same": F.when(alone, F.lit(1)).otherwise(F.col(p + "m")),
        }
    ).drop(p + "key", p + "k", p + "o", p + "r", p + "n", p + "m")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs of which one stays for each class, with the columns of docs."""
    return apart(docs, _P, _one_of_each)


def _one_of_each(docs: DataFrame) -> DataFrame:
    p = _P
    rows = classified(docs).where(F.col(p + "first"))
    # Rows that repeat doc_id and text stand for the same first row: one of them is kept.
    once = rows.where(F.col(p + "same") == 1)
    often = rows.where(F.col(p + "same") > 1).dropDuplicates([p + "own"])
    return once.unionByName(often).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    p = _P
    rows = classified(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("doc_id", F.col(p + "class").alias("class_id"), F.col(p + "size").alias("class_size"), F.col(p + "first").alias("kept"))
