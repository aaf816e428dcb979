"""Passages of at least ``length`` units that also start earlier in the corpus: the plan shared by operators 1 and 8.

1. Whole equal texts (by SHA-256) fold to the first of them; a later copy goes whole, if it has a window at all.
2. One pass over the texts lists anchors (see ``anchors``) and where they stand. A count by anchor, joined back to the
   places, leaves those that occur more than once: the candidates. Both sides stay distributed.
3. The passage around each candidate (all windows that chose the anchor) is cut from its text and streamed to the shard
   of its anchor, where equal windows must meet. The shard's index (FM-index, or a family of suffix arrays) holds the
   distinct passages and tells for each window of each streamed passage which place of its text is the first.
4. A document drops the units of its windows that have an earlier place.

An anchor in more than HOT places is not gathered as it is. Its equal passages, compared byte by byte, first fold to
the first of them by partial minima; where more than HOT distinct ones remain, each is cut again by longer anchors, and
at last by whole windows, until no anchor has so many. What remains goes through the same index as all others.

Order is (doc_id, null last; hash of doc_id and text; start), so rows that repeat doc_id and text are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialise, ship
from .anchors import M, anchor_runs, mix
from .pretoken import slices, text_buffers
from .workers import frugal

SLICE = 1_000_000
HOT = 10_000
#: A task's passages are indexed some bytes at a time; those of one anchor stay together.
SHARD_BYTES = 3_000_000
_LAST = (1 << 63) - 1
#: ``ord`` of texts that come before all documents at hand.
FORMER = -(1 << 63)
_N_BITS = 10
_PLACE_BITS = 40
_PASSAGES = "a long, ord long, rk long, start long, n long, body binary"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"),
        F.xxhash64("doc_id", "text").alias("rk"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _views(units, batch, at: int = -1):
    """(first row, last row, view) of slices of a batch whose texts are column ``at``."""
    b, offsets = text_buffers(batch.column(at % batch.num_columns))
    for i, j in slices(offsets, SLICE):
        yield i, j, units(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _runs(units, view, k=None):
    k = k or units.k
    return anchor_runs(lambda i, j: view.grams(i, j, k), view.n, view.offsets, units.length, k)


def _bytes_of(view, lo, hi) -> pa.Array:
    """The ranges [lo, hi) of the view's bytes as a binary array."""
    size = hi - lo
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
    return pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(view.b[at]))])


def _list_anchors(units):
    """(ord, rk, text) to (a, ord, rk, at): the places of all anchors, as start << _N_BITS | number of windows."""

    def run(batches):
        for batch in batches:
            orders, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, view in _views(units, batch):
                a, start, count = _runs(units, view)
                row = np.searchsorted(view.offsets, start, "right") - 1
                at = (start - view.offsets[row]) << _N_BITS | count
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), orders[row + i], keys[row + i], at)], ["a", "ord", "rk", "at"])

    return run


def _cut_passages(units):
    """(ord, rk, anchors, places, hot, text) to the passages at those places."""

    def run(batches):
        for batch in batches:
            orders, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            anchor, row = _flat(batch.column(2))
            place, hot = _flat(batch.column(3))[0], _flat(batch.column(4))[0]
            for i, j, view in _views(units, batch):
                mine = slice(*np.searchsorted(row, [i, j]))
                r, n = row[mine], place[mine] & ((1 << _N_BITS) - 1)
                start = place[mine] >> _N_BITS
                s = start + view.offsets[r - i]
                body = _bytes_of(view, *view.span(s, s + n + units.length - 1))
                columns = [*map(pa.array, (anchor[mine], orders[r], keys[r], start, n)), body, pa.array(hot[mine])]
                yield pa.RecordBatch.from_arrays(columns, ["a", "ord", "rk", "start", "n", "body", "hot"])

    return run


def _cut_again(units, k: int):
    """Passages of an anchor to shorter ones, by the grams of k units that their windows choose."""

    def run(batches):
        for batch in batches:
            anchor, orders, keys, starts = (batch.column(c).to_numpy() for c in range(4))
            for i, _, view in _views(units, batch):
                a, start, count = _runs(units, view, k)
                r = np.searchsorted(view.offsets, start, "right") - 1
                body = _bytes_of(view, *view.span(start, start + count + units.length - 1))
                new = mix(anchor[r + i].view(np.uint64) * M[3] + a).view(np.int64)
                columns = (new, orders[r + i], keys[r + i], starts[r + i] + start - view.offsets[r], count)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), body], ["a", "ord", "rk", "start", "n", "body"])

    return run


def shards(units, least_places):
    """Passages sorted by anchor to rows (ord, rk, start, n): the runs of windows that are the first of their text.

    Whole anchors are put together to shards of SHARD_BYTES, so that a task holds one shard at a time.
    least_places(units, b, offsets, first) is the index: it holds the distinct passages b[offsets[i]:offsets[i+1]],
    whose earliest places are ``first``, and returns for every window of each the least place of its text.
    """

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            _, offsets = text_buffers(batch.column(5))
            # Where a shard may end: before a row of another anchor.
            cuts = np.flatnonzero(np.concatenate([[bool(held) and a[0] != last], a[1:] != a[:-1]]))
            at = 0
            while True:
                full = int(np.searchsorted(offsets, offsets[at] + max(SHARD_BYTES - size, 0)))
                k = int(np.searchsorted(cuts, max(full, at)))
                end = int(cuts[k]) if k < len(cuts) else batch.num_rows
                if end > at:
                    held.append(batch.slice(at, end - at))
                    size += int(offsets[end] - offsets[at])
                if k == len(cuts):
                    break
                yield _survivors(units, held, least_places)
                held, size, at = [], 0, end
                if at == 0:
                    cuts = cuts[1:]
            last = a[-1]
        if held:
            yield _survivors(units, held, least_places)

    return run


def _survivors(units, rows, least_places):
    """The shard's passages streamed through its index: each window against the first place of its text.

    The shard numbers its distinct passages by their bytes; a passage that stands in many places is searched once and
    every place is held against the answer.
    """
    table = pa.Table.from_batches(rows).combine_chunks()
    orders, keys, starts, n = (table[c].to_numpy() for c in ("ord", "rk", "start", "n"))
    body = table["body"]
    coded = (body.chunk(0) if isinstance(body, pa.ChunkedArray) else body).dictionary_encode()
    code = coded.indices.to_numpy()
    b, offsets = text_buffers(coded.dictionary)
    by = np.lexsort((starts, keys, orders))
    o, k = orders[by], keys[by]
    new = np.ones(len(by), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    key = np.empty(len(by), np.int64)
    key[by] = np.cumsum(new) << _PLACE_BITS
    key += starts
    first = np.full(len(offsets) - 1, np.iinfo(np.int64).max)
    np.minimum.at(first, code, key)
    least, at = least_places(units, b, offsets, first)
    window = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    alive = least[np.repeat(at[code], n) + window] == np.repeat(key, n) + window
    row, window = np.repeat(np.arange(len(n)), n)[alive], window[alive]
    # Neighbouring windows make one run.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    r = row[head]
    count = np.diff(np.append(head, len(row)))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (orders[r], keys[r], starts[r] + window[head], count)], ["ord", "rk", "start", "n"])


def _folded(passages: DataFrame) -> DataFrame:
    """Equal passages of an anchor to the first of them, by partial minima."""
    return passages.groupBy("a", "body").agg(F.min(F.struct("ord", "rk", "start", "n")).alias("f")).select("a", "f.*", "body")


def anchored(texts: DataFrame, units) -> DataFrame:
    """(a, ord, rk, at) of the anchors of (ord, rk, text)."""
    return texts.select("ord", "rk", "text").mapInArrow(frugal(_list_anchors(units)), "a long, ord long, rk long, at long")


def digest(text: str):
    """SHA-256 of a text."""
    return F.unhex(F.sha2(text, 256))


def repeated(anchors: DataFrame, known: bool = False) -> DataFrame:
    """(b, m): the anchors that occur more than once, and how often; with ``known``, those that new texts have."""
    by = anchors.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("m"), F.max("ord").alias("newest")).where("m > 1")
    return (by.where(F.col("newest") > FORMER) if known else by).select("b", "m")


def candidates(texts: DataFrame, anchors: DataFrame, often: DataFrame, hot: int) -> DataFrame:
    """(ord, rk, held): for each of the distinct texts (ord, rk) its anchors that occur more than once, as an array of
    structs (at, a, hot). ``often`` has one row for each anchor, so the join splits an anchor of very many places."""
    rows = anchors.join(often, F.col("a") == F.col("b")).select("ord", "rk", F.struct("at", "a", (F.col("m") > hot).alias("hot")).alias("x"))
    held = rows.groupBy(F.col("ord").alias("o"), F.col("rk").alias("r")).agg(F.collect_set("x").alias("held"))
    return texts.join(held, (F.col("ord") == F.col("o")) & (F.col("rk") == F.col("r"))).select("ord", "rk", "held")


def passages(texts: DataFrame, held: DataFrame, units) -> DataFrame:
    """The passages around the anchors of candidates(), with ``hot``."""
    held = held.withColumnsRenamed({"ord": "o", "rk": "r"})
    texts = texts.dropDuplicates(["ord", "rk"])
    rows = texts.join(held, (F.col("ord") == F.col("o")) & (F.col("rk") == F.col("r")))
    return rows.select("ord", "rk", "held.a", "held.at", "held.hot", "text").mapInArrow(frugal(_cut_passages(units)), _PASSAGES + ", hot boolean")


def representatives(folded: DataFrame, units, hot: int) -> DataFrame:
    """Distinct passages, cut by longer and longer anchors where one anchor has more than ``hot`` of them."""
    rows = materialise(folded, "hot-passages")
    for k in units.finer:
        crowd = materialise(rows.groupBy("a").agg(F.count("*").alias("m")).where(F.col("m") > hot).select("a"), "crowded-anchors")
        if not crowd.limit(1).count():
            break
        again = rows.join(crowd, "a", "left_semi").select(*rows.columns).mapInArrow(frugal(_cut_again(units, k)), _PASSAGES)
        before, rows = rows, materialise(rows.join(crowd, "a", "left_anti").unionByName(_folded(again)), "hot-passages")
        discard(before, crowd)
    return rows


def shared_windows(docs: DataFrame, units, least_places, hot: int = HOT, known: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(ord, rk, shared, alive) for each distinct text of docs: its runs of windows whose anchor occurs more than once,
    and of those that are the first of their text, as arrays of start << _N_BITS | count. Documents without a row repeat
    an earlier text as a whole.

    known: distinct texts (ord = FORMER, rk, d, text) that come before all of docs, and their anchors (a, ord, rk, at).
    """
    ship(docs.sparkSession)
    rows = keyed(docs)
    anchors, texts, digests = anchored(rows, units), rows.select("ord", "rk", "text"), rows.select("ord", "rk", digest("text").alias("d"))
    if known:
        anchors, digests = anchors.unionByName(known[1]), digests.unionByName(known[0].select("ord", "rk", "d"))
        texts = texts.unionByName(known[0].select("ord", "rk", "text"))
    anchors = materialise(anchors, "anchors")
    distinct = materialise(digests.groupBy("d").agg(F.min(F.struct("ord", "rk")).alias("f")).select("f.*"), "distinct-texts")
    often = materialise(repeated(anchors, known is not None), "repeated-anchors")
    held = materialise(candidates(distinct, anchors, often, hot), "candidates")
    discard(anchors, often)
    every = materialise(passages(texts, held, units), "passages")
    rows, hot_rows = every.where("not hot").drop("hot"), None
    if every.where("hot").limit(1).count():
        hot_rows = representatives(_folded(every.where("hot")), units, hot)
        rows = rows.unionByName(hot_rows.select(*rows.columns))
    alive = rows.repartition("a").sortWithinPartitions("a").mapInArrow(frugal(shards(units, least_places)), "ord long, rk long, start long, n long")
    place = F.shiftleft("start", _N_BITS).bitwiseOR(F.col("n"))
    alive = materialise(alive.select("ord", "rk", place.alias("at")), "first-windows")
    discard(every, *([hot_rows] if hot_rows is not None else []))
    alive = alive.groupBy("ord", "rk").agg(F.collect_list("at").alias("alive"))
    shared = held.select("ord", "rk", F.col("held.at").alias("shared"))
    return distinct.join(shared, ["ord", "rk"], "left").join(alive, ["ord", "rk"], "left")


def _mask(at: np.ndarray, base: np.ndarray, n: int) -> np.ndarray:
    """True for the windows in the runs ``at`` (start << _N_BITS | count), whose texts begin at unit ``base``."""
    d = np.zeros(n + 1, np.int32)
    s = (at >> _N_BITS) + base
    np.add.at(d, s, 1)
    np.add.at(d, s + (at & ((1 << _N_BITS) - 1)), -1)
    return np.cumsum(d[:n]) > 0


def removed_units(units, view, shared, alive, copies) -> np.ndarray:
    """Which units go: covered by a shared window that does not survive, or in texts of ``copies`` that have a window.
    shared, alive: (values, rows) of the view's texts."""
    gone = _mask(shared[0], view.offsets[shared[1]], view.n) & ~_mask(alive[0], view.offsets[alive[1]], view.n)
    d = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    cover = np.zeros(view.n + units.length + 1, np.int32)
    np.add.at(cover, np.flatnonzero(d == 1), 1)
    np.add.at(cover, np.flatnonzero(d == -1) + units.length - 1, -1)
    sizes = np.diff(view.offsets)
    return (np.cumsum(cover[: view.n]) > 0) | np.repeat(copies & (sizes >= units.length), sizes)


def _flat(column):
    """(values, row of each) of a list<long> column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def deduplicated(docs: DataFrame, units, least_places, report, schema: str, **how) -> DataFrame:
    """report(view, gone) for every slice of texts, where gone marks the removed units; one row per row of docs.

    report returns the columns after doc_id.
    """
    runs = shared_windows(docs, units, least_places, **how).withColumnsRenamed({"ord": "o", "rk": "r"})
    rows = keyed(docs)
    rows = rows.join(runs, (rows["rk"] == runs["r"]) & (rows["ord"] == runs["o"]), "left")
    rows = rows.select(F.col("doc_id").cast("long"), "shared", "alive", F.col("o").isNull().alias("copy"), "text")

    def run(batches):
        for batch in batches:
            shared, alive = _flat(batch.column(1)), _flat(batch.column(2))
            copies = batch.column(3).to_numpy(zero_copy_only=False)
            for i, j, view in _views(units, batch):
                part = lambda x: ((lambda k: (x[0][k], x[1][k] - i))(slice(*np.searchsorted(x[1], [i, j]))))
                gone = removed_units(units, view, part(shared), part(alive), copies[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *report(view, gone)], names)

    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    return rows.mapInArrow(frugal(run), f"doc_id long, {schema}")
