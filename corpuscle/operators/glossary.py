"""Terms of a glossary found in texts, with their places, by a multi-pattern automaton.

Terms are gathered in shards of at most ``SHARD`` characters, as many as the glossary's size asks for; each shard is one
broadcast of that bound and one automaton a worker, and texts run through one shard after the other in the same task.
Texts are never shuffled and no grams of them are made; what leaves the task is one row per term found.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Characters of the terms in one broadcast.
SHARD = 8_000_000
_FOUND = "array<struct<start int, term string>>"
_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("term", pa.string())]))
_built: OrderedDict[str, object] = OrderedDict()


def _automaton(key: str, shared):
    """This worker's automaton for a shard, by the name that the driver gave it; the two built last are kept."""
    if key not in _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for t in shared.value:
            found.add_word(t, t)
        if len(found):
            found.make_automaton()
        _built[key] = found
        while len(_built) > 2:
            _built.popitem(last=False)
    return _built[key]


def leftmost_longest(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of overlapping finds the one that starts first, of those the longest."""
    out, end = [], 0
    for start, term in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if start >= end:
            out.append((start, term))
            end = start + len(term)
    return out


def _shards(terms: DataFrame, term: str, size: int) -> list:
    spark = terms.sparkSession
    known = terms.select(F.col(term).alias("t")).where(F.length("t") > 0).distinct()
    total = known.agg(F.sum(F.length("t"))).head()[0] or 0
    n = -(-total // size)
    # One shard at a time on the driver, each of about ``size`` characters.
    part = F.pmod(F.xxhash64("t"), F.lit(max(n, 1)))
    return [(uuid.uuid4().hex, spark.sparkContext.broadcast([r.t for r in known.where(part == k).collect()])) for k in range(n)]


def term_places(docs: DataFrame, terms: DataFrame, keep: list[str], text: str = "text", term: str = "term", longest: bool = False, shard: int = SHARD) -> DataFrame:
    """docs' columns ``keep``, start (characters before it, from 0) and term, for every place where a text holds a term.

    longest: finds that don't overlap, the first and of those the longest. Terms are compared as they are, to the character.
    Null and empty terms and texts find nothing; terms given twice count once; rows of docs that repeat are searched each.
    """
    ship(docs.sparkSession)
    kept = docs.select(*keep)
    n = len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    names = [*keep, "__text", "__found"]
    rows = docs.select(*keep, F.col(text).alias("__text"), F.array().cast(_FOUND).alias("__found")).where(F.length("__text") > 0)

    def search(key, shared):
        def run(batches):
            found = _automaton(key, shared)
            for batch in batches:
                texts, before = batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()
                for t, own in zip(texts, before):
                    own += [{"start": end - len(x) + 1, "term": x} for end, x in found.iter(t)] if len(found) else []
                yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], pa.array(before, _TYPE)], names)

        return run

    for key, shared in _shards(terms, term, shard):
        rows = rows.mapInArrow(search(key, shared), f"{fields}, __text string, __found {_FOUND}")

    def settle(batches):
        for batch in batches:
            found = [[dict(zip(("start", "term"), x)) for x in leftmost_longest([(x["start"], x["term"]) for x in own])] for own in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, _TYPE)], [*keep, "__found"])

    rows = rows.drop("__text")
    if longest:
        rows = rows.mapInArrow(settle, f"{fields}, __found {_FOUND}")
    return rows.select(*keep, F.inline("__found"))
