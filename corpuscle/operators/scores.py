"""Corpus-level scores of translations against the gold side, from statistics that add up.

Each pair gives, for every order of n-gram, how many grams both sides share (each counted as often as in the side that has it
less often) and how many each side has. Sums of these over any rows are all that BLEU and chrF need, so a corpus, a
language or a day is one partial aggregate, and stored sums can be added later without the texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Orders of words for BLEU and of characters for chrF, and how much more recall weighs than precision: the usual values.
WORDS, CHARS, BETA = 4, 6, 2
#: Characters of both sides that are counted together; bounds a task's memory, not its texts.
SLICE = 1_000_000
_WORD = re.compile("[^\\s　 ]+", re.ASCII)
_SUMS = [f"{kind}{n}_{what}" for kind, top in (("w", WORDS), ("c", CHARS)) for n in range(1, top + 1) for what in ("both", "hyp", "ref")]


def _symbols(texts: list[list[str]], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(symbols as numbers from 0, how many each text has): its words, or the characters of its words."""
    if words:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        return pa.array([w for t in texts for w in t], pa.string()).dictionary_encode().indices.to_numpy().astype(np.int64), sizes
    bare = ["".join(t) for t in texts]
    sizes = np.fromiter(map(len, bare), np.int64, len(texts))
    return np.unique(np.frombuffer("".join(bare).encode("utf-32-le"), "<u4"), return_inverse=True)[1].astype(np.int64), sizes


def shared_grams(hyps: list[list[str]], refs: list[list[str]], top: int, words: bool) -> list[np.ndarray]:
    """For n from 1 to top: how many grams each pair shares, its hypothesis has and its reference has."""
    pairs = len(hyps)
    symbol, sizes = _symbols([*hyps, *refs], words)
    owner, end = np.repeat(np.arange(2 * pairs), sizes), np.repeat(np.cumsum(sizes), sizes)
    width = int(symbol.max()) + 1 if len(symbol) else 1
    gram, at, out = symbol.copy(), np.arange(len(symbol)), []
    for n in range(1, top + 1):
        if n > 1:  # a gram's number comes from that of the gram without its last symbol, so numbers stay small and exact
            at = at[at + n - 1 < end[at]]
            gram[at] = np.unique(gram[at] * width + symbol[at + n - 1], return_inverse=True)[1]
        most = int(gram[at].max()) + 1 if len(at) else 1
        own = owner[at]
        held, which = np.unique(own % pairs * most + gram[at], return_inverse=True) if len(at) else (at, at)
        hyp = np.bincount(which[own < pairs], minlength=len(held))
        ref = np.bincount(which[own >= pairs], minlength=len(held))
        both = np.bincount(held // most, np.minimum(hyp, ref), pairs).astype(np.int64)
        have = np.bincount(own, minlength=2 * pairs)
        out += [both, have[:pairs], have[pairs:]]
    return out


def statistics(pairs: DataFrame, keep: list[str], hyp: str, ref: str) -> DataFrame:
    """pairs' columns ``keep`` and the statistics of each pair, as longs. Null and blank texts have no grams."""
    ship(pairs.sparkSession)
    kept = pairs.select(*keep)
    n = len(keep)

    def run(batches):
        for batch in batches:
            sides = [[_WORD.findall(t or "") for t in batch.column(n + k).to_pylist()] for k in (0, 1)]
            size = np.cumsum([sum(map(len, a)) + sum(map(len, b)) for a, b in zip(*sides)])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE, "right")))
                x, y = sides[0][i:j], sides[1][i:j]
                stats = shared_grams(x, y, WORDS, True) + shared_grams(x, y, CHARS, False)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:n], *(pa.array(s, pa.int64()) for s in stats)], [*keep, *_SUMS])
                i = j

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{s} long" for s in _SUMS]
    return pairs.select(*keep, F.col(hyp).alias("__h"), F.col(ref).alias("__r")).mapInArrow(run, ", ".join(fields))


def added(stats: DataFrame, *group: str) -> DataFrame:
    """Sums of statistics, of pairs or of earlier sums."""
    return stats.groupBy(*group).agg(*[F.sum(s).cast("long").alias(s) for s in _SUMS])


def bleu() -> Column:
    """0 to 100, without smoothing: 0 where some order shares nothing; null where there is no hypothesis or no gold word."""
    logs = sum((F.log(F.try_divide(F.col(f"w{n}_both").cast("double"), F.col(f"w{n}_hyp").cast("double"))) for n in range(1, WORDS + 1)), F.lit(0.0)) / WORDS
    short = F.least(F.lit(0.0), 1 - F.try_divide(F.col("w1_ref").cast("double"), F.col("w1_hyp").cast("double")))
    none = F.array_min(F.array(*[F.col(f"w{n}_both") for n in range(1, WORDS + 1)])) == 0
    return F.when((F.col("w1_hyp") > 0) & (F.col("w1_ref") > 0), F.when(none, 0.0).otherwise(100 * F.exp(short + logs)))


def chrf(beta: int = BETA) -> Column:
    """0 to 100, from mean precision and recall over the orders that both sides have; null where they have none."""
    orders = [(F.col(f"c{n}_hyp") > 0) & (F.col(f"c{n}_ref") > 0) for n in range(1, CHARS + 1)]
    count = sum((F.when(o, 1.0).otherwise(0.0) for o in orders), F.lit(0.0))
    mean = lambda side: sum((F.when(o, F.try_divide(F.col(f"c{n}_both").cast("double"), F.col(f"c{n}_{side}").cast("double"))).otherwise(0.0) for n, o in enumerate(orders, 1)), F.lit(0.0)) / count
    p, r = mean("hyp"), mean("ref")
    return F.when(count > 0, F.when(p + r > 0, 100 * (1 + beta * beta) * p * r / (beta * beta * p + r)).otherwise(0.0))
