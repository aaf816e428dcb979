"""Corpus scores against counters in plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from corpuscle.operators import scores


def words(t):
    return re.findall("[^\\s　 ]+", t or "", re.ASCII)


def counts(symbols, n):
    return Counter(tuple(symbols[i : i + n]) for i in range(len(symbols) - n + 1))


def brute(pairs):
    def sums(of, n):
        h, r = [counts(of(a), n) for a, _ in pairs], [counts(of(b), n) for _, b in pairs]
        return sum(sum((x & y).values()) for x, y in zip(h, r)), sum(sum(x.values()) for x in h), sum(sum(x.values()) for x in r)

    w = [sums(words, n) for n in range(1, 5)]
    c = [sums(lambda t: "".join(words(t)), n) for n in range(1, 7)]
    bleu = None
    if w[0][1] and w[0][2]:
        bleu = 0.0 if any(not b for b, _, _ in w) else 100 * math.exp(min(0, 1 - w[0][2] / w[0][1]) + sum(math.log(b / h) for b, h, _ in w) / 4)
    c = [x for x in c if x[1] and x[2]]
    p, r = (sum(x[0] / x[k] for x in c) / len(c) if c else 0 for k in (1, 2))
    return bleu, (500 * p * r / (4 * p + r) if p + r else 0.0) if c else None


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = "the a bronze 青铜器 ñandú élève of museum 👩‍👩‍👧 hall . ,".split()
    out = []
    for _ in range(n):
        ref = [rng.choice(vocabulary) for _ in range(rng.randrange(25))]
        hyp = [rng.choice(vocabulary) if rng.random() < 0.2 else w for w in ref][: rng.choice([None, 10])]
        out.append((" ".join(hyp), "　".join(ref)))
    return out


@pytest.mark.parametrize("pairs", [corpus(40, 1), corpus(3, 2), [(None, "a b c d e")], [("a b", None)], [("a a a a a", "a a")], [("x y", "a b")], [("", " ")], corpus(30, 4) + [(None, None), ("", "x"), ("long " * 30_000, "long words " * 9_000)]])
def test_scores(spark, pairs, monkeypatch):
    monkeypatch.setattr(scores, "SLICE", 300)
    df = spark.createDataFrame([(1, *p, 0) for p in pairs], "k int, h string, r string, w1_both int").repartition(2)
    stats = scores.statistics(df, ["k"], "h", "r")
    (got,) = scores.added(stats, "k").select(scores.bleu().alias("b"), scores.chrf().alias("c")).collect()
    for x, y in zip(got, brute(pairs)):
        assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-9)


def test_sums_of_sums_are_sums(spark):
    df = spark.createDataFrame([(i % 3, *p) for i, p in enumerate(corpus(50, 3))], "k int, h string, r string")
    stats = scores.statistics(df, ["k"], "h", "r")
    assert scores.added(scores.added(stats, "k")).collect() == scores.added(stats).collect()
    assert scores.added(scores.statistics(df.where("false"), ["k"], "h", "r"), "k").count() == 0
