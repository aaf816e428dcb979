"""Alignment of sequences against full tables."""

import random
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import sequences as S


def least_cost(la, lb):
    cost = lambda x, y: 1000 * (x - y) ** 2 // (68 * max(x + y, 1))

    @lru_cache(None)
    def best(i, j):
        if i == j == 0:
            return 0
        return min(best(i - da, j - db) + cost(sum(la[i - da : i]), sum(lb[j - db : j])) + p for (da, db), p in zip(S.BEADS, S.PRIORS) if i >= da and j >= db)

    return best(len(la), len(lb))


@pytest.mark.parametrize("band", [1, 2, 16, 500])
def test_beads_cost_least_and_cover_both_sides(band):
    rng = random.Random(band)
    for _ in range(60):
        la = [rng.choice([0, 5, 20, 40, 90, 300]) for _ in range(rng.randrange(14))]
        lb = [x + rng.randrange(-3, 4) for x in la if x > 5 and rng.random() < 0.8] if rng.random() < 0.5 else [rng.randrange(0, 120) for _ in range(rng.randrange(14))]
        lb = [max(0, x) for x in lb]
        found = S.beads(la, lb, band)
        assert sum(x[4] for x in found) == least_cost(tuple(la), tuple(lb))
        assert [k for a, b, *_ in found for k in range(a, b)] == list(range(len(la)))
        assert [k for *_, a, b, _ in found for k in range(a, b)] == list(range(len(lb)))
        assert all((b - a, d - c) in S.BEADS for a, b, c, d, _ in found)


def test_band_does_not_change_the_pairing():
    rng = random.Random(5)
    for _ in range(30):
        la, lb = ([rng.randrange(1, 200) for _ in range(rng.randrange(40))] for _ in range(2))
        assert S.beads(la, lb, 1) == S.beads(la, lb, 1000)


def test_sentence_beads(spark):
    long = "x" * 60
    rows = [(1, ["ab", "cd"], ["ef", "gh"]), (2, [long, long], [long + long]), (3, [long], []), (4, [], None), (5, None, [long, "y"]), (6, [None, long], [long]), (1, ["ab"], ["cd"])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "id long, a array<string>, b array<string>, bead string, x int")
    got = sorted((r.id, r.bead, r.kind, tuple(r.a), tuple(r.b)) for r in S.sentence_beads(df, ["id"]).collect())
    want = [(1, 0, "1-1", ("ab",), ("cd",)), (1, 0, "1-1", ("ab",), ("ef",)), (1, 1, "1-1", ("cd",), ("gh",)), (2, 0, "2-1", (long, long), (long + long,)), (3, 0, "1-0", (long,), ())]
    assert got[:5] == want
    assert {(i, k) for i, _, k, *_ in got if i == 5} == {(5, "0-1")} and not any(r[0] == 4 for r in got)
    assert sum(len(r[3]) for r in got if r[0] == 6) == 2 and S.sentence_beads(df.where("false"), ["id"]).count() == 0


def cosine(a, b):
    grams = lambda t: Counter(t[i : i + 3] for i in range(max(len(t) - 3, 0) + 1)) if t else Counter()
    x, y = grams(a), grams(b)
    norm = (sum(k * k for k in x.values()) * sum(k * k for k in y.values())) ** 0.5
    return int(sum(k * y[g] for g, k in x.items()) / norm * 1_000_000 + 0.5) if norm else 0


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdéñ東") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(0, 7))) for _ in range(n)]


def test_similarity():
    a, b = texts(30, 1) + ["", "x", "xy", "xyz"], texts(20, 2) + ["xyz", "", "x"]
    s = S.Similarity(a, b)
    for i, t in enumerate(a):
        assert abs(s.row(i) - [cosine(t, u) for u in b]).max() <= 1
    assert len(S.Similarity(a, []).row(0)) == 0


@pytest.mark.parametrize("seed", range(5))
def test_monotone_against_the_full_table(seed):
    rng = random.Random(seed)
    n, m = rng.randrange(1, 12), rng.randrange(1, 12)
    import numpy as np

    sims = np.array([[rng.choice([0, 300, 500, 500, 900]) for _ in range(m)] for _ in range(n)])

    @lru_cache(None)
    def best(i, j):
        if not i or not j:
            return 0
        return max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + int(sims[i - 1, j - 1]) if sims[i - 1, j - 1] >= 400 else 0)

    pairs = S.monotone(lambda i: sims[i], n, m, 400)
    assert sum(int(sims[p]) for p in pairs) == best(n, m)
    assert all(sims[p] >= 400 for p in pairs) and all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))


def test_missing_and_misordered_segments(spark):
    t = [f"{w} stands in the {x} hall of the museum" for w, x in zip("bronze porcelain jade silk bamboo".split(), "first second third fourth fifth".split())]
    rows = [
        (1, t, [x.upper().lower() for x in t]),
        (2, t, [t[0], t[2], t[3], t[4]]),
        (3, t, [t[4], t[0], t[1], t[2], t[3]]),
        (4, t, [t[0] + "s", "something that no one wrote", t[1], t[2], t[3], t[4]]),
        (5, t, []),
        (6, [], t),
        (7, None, None),
        (8, [None, "", t[0]], [t[0], None]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, t array<string>, s array<string>, ordinal int")
    got = {}
    for r in S.speech_alignment(df, ["id"], "t", "s").collect():
        got.setdefault(r.id, {})[r.ordinal] = (r.segment, r.method)
    full = lambda how, *places: {i: (p, how) for i, p in enumerate(places)}
    assert got[1] == full("ordinal", 0, 1, 2, 3, 4)
    assert got[2] == {**full("sequence", 0), 1: (None, None), 2: (1, "sequence"), 3: (2, "sequence"), 4: (3, "sequence")}
    assert got[3] == {**full("sequence", 1, 2, 3, 4), 4: (0, "moved")}
    assert got[4] == {i: (p, "sequence") for i, p in enumerate([0, 2, 3, 4, 5])}
    assert got[5] == {i: (None, None) for i in range(5)} and 6 not in got and 7 not in got
    assert got[8] == {0: (None, None), 1: (None, None), 2: (0, "sequence")}
    assert df.select(F.size("t")).count() == 8


def test_similarities_at_once_and_row_by_row(monkeypatch):
    """Both ways give the same, and a recording's texts are taken apart once."""
    rng = random.Random(9)
    lists = [([rng.choice(["", "ab", "a", "abc", "abcabc", "東京都", "abd", "bcabca"]) for _ in range(rng.randrange(12))] for _ in "ab") for _ in range(60)]
    lists = [tuple(x) for x in lists] + [(["abc", "", "ab"], ["abc", "", "ab"]), (["abc", "ab"], ["abc", "ab"])]
    calls, trigrams = [], S._trigrams
    monkeypatch.setattr(S, "_trigrams", lambda t: calls.append(t) or trigrams(t))
    for least in (0.0, 0.5, 1.0):
        once = [S.align_segments(a, b, least) for a, b in lists]
        monkeypatch.setattr(S, "_KEPT", 0)
        assert once == [S.align_segments(a, b, least) for a, b in lists]
        monkeypatch.undo()
        monkeypatch.setattr(S, "_trigrams", lambda t: calls.append(t) or trigrams(t))
    calls.clear()
    S.align_segments(["abcd", "bcde", "cdef"], ["bcde", "cdef"])
    assert sorted(calls) == ["abcd", "bcde", "cdef"]
    calls.clear()
    assert S.align_segments(["abcd", "bcde"], ["abcd", "bcde"]) == [(0, 0, 1000000, "ordinal"), (1, 1, 1000000, "ordinal")] and not calls
