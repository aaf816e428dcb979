"""The inverted file against all pairs."""

import numpy as np
import pytest

from corpuscle.operators import vectors


def brute(q, rows):
    """Sums in the order of numpy's, as the operator's."""
    out = {}
    for k, v in q:
        met = [(-(np.array(v) * np.array(w)).sum(), j) for j, w in rows if j != k and len(w) == len(v)]
        if met:
            s, j = min(met)
            out[k] = (j, -s)
    return out


@pytest.mark.parametrize("block", [5, 2048])
def test_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    mid = rng.normal(size=(12, 9))
    rows = [(i, (mid[i % 12] + 0.05 * rng.normal(size=9)).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(2000 + i, rng.normal(size=4).tolist()) for i in range(30)] + [(3000, [0.0] * 9), (3001, [1e6] * 9)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(6)
    q = [r for r in rows if r[0] % 3 == 0]
    got = vectors.nearest(df.where("k % 3 = 0"), df, "k", "v", block, lists=16, counted=True).collect()
    assert {r.k: (r.nearest, r.similarity) for r in got} == brute(q, rows)
    # Unlike rows of one length are looked at only where a bound allows it.
    seen = sum(r.examined for r in got)
    assert 0 < seen < 0.5 * len(q) * len(rows)


def test_no_bound_helps(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = vectors.nearest(df, df, "k", "v", lists=8).collect()
    assert {r.k: (r.nearest, r.similarity) for r in got} == brute(rows, rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0]), (3, [1.0])], "k long, v array<double>")
    assert {tuple(r) for r in vectors.nearest(df, df, "k", "v").collect()} == {(2, 3, 3.0), (3, 2, 3.0)}
    assert vectors.nearest(df.limit(0), df, "k", "v").count() == 0 == vectors.nearest(df, df.limit(0), "k", "v").count()
