"""Operator 13 against a tree that is built level by level in plain Python."""

import hashlib
import zlib

import pytest

from corpuscle.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h([one(row[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])


def grow(nodes):
    """All levels of a tree, from the leaves."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, i):
    sides = []
    for level in levels[:-1]:
        run = level[i - i % 8 : i - i % 8 + 8]
        sides.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return sides


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append(r)
    for v in by.values():
        v.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: grow([leaf_of(r) for r in by[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(by[x]):
            sides = proof(trees[x], i) + proof(top, k)
            low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None
            f = leaf_of(r | {"text": r["text"].translate(low)} if changed else r)
            for a, b in sides:
                f = h([*a, f, *b])
            root = top[-1][0]
            out.append((r["doc_id"], leaf_of(r), trees[x][-1][0], root, h([s for a, b in sides for s in (*a, *b)]), f, f == root))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([tuple(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    return sorted(map(tuple, merkle.manifest(df, **kw).collect()), key=str)


def row(i, text="Some Text", lang="en", source="s", n=9):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": n}


@pytest.mark.parametrize("height", [1, 2])
def test_blocks_of_any_height_give_the_whole_trees(spark, height):
    rows = [row(i, f"Text {i} É", lang) for lang, n in (("en", 150), ("de", 65), ("fr", 8), ("é", 1), (None, 9)) for i in range(n)]
    assert run(spark, rows, height=height) == brute(rows)


def test_nulls_repeats_ties_and_long_texts(spark):
    rows = [row(1), row(1), row(1, "Other"), row(None), row(None, None), row(2, ""), row(3, None, None, None, None), row(4, "Ab " * 200_000), row(-5, "lower only"), row(9, "x", "")] + [row(i) for i in range(10, 20)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_single_leaves_and_empty_table(spark):
    one = [row(7)]
    (got,) = run(spark, one)
    assert [got] == brute(one)
    assert got[4] == h([]) and got[2] == got[3] == got[1]
    many = [row(i, lang=f"l{i}") for i in range(20)]
    assert run(spark, many, height=1) == brute(many)
    assert run(spark, []) == []


def test_further_columns_are_ignored(spark):
    rows = [row(i) for i in range(12)]
    df = spark.createDataFrame([(*(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")), i, "x", 1, 2, 3) for i, r in enumerate(rows)], SCHEMA + ", idx int, node string, at int, pid int, tree int")
    assert sorted(map(tuple, merkle.manifest(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65, 511, 512, 513])
def test_traversal_gives_the_same_paths_as_stored_levels(n):
    leaves = [h([str(i)]) for i in range(n)]
    levels = grow(leaves)
    height = merkle.levels_of(n)
    assert len(levels) == height + 1
    assert merkle.block_root(leaves, height) == levels[-1][0]
    for i, runs in enumerate(merkle.traverse(leaves.__getitem__, n, height)):
        sides, places = merkle.siblings(runs, i)
        assert sides == ["".join(a + b) for a, b in proof(levels, i)]
        assert merkle.fold(leaves[i], sides, places) == levels[-1][0]


def test_traversal_keeps_logarithmic_state():
    """Each level holds its run and at most one unfinished run a level of the next one's stack."""
    n, height = 4096, 4
    leaves = [h([str(i)]) for i in range(n)]
    made = []
    real = merkle.Treehash

    class Counted(real):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self)

    merkle.Treehash = Counted
    try:
        most = 0
        for runs in merkle.traverse(leaves.__getitem__, n, height):
            made = [s for s in made if s.runs or s.done][-height:]
            most = max(most, sum(map(len, runs)) + sum(len(s.done) + sum(map(len, s.runs)) for s in made))
    finally:
        merkle.Treehash = real
    assert most <= 8 * height * (height + 2)
