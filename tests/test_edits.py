"""Edit scripts against the table of edit distances, and played back."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import edits


def distance(a, b):
    """Deletions and insertions of a shortest script."""
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(last[j - 1] if x == y else min(last[j], row[-1]) + 1)
        last = row
    return last[-1]


def played(a, script):
    out, at = [], 0
    for i, before, after in script:
        assert i >= at and a[i : i + len(before)] == before
        out += [a[at:i], after]
        at = i + len(before)
    return "".join(out) + a[at:]


def pairs(seed, n=60):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice("abcé東👩 ") for _ in range(k))
    out = [("", ""), ("", "x"), ("x", ""), ("a", "b"), ("ab", "ba"), ("aaaa", "aa"), ("abc" * 40, "abd" * 40)]
    for _ in range(n):
        a = some(rng.randrange(60))
        b = list(a)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = some(rng.randrange(3))
        out.append((a, "".join(b) if rng.random() < 0.8 else some(rng.randrange(60))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_scripts_are_shortest(seed):
    for a, b in pairs(seed):
        script = edits.edit_script(a, b)
        assert played(a, script) == b
        assert sum(len(x) + len(y) for _, x, y in script) == distance(a, b)
        assert all(i + len(x) < j for (i, x, _), (j, _, _) in zip(script, script[1:]))


def test_long_texts():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    cuts = sorted(rng.sample(range(len(a)), 40))
    b = "".join(p + "#!" for p in (a[i:j] for i, j in zip([0, *cuts], [*cuts, len(a)])))
    assert played(a, edits.edit_script(a, b)) == b
    x, y = a[:3000], a[200_000:203_000]
    assert played(x, edits.edit_script(x, y)) == y


def test_played_back_by_spark(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs(9))] + [(1000, None, "x"), (1001, "x", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, a string, b string, script int")
    got = edits.with_script(df, ["id", "a", "b"], "a", "b").withColumn("p", edits.play(F.col("a"), F.col("script")))
    assert all(r.p == r.b for r in got.collect() if r.id < 1000) and {r.p for r in got.where("id >= 1000").collect()} == {None}
    assert edits.with_script(df.where("false"), ["id"], "a", "b").count() == 0


def test_verdicts(spark):
    t = "The bronze stands in the first hall of the museum."
    rows = [(t, t), (t + "###", t), (t, t.replace("first", "second") + " It is old."), (t, "Something else stands here, and no one knows why."), (t, t.replace("bronze", "br0nze")), (t, t + " \n"), (None, t)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = edits.with_script(df, ["a", "b"], "a", "b").select(edits.verdict(F.col("a"), F.col("script")).alias("v")).collect()
    assert [r.v for r in got] == ["same", "cleaned", "added", got[3].v, "cleaned", "cleaned", None] and got[3].v in ("rewritten", "added")


def test_scripts_of_many_pairs_are_as_short(monkeypatch):
    rng = random.Random(5)
    text = lambda chars: "".join(rng.choice(chars) for _ in range(rng.randrange(60)))
    pairs = [(text("ab東c"[: rng.randrange(1, 5)]), text("ab東👩")) for _ in range(400)]
    pairs += [(a, "".join(c for c in a if rng.random() < 0.8)) for a, _ in pairs[:100]]
    pairs += [(b, a) for a, b in pairs[400:]]
    length = lambda s: sum(len(x) + len(y) for _, x, y in s)
    for kept in (edits.KEPT, 3000):
        monkeypatch.setattr(edits._short_all, "__defaults__", (kept,))
        for (a, b), script in zip(pairs, edits.edit_scripts(pairs)):
            at, out = 0, ""
            for i, x, y in script:
                assert i >= at and a[i : i + len(x)] == x
                out, at = out + a[at:i] + y, i + len(x)
            assert out + a[at:] == b
            assert length(script) == length(edits.edit_script(a, b))


def test_texts_with_characters_taken_out_need_no_search(monkeypatch):
    """No step of a search is made, whatever the number of changes."""
    monkeypatch.setattr(edits, "_short_all", None)
    monkeypatch.setattr(edits, "_advance", None)
    a = "ab##c" * 3000
    b = a.replace("##", "")
    back, again = edits.edit_scripts([(a, b), (b, a)])
    assert [len(back), len(again)] == [3000, 3000] and back[1] == (7, "##", "") and again[1] == (5, "", "##")


def test_playing_time_does_not_grow_with_the_product_of_text_and_changes(spark):
    """With a walk from the text's start for each change this takes minutes."""
    text = "ab東###👩 \n" * 150_000 + "end of the text" * 100
    clean = text.replace("###", "")
    df = edits.with_script(spark.createDataFrame([(text, clean)], "a string, b string"), ["a", "b"], "a", "b").cache()
    assert df.count() == 1
    began = time.perf_counter()
    assert df.where(edits.play(F.col("a"), F.col("script")) == F.col("b")).count() == 1
    took = time.perf_counter() - began
    df.unpersist()
    assert took < 25


def test_played_back_at_the_edges_of_cuts(spark):
    rng = random.Random(4)
    n = edits.CUT
    places = [0, 1, n - 1, n, n + 1, 2 * n - 1, 2 * n, 2 * n + 1, 5 * n - 1, 5 * n]
    rows = []
    for k in range(200):
        a = "".join(rng.choice("aé東👩\n ") for _ in range(rng.choice([n - 1, n, n + 1, 5 * n])))
        script, last = [], -1
        for at in sorted(rng.sample(places, 4)):
            to = min(len(a), at + rng.choice([0, 1, n - 1, n, n + 1]))
            if last < at <= to and at <= len(a):
                script.append((at, a[at:to], rng.choice(["", "x", "東" * n])))
                last = to
        rows.append((k, a, script, played(a, script)))
    df = spark.createDataFrame(rows, f"k int, a string, script {edits.SCRIPT}, want string")
    assert df.where(edits.play(F.col("a"), F.col("script")) == F.col("want")).count() == len(rows)
