"""Terms found by the automaton against every place of every term."""

import random

import pytest

from corpuscle.operators import glossary, reference


def places(texts, terms):
    out = []
    for k, t in texts:
        for x in {x for x in terms if x}:
            at = (t or "").find(x)
            while at >= 0:
                out.append((k, at, x))
                at = t.find(x, at + 1)
    return sorted(out)


def longest(found):
    out, end = [], {}
    for k, at, x in sorted(found, key=lambda f: (f[0], f[1], -len(f[2]))):
        if at >= end.get(k, 0):
            out.append((k, at, x))
            end[k] = at + len(x)
    return out


RNG = random.Random(4)
TEXTS = [(i, "".join(RNG.choice("abé東👩 ") for _ in range(RNG.randrange(80)))) for i in range(30)] + [(90, None), (91, ""), (92, "ab " * 20_000)]
TERMS = ["a", "ab", "aba", "b a", "東", "é東", "👩 ", "none of this", "", None, "ab", "b é", "aaaa"]


@pytest.mark.parametrize("shard", [glossary.SHARD, 7])
@pytest.mark.parametrize("only", [False, True])
def test_term_places(spark, shard, only):
    docs = spark.createDataFrame([(*t, 0, "x") for t in TEXTS], "id long, text string, start int, term string").repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS], "word string")
    got = sorted((r.id, r.start, r.term) for r in glossary.term_places(docs, terms, ["id"], term="word", longest=only, shard=shard).collect())
    want = places(TEXTS, TERMS)
    assert got == (longest(want) if only else want)


def test_no_terms_and_no_texts(spark):
    docs = spark.createDataFrame(TEXTS[:3], "id long, text string")
    terms = spark.createDataFrame([("a",), (None,)], "term string")
    assert glossary.term_places(docs, terms.where("false"), ["id"]).count() == 0
    assert glossary.term_places(docs.where("false"), terms, ["id"]).count() == 0


def test_a_hundred_thousand_terms(spark):
    terms = [f"term{i}x" for i in range(100_000)]
    texts = [(1, " ".join(terms[5::9973]) + " term7 term77"), (2, "nothing")]
    docs = spark.createDataFrame(texts, "id long, text string")
    got = glossary.term_places(docs, spark.createDataFrame([(t,) for t in terms], "term string"), ["id"], shard=300_000).collect()
    assert sorted(r.term for r in got) == sorted(terms[5::9973])


def test_lookup_gives_the_glossary_rows(spark):
    docs = spark.createDataFrame([(1, "bronze and jade"), (2, "jade"), (2, "jade"), (3, None)], "id long, text string")
    terms = spark.createDataFrame([("bronze", "青铜"), ("jade", "玉"), ("jade", "玉石"), ("", "x"), (None, "y")], "en string, zh string")
    got = sorted(map(tuple, reference.glossary_lookup(docs, terms, "id", "en").collect()))
    assert got == [(1, "bronze", "青铜"), (1, "jade", "玉"), (1, "jade", "玉石"), (2, "jade", "玉"), (2, "jade", "玉石")]
