"""Operator 11 against the libraries and plain loops over token bytes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from corpuscle.llm import token_alignment as T

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def groups_of(ids, parts, cut):
    out, own, n = [], [], 0
    for i, x in zip(ids, parts):
        own.append(i)
        n += len(x)
        if n in cut:
            out.append(own)
            own = []
    return out


def ends(parts):
    return set(np.cumsum([len(x) for x in parts]).tolist())


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    names = {v: k for k, v in T._byte_names().items()}
    found, docs = [], Counter()
    for d, t in rows:
        one = (d, 0, 0, 0, [], "")
        if t:
            a, b = tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)
            pa = [bytes(names[c] for c in tok.id_to_token(i)) for i in a]
            pb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(pa) == b"".join(pb) == (" " + t).encode():
                cut = ends(pa) & ends(pb)
                ga, gb = groups_of(a, pa, cut), groups_of(b, pb, cut)
                links = [(x, y) for u, v in zip(ga, gb) for x in u for y in v]
                docs.update(set(links))
                text = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in zip(ga, gb))
                one = (d, len(a), len(b), len(ga), links, hashlib.sha256(text.encode()).hexdigest())
        found.append(one)
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    return sorted(((d, na, nb, g, len(x), sum(docs[p] == top[p[0]] for p in x), sum(docs[p] for p in x), h) for d, na, nb, g, x, h in found), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, T.align(df, A, B, **kw).collect()), key=str)


ODD = ["", None, " ", "  ", "x", " x", "x ", "a  b   c", "\n\n\t x\r\n", "<s> </s> <unk> <|endoftext|> <0x41>", "▁", "a▁b", "日本語のテキスト。中文文本", "emoji 👩‍👩‍👧 ñ é ü", " 　x", "\x00\x01", "don't we'll 12345 --- ### https://a.b/c?d=e", "x" * 5000, "é " * 700, "thethethe " * 300]


def texts(n, seed):
    rng = random.Random(seed)
    words = "the of international tokenization Straße élève señor 42 antidisestablishmentarianism qxzjk ... (yes) 東京".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", " ", "\n"]) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"size": 1}, {"size": 200}])
def test_alignment(spark, how):
    rows = list(enumerate(ODD + texts(40, 1)))
    assert run(spark, rows, **how) == brute(rows)


def test_repeated_rows_null_ids_and_ties(spark):
    rows = [(1, "same text here"), (1, "same text here"), (None, "same text here"), (None, None), (2, "other"), (3, "same text"), (3, "▁")]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_further_columns(spark):
    assert run(spark, []) == []
    rows = [(1, "some text"), (2, "")]
    df = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "doc_id long, text string, slice int, pair int, a int")
    assert sorted(map(tuple, T.align(df, A, B).collect())) == brute(rows)


def test_groups_without_tokens_only(spark):
    rows = [(1, ""), (2, None), (3, "▁")]
    assert run(spark, rows) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


@pytest.mark.parametrize("most", [1, 3, 10, 10**6])
def test_pairs_of_large_groups(most):
    rng = np.random.default_rng(most)
    cuts = np.sort(rng.choice(np.arange(1, 400), 20, replace=False))
    ends_of = lambda: np.unique(np.concatenate([cuts, rng.integers(1, 401, 150), [400]]))
    ea, eb = ends_of(), ends_of()
    a, b = rng.integers(0, 5, len(ea)), rng.integers(0, 4, len(eb))
    sizes_a, sizes_b = np.diff(ea, prepend=0), np.diff(eb, prepend=0)
    shared = sorted(set(ea) & set(eb))
    texts_at = [0, shared[3], shared[3], shared[-1]]  # the second text is empty
    s = T.Slice.__new__(T.Slice)
    # Ids stand for no fixed bytes here, so the ends are given as sizes of positions.
    s.__init__(np.arange(len(a)), np.searchsorted(ea, texts_at, "right"), np.arange(len(b)), np.searchsorted(eb, texts_at, "right"), sizes_a, sizes_b)
    s.a, s.b = a, b
    want, k = Counter(), 0
    for lo, hi in zip([0, *shared], shared):
        text = 0 if hi <= texts_at[1] else 2
        for x in a[np.searchsorted(ea, lo, "right") : np.searchsorted(ea, hi, "right")]:
            for y in b[np.searchsorted(eb, lo, "right") : np.searchsorted(eb, hi, "right")]:
                want[text, x * 7 + y] += 1
    got = {(t, p): n for t, p, n in zip(*(x.tolist() for x in s.pairs(7, most)))}
    assert got == dict(want)
    assert s.links().tolist() == [sum(n for (t, _), n in want.items() if t == i) for i in range(3)]


@pytest.mark.parametrize("size", [1, 63, 64, 65, 1000])
def test_rank_and_select(size):
    rng = np.random.default_rng(size)
    marks = np.flatnonzero(rng.random(size) < 0.3)
    bits = T.Bits.of(marks, size)
    assert bits.select().tolist() == marks.tolist() and len(bits) == len(marks)
    assert bits.rank(np.arange(size)).tolist() == np.searchsorted(marks, np.arange(size), "right").tolist()
    other = np.flatnonzero(rng.random(size) < 0.5)
    assert (bits & T.Bits.of(other, size)).select().tolist() == np.intersect1d(marks, other).tolist()
