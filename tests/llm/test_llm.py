import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import anchors, bagminhash, bpe, ego_join, elias_fano, fm_index, licences, line_dedup, mixing, pretoken, quality, queries, repeats, substring_dedup, suffix_dedup, token_files
from corpuscle.llm.components import components

from .brute import near_classes, removed, sha, words

LAST = (1 << 63) - 1
SCHEMA = "doc_id long, text string, source string, n_chars long, size long, h string, ids string, rk int, key string, kept int, component string, n int, a int"


def table(spark, rows):
    """rows of (doc_id, text[, source]) with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", "y", 1, "k", 0, "c", 3, 4) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=0, n=60):
    """Texts with shared passages, near copies, nulls, blanks, one long text, repeated rows and mixed white space."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéñß", k=rng.randint(1, 7))) for _ in range(300)]
    passages = [[rng.choice(vocab) for _ in range(rng.choice((19, 20, 21, 45, 120)))] for _ in range(8)]
    texts = []
    for k in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(1, 90))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        texts.append("".join(x + rng.choice((" ", "  ", "\n", " \t")) for x in w))
    for k in range(0, 12):
        w = texts[k].split()
        if len(w) > 3:
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    rows = [(k, t) for k, t in enumerate(texts + [long, long + " end", None, "", " \n\t ", "one", "one", "tick tick " * 60])]
    rows += [(None, texts[0]), (None, None), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


EMPTY: list = []
ODD = [(1, None), (1, None), (None, None), (2, ""), (None, "")]


def order(doc_id):
    return LAST if doc_id is None else doc_id


def in_order(rows):
    """Rows that repeat doc_id and text are one document; other rows of one doc_id do not occur in these tests."""
    return sorted(rows, key=lambda r: order(r[0]))


# Operators 1 and 8 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"hot": 3}])
@pytest.mark.parametrize("rows", [corpus(), EMPTY], ids=["corpus", "empty"])
def test_substring_dedup(spark, rows, how):
    rows = in_order([r for r in rows if r[0] is not None])
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(table(spark, rows), **how).collect())
    docs = [(order(d), tuple(words(t))) for d, t in rows]
    want = [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y).encode())) for (d, _), (_, w), g in zip(rows, docs, removed(docs, 20))]
    assert got == sorted(want)


@pytest.mark.parametrize("how", [{}, {"hot": 1}, {"hot": 3}])
@pytest.mark.parametrize("rows", [corpus(1), EMPTY], ids=["corpus", "empty"])
def test_suffix_dedup(spark, rows, how):
    rows = in_order([r for r in rows if r[0] is not None])
    # Brute force takes 100 bytes of memory a byte, so the long texts are shortened, to some ten anchor blocks of a shard.
    rows = [(d, t[:30_000] if t else t) for d, t in rows]
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(table(spark, rows), **how).collect())
    docs = [(order(d), (t or "").encode()) for d, t in rows]
    want = []
    for (d, _), (_, b), g in zip(rows, docs, removed(docs, 100)):
        spans = sum(1 for i, x in enumerate(g) if x and not (i and g[i - 1]))
        want.append((d, len(b), sum(g), spans, sha(bytes(x for x, y in zip(b, g) if not y))))
    assert got == sorted(want)


def test_texts_of_one_doc_id(spark):
    """Rows that share doc_id only are ordered by the hash of doc_id and text; those that repeat both are one document."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(k % 4, " ".join([f"a{k}x{j}" for j in range(rng.randint(0, 30))] + passage[: rng.randint(20, 60)])) for k in range(24)]
    rows += [rows[3], rows[3], rows[7]]
    df = table(spark, rows)
    order_of = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    docs = [((d, order_of[d, t]), d, t) for d, t in rows]
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(df).collect())
    texts = [(key, tuple(words(t))) for key, _, t in docs]
    want = [(d, len(w), sum(g), sha(" ".join(x for x, y in zip(w, g) if not y).encode())) for (_, d, _), (_, w), g in zip(docs, texts, removed(texts, 20))]
    assert got == sorted(want)
    got = sorted(tuple(r)[:3] for r in suffix_dedup.suffix_dedup(df).collect())
    texts = [(key, t.encode()) for key, _, t in docs]
    assert got == sorted((d, len(b), sum(g)) for (_, d, _), (_, b), g in zip(docs, texts, removed(texts, 100)))


@pytest.mark.parametrize("units,find", [(substring_dedup.WordUnits, substring_dedup.least_places), (suffix_dedup.ByteUnits, suffix_dedup.least_places)])
def test_the_index_decides(spark, units, find):
    """The windows that go are those in later copies of whole texts and those that the indexes tell, no others."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    seen = spark.sparkContext.accumulator(0)

    def counted(units, b, offsets, first):
        least, at = find(units, b, offsets, first)
        seen.add(len(least))
        return least, at

    runs = repeats.shared_windows(docs, units, counted)
    n = lambda c: F.aggregate(F.coalesce(c, F.array().cast("array<long>")), F.lit(0).cast("long"), lambda s, x: s + x.bitwiseAND(F.lit(1023)))
    shared, alive = runs.agg(F.sum(n("shared")), F.sum(n("alive"))).first()
    rows = repeats.keyed(docs).join(runs, ["ord", "rk"], "left_anti").collect()
    whole = sum(max(0, (len(words(r.text)) if units.length == 20 else len(r.text.encode())) - units.length + 1) for r in rows)
    # All distinct passages were searched, and no anchor of these texts is hot.
    assert 0 < alive <= seen.value <= shared
    first, again = {}, 0
    for r in docs.orderBy("doc_id").collect():
        w = words(r.text) if units.length == 20 else (r.text or "").encode()
        for i in range(len(w) - units.length + 1):
            g = hash(tuple(w[i : i + 20]) if units.length == 20 else w[i : i + 100])
            again += first.setdefault(g, (r.doc_id, i)) != (r.doc_id, i)
    print(units.__name__, "by the index", shared - alive, "in whole copies", whole)
    assert shared - alive + whole == again and shared - alive > again / 3


def test_suffix_family(spark, tmp_path):
    """Batches one after the other give what one run over all gives; levels stay few."""
    rows = sorted((d, t) for d, t in corpus(5) if d is not None and t is not None)
    rows = [r for k, r in enumerate(rows) if r[0] not in {q[0] for q in rows[:k]}]
    family = suffix_dedup.SuffixFamily(spark, str(tmp_path / "family"))
    got = []
    for k in range(0, len(rows), 20):
        got += family.add(table(spark, rows[k : k + 20])).collect()
        assert len(family.levels()) <= 3
    want = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sum(r.n_removed for r in family.add(table(spark, rows[:5])).collect()) == sum(len(t.encode()) for _, t in rows[:5] if len(t.encode()) >= 100)


def test_null_ids_come_last(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(table(spark, [(None, text), (5, text + " x")])).collect()}
    assert got == {(5, 0), (None, 40)}
    got = {(r.doc_id, r.n_removed > 0) for r in suffix_dedup.suffix_dedup(table(spark, [(None, text), (5, text + " x")])).collect()}
    assert got == {(5, False), (None, True)}


def test_fm_index_counts():
    rng = np.random.default_rng(0)
    s = np.append(rng.integers(1, 5, 400), 0)
    index = fm_index.FMIndex(s, 6)
    for at in range(0, 380, 7):
        for n in (1, 3, 6):
            lo, hi = np.array([0]), np.array([len(s)])
            for c in s[at : at + n][::-1]:
                lo, hi = index.extend(lo, hi, np.array([c]))
            assert hi[0] - lo[0] == sum((s[i : i + n] == s[at : at + n]).all() for i in range(len(s) - n + 1))


def test_suffix_levels():
    rng = random.Random(2)
    levels, seen, n = suffix_dedup.SuffixLevels(8), {}, 0
    for _ in range(20):
        b = bytes(rng.choices(b"ab", k=rng.randint(8, 60)))
        at = np.arange(len(b) - 7)
        got = levels.add(np.frombuffer(b, np.uint8), at, at + n)
        for i in at:
            assert got[i] == seen.setdefault(b[i : i + 8], n + i)
        n += len(at)
    sizes = [len(k) for _, k, _ in levels.levels]
    for data, at, _ in levels.levels:
        heads = [data[i : i + 8].tobytes() for i in at]
        assert heads == sorted(set(heads))
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))


def test_equal_windows_share_anchors():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 256, 150, dtype=np.uint8)
    hits = []
    for k in range(2):
        b = np.concatenate([rng.integers(0, 256, 500 + 300 * k, dtype=np.uint8), passage, rng.integers(0, 256, 300, dtype=np.uint8)])
        a, start, count = anchors.anchor_runs(lambda i, j: anchors.byte_grams(b[i : j + 23], 24), len(b), np.array([0, len(b)]), 100, 24)
        assert count.sum() == len(b) - 99 and (np.diff(start) > 0).all()
        own = 500 + 300 * k
        hits.append({(int(x), int(w - own)) for x, s, c in zip(a, start, count) for w in range(s, s + c) if own <= w <= own + 50})
    assert hits[0] == hits[1]


# Operator 2 ------------------------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", None, "é", "z", "ZZ", "one"]
    rows = [(k, "w " * rng.choice((0, 1, 5, 40)), rng.choice(sources[:-1])) for k in range(300)] + [(900, "w " * 2, "one"), (None, None, "a"), (3, "w", "a"), (3, "w", "a")]
    df = table(spark, rows)
    sizes, state = mixing.plan_mix(df)
    got = {r.source: r for r in state.collect()}
    own = Counter()
    for _, t, s in rows:
        own[s] += len(words(t))
    want = targets(dict(own))
    assert set(got) == set(want) and all(math.isclose(got[s].target, want[s], abs_tol=1e-6) for s in want)
    taken = Counter()
    for r in mixing.mix(df).collect():
        taken[r.source] += len(words(r.text))
    for s in want:
        assert abs(taken[s] - want[s]) <= 40
    assert mixing.mix(df).columns == df.columns
    assert sorted(map(str, mixing.mix(df).collect())) == sorted(map(str, mixing.mix(df).collect()))


def test_mixing_empty(spark):
    assert mixing.mix(table(spark, EMPTY)).count() == 0
    assert mixing.mix(table(spark, ODD)).count() == 0


# Operators 3 and 5 -----------------------------------------------------------------------------------------------

P = pytest.importorskip("public_tokenizers")


def tiktoken_own():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODDITIES = ["a", "B", "é", "1", "٣", "'", "'s", "'ll", "'re", "'t", " ", "  ", "\n", "\t", "\r\n", " ", "　", "!", "#", "中", "😀", "​", "ve", "²", "\x85", "\x1c", "\x00", "\U0001f9ff", "<|endoftext|>"]


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODDITIES, k=rng.randint(0, 40))) for _ in range(n)]


def test_pretoken_and_encoder():
    enc = tiktoken_own()
    own = pretoken.PieceEncoder(lambda ps: [enc._encode_single_piece(p) for p in ps], enc.encode_ordinary, remember=10)
    texts = odd_texts(3000)
    ids, at = own(*pretoken.text_buffers(pa.array(texts)))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == enc.encode_ordinary(t), repr(t)


@pytest.mark.parametrize("chunk,overlap", [(bpe.CHUNK, bpe.OVERLAP), (200, 64), (64, 16)])
def test_bpe_round_trip(spark, chunk, overlap):
    enc = tiktoken_own()
    rows = [(k, t) for k, t in enumerate(odd_texts(60, 1))] + corpus(2, 20) + [(800, "x" * 5000), (801, "a" * 70 + " b" * 200), (802, " " * 700 + "y")]
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.decode(bpe.encode(table(spark, rows), path, P.PATTERN, chunk, overlap), path).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.round_trip(table(spark, rows), path, P.PATTERN, chunk, overlap).collect()))
    want = sorted((order(d), enc.encode_ordinary(t or ""), t or "") for d, t in rows)
    assert sorted((order(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes).decode()) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)


def test_bpe_empty(spark):
    assert bpe.digests(table(spark, EMPTY), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("shard_ids", [token_files.SHARD_IDS, 50])
def test_token_files(spark, shard_ids):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    marked = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "x<|endoftext|", "|>", "é<|endoftext|>" * 9 + " z"]
    rows = [(3 * k + 10, t) for k, t in enumerate(odd_texts(40, 5) + marked)] + [(5, None), (6, ""), (None, "x y"), (None, "x y")]
    shards = token_files.write(table(spark, rows), P.path("byte_bpe_50k.json"), shard_ids=shard_ids)
    got = token_files.read(shards).collect()
    want, at = [], 0
    for d, t in in_order(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert sorted((order(r.doc_id), *tuple(r)[1:]) for r in got) == sorted((order(d), *w) for d, *w in want)
    row = shards.where("n_docs > n_ids * 0").first()
    shard = token_files.Shard(bytes(row.shard))
    assert shard.n_docs == row.n_docs and sum(len(shard.document(i)) for i in range(shard.n_docs)) == row.n_ids
    assert token_files.read(token_files.write(table(spark, EMPTY), P.path("byte_bpe_50k.json"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 65, 5000])
@pytest.mark.parametrize("top", [1, 100, 1 << 40])
def test_elias_fano(n, top):
    v = np.sort(np.random.default_rng(n).integers(0, top, n))
    raw = elias_fano.encode(v)
    e = elias_fano.EliasFano(b"pad" + raw, 3)
    assert (e.select(np.arange(n)) == v).all() and e.size == len(raw)
    if n == 5000:
        assert 8 * len(raw) < n * (2.5 + max(0, math.log2(top / n))) + 2000


# Operator 4 ------------------------------------------------------------------------------------------------------


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(12):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 25)):
            rows.append([(base * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0, 0.05, 0.1])).tolist(), int(g % 3)])
    rows += [[None, 1], [[0.0] * 16, 1], [[float("nan")] * 16, 1], [[1.0] * 15 + [None], 1], [[float("inf")] + [1.0] * 15, 1], [[1.0] * 16, None], [[1.0, 2.0], 1], [[1.0, 2.0], 1], [[], 1], [[2.0, 4.0], 1]]
    return [(k * 3 % 1009, v, label) for k, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("block", [ego_join.BLOCK, 8])
@pytest.mark.parametrize("seed", [0, 1])
def test_near_vectors(spark, block, seed):
    rows = vectors(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node int, cells int").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ego_join.near_vectors(df, block=block).collect()}
    ok = lambda v, x: v and x is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)
    links, root = defaultdict(int), {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[:i]:
            if ok(v, x) and ok(w, y) and x == y and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert got == {a: (links[a], find(a), find(a) == a) for a, _, _ in rows}


def test_near_vectors_of_any_size_and_null_ids(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1), (3, [1e-200, 2e-200], 1), (4, [1e200, 2e200], 1), (5, [5e-324, 1e-323], 1), (6, [1.7e308, 1.7e308], 1)]
    rows += [(None, [3.0, 6.0], 1), (None, [-1.0, 1.0], 1), (None, [-2.0, 2.0], 1), (None, [9.0, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, ego_join.near_vectors(df).collect()), key=repr)
    # [1.7e308, 1.7e308] has a cosine of 0.949 with the others. 5e-324 is the least number above 0.
    want = [(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 5, 1, False), (5, 5, 1, False), (6, 0, 6, True)]
    want += [(None, 5, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_a_block_travels_once_to_each_pair_of_intervals(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, (np.ones(4) + rng.normal(size=4) * 0.1).tolist(), 1) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    out = []
    for group in (1, 4, 1000):
        monkeypatch.setattr(ego_join, "GROUP", group)
        out.append(sorted(map(tuple, ego_join.near_vectors(df, block=8).collect())))
    assert out[0] == out[1] == out[2] and sum(r[1] for r in out[0]) > 10_000


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ego_join.near_vectors(df).count() == 0
    df = spark.createDataFrame([(1, None, None), (None, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, (tuple(r) for r in ego_join.near_vectors(df).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)"]


@pytest.mark.parametrize("local", [500_000, 40, 7])
def test_components(spark, local):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(500, 560)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "u long, v long").repartition(4), local=local)
    assert {r.node: r.component for r in got.collect()} == {x: find(x) for x in root if find(x) != x}


# Operator 6 ------------------------------------------------------------------------------------------------------


def lines_brute(rows, least=2):
    """The lines that stay: those in no run of ``least`` lines that occurs earlier."""
    units = [tuple(t.split("\n")) if t is not None else () for _, t in rows]
    keys = [(order(d), int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)) for d, t in rows]
    return [[x for x, g in zip(u, gone) if not g] for u, gone in zip(units, removed(list(zip(keys, units)), least))]


@pytest.mark.parametrize("divisor, least", [(4, 2), (1, 2), (1 << 40, 2), (3, 3)])
def test_line_dedup(spark, divisor, least):
    """Blocks of 2 to 12 lines among own ones; the result is the same wherever chunks end."""
    rng = random.Random(7)
    pool = [f"line {i}" for i in range(60)]
    blocks = [[rng.choice(pool) for _ in range(n)] for n in (2, 2, 3, 5, 12)]
    rows = []
    for k in range(50):
        ls = [f"own {k} {i}" for i in range(rng.randint(0, 6))]
        for b in rng.sample(blocks, rng.randint(0, 2)):
            at = rng.randint(0, len(ls))
            ls[at:at] = b
        rows.append((k, "\n".join(ls)))
    rows += [(900, None), (901, ""), (None, rows[3][1]), (902, "\n\n\n"), (903, "x\n" * 3000), (904, "only line 1"), (905, "only line 1"), rows[7]]
    rows += [(None, None), (906, "a\r\nb\r\nc"), (906, "a\r\nb\r\nd"), (907, "a\nb\nc"), (903, "x\n" * 20 + "y"), (None, "y\nz"), (None, "w\ny\nz")]
    p = "__l_"
    got = line_dedup.marked(table(spark, rows), divisor, least).select("doc_id", F.col(p + "text").alias("t")).collect()
    want = [(order(d), None if t is None else "\n".join(c)) for (d, t), c in zip(rows, lines_brute(rows, least))]
    assert sorted(((order(r.doc_id), r.t) for r in got), key=repr) == sorted(want, key=repr)


def test_line_dedup_carries_columns(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb"), (3, "x\na\nb"), (4, None), (5, "")]
    out = line_dedup.line_dedup(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("a\nb\nc", 5), 3: ("x", 1), 4: (None, 0), 5: ("", 0)}
    assert line_dedup.line_dedup(table(spark, EMPTY)).count() == 0


def test_line_runs(spark):
    rng = random.Random(8)
    pool = [f"line {i}" for i in range(60)]
    blocks = [[rng.choice(pool) for _ in range(n)] for n in (2, 3, 4, 12)]
    rows = []
    for k in range(50):
        ls = [f"own {k} {i}" for i in range(rng.randint(0, 6))]
        for b in rng.sample(blocks, rng.randint(0, 2)):
            at = rng.randint(0, len(ls))
            ls[at:at] = b
        rows.append((k, "\n".join(ls)))
    rows += [(900, None), (901, ""), (None, rows[3][1]), (902, "\n\n\n"), (903, "x\n" * 3000), (904, "only line 1"), (905, "only line 1"), rows[7]]
    got = line_dedup.run_marked(table(spark, rows)).select("doc_id", F.col("__l_text").alias("t")).collect()
    units = [tuple(t.split("\n")) if t is not None else () for _, t in rows]
    gone = removed([(order(d), u) for (d, _), u in zip(rows, units)], 2)
    want = [(order(d), None if t is None else "\n".join(x for x, g in zip(u, dead) if not g)) for (d, t), u, dead in zip(rows, units, gone)]
    assert sorted(((order(r.doc_id), r.t) for r in got), key=repr) == sorted(want, key=repr)
    assert line_dedup.run_marked(table(spark, EMPTY)).count() == 0


# Operator 7 ------------------------------------------------------------------------------------------------------


def test_licences(spark):
    mit = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text"))
    changed = mit.replace("year holder", "2020 Someone Else").upper().replace("LICENSE", "LICENCE").replace(", ", " ,  ")
    rows = [(1, mit), (2, changed), (3, mit + " more"), (4, "Text.\nreleased under the MIT licence\nReleased under the MIT License."), (5, None), (6, ""), (7, "x" * 100_000), (None, "licensed under CC BY NC 4.0")]
    got = {r.doc_id: (r.licence, r.n_notices, r.notices) for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: ("MIT", 0, ""), 2: ("MIT", 0, ""), 3: (None, 0, ""), 4: (None, 2, "MIT"), 5: (None, 0, ""), 6: (None, 0, ""), 7: (None, 0, ""), None: (None, 1, "CC-BY-NC-4.0")}
    assert licences.scan(table(spark, EMPTY)).count() == 0


def test_licences_of_repeated_rows_and_their_kin(spark):
    line = "Licensed under CC BY-NC 4.0."
    rows = [(1, line), (1, line), (1, line + "\n" + line), (2, line), (None, line), (None, line), (3, "SPDX-License-Identifier: LGPL-3.0-only"), (4, "This work is licensed under the LGPL-3.0.")]
    got = sorted(((order(r.doc_id), r.n_notices, r.notices) for r in licences.scan(table(spark, rows)).collect()))
    nc = "CC-BY-NC-4.0"
    assert got[:4] == [(1, 1, nc), (1, 1, nc), (1, 2, nc), (2, 1, nc)] and got[-2:] == [(LAST, 1, nc)] * 2
    assert all("GPL-3.0" not in n.replace("LGPL-3.0", "") for _, _, n in got[4:6])


def test_licences_of_the_whole_catalogue(spark):
    mit = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text"))
    bare = mit.removeprefix("MIT License\n\n")
    rows = [(1, bare), (2, "The MIT License (MIT)\n\n" + bare), (3, bare + " more"), (4, "Licensed under the Mozilla Public License, Version 2.0\nSPDX-License-Identifier: BSD-3-Clause")]
    want = {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "BSD-3-Clause,MPL-2.0")}
    for k, x in enumerate(json.load(open(licences.DATA, encoding="utf-8"))["texts"]):
        for j, title in enumerate(["", *x["titles"]]):
            rows.append((100 + 10 * k + j, title + "\nCopyright (c) 2021 Someone\n" + x["body"].replace("\n", "\n   ")))
            want[100 + 10 * k + j] = (x["licence"], "")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(table(spark, rows)).collect()}
    assert got == want
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0"} <= {x for x, _ in want.values()}


# Operator 9 ------------------------------------------------------------------------------------------------------


def test_near_dedup(spark):
    rng = random.Random(11)
    rows = corpus(3, 40)
    base = [f"w{i}" for i in range(200)]
    for k in range(40):  # a chain of edits: neighbours are near, ends are not
        base = list(base)
        base[rng.randrange(200)] = f"e{k}"
        rows.append((2000 + k, " ".join(base)))
    rows += [(3000, "a b c"), (3001, "a  b c"), (3002, "a b c d")]
    for block in (bagminhash.BLOCK, 4):
        classes = bagminhash.text_classes(table(spark, rows), block)
        label = {bytes(r.node): bytes(r.component) for r in classes.collect()}
        mine = defaultdict(list)
        for d, t in rows:
            if words(t):
                key = hashlib.sha256(t.encode()).digest()[:16]
                mine[label.get(key, key)].append(order(d))
        want = defaultdict(list)
        for (d, t), c in zip(rows, near_classes([(order(d), t) for d, t in rows])):
            if words(t):
                want[c].append(order(d))
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    kept = bagminhash.near_dedup(table(spark, rows))
    blank = sum(not words(t) for _, t in rows)
    assert kept.count() == len(want) + blank and kept.columns == table(spark, rows).columns
    assert {order(r.doc_id) for r in kept.collect() if words(r.text)} == {min(c) for c in want.values()}


def test_near_dedup_query(spark, tmp_path):
    """class_id, class_size and kept of the query; a great class with a few strangers in its buckets."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(100)]
    rows = [(None, "alone but for me"), (None, None), (7, ""), (8, ""), (9, "x y z"), (9, "x y z"), (3, "x y z"), (11, "other words")]
    for k in range(60):  # near the first, so one class; some share buckets with it but are below the limit
        w = list(base)
        for i in rng.sample(range(100), 1 if k < 50 else 7):
            w[i] = f"e{k}"
        rows.append((100 + k, " ".join(w)))
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(order(r.doc_id), r.class_id, r.class_size, r.kept) for r in queries.QUERIES["op9_near_dedup"](spark, str(tmp_path)).collect()]
    some = [r for r in rows if words(r[1])]
    classes = near_classes([(order(d), t) for d, t in some])
    size = Counter(classes)
    want = [(order(d), None if c == LAST else c, size[c], order(d) == c) for (d, _), c in zip(some, classes)]
    want += [(order(d), d, 1, True) for d, t in rows if not words(t)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert max(size.values()) >= 50


def test_near_dedup_empty(spark):
    assert bagminhash.near_dedup(table(spark, EMPTY)).count() == 0
    assert bagminhash.near_dedup(table(spark, ODD)).count() == len(ODD)


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    size = 2048
    shingles = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = rng.integers(0, 12, len(shingles)), rng.integers(0, 12, len(shingles))
    b = np.where(rng.random(len(b)) < 0.6, a, b)
    text = np.repeat([0, 1], len(shingles))
    weight = np.concatenate([a, b])
    some = weight > 0
    sig = bagminhash.signatures(text[some], np.tile(shingles, 2)[some], weight[some], 2, size)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / size)


@pytest.mark.parametrize("a,b", [(3, 4), (5, 10), (5, 8), (1, 2), (2, 3), (7, 16), (15, 16)])
def test_bagminhash_of_one_shingle(a, b):
    """A bag of one shingle has nothing to spread a bias over."""
    n, size = 3000, 120
    shingles = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left, right = (bagminhash.signatures(np.arange(n), shingles, np.full(n, w), n, size) & np.uint64(0xFFFF) for w in (a, b))
    # Components of one bag that follow the same early points are not independent: the bag is the sample.
    share = (left == right).mean(1)
    assert abs(share.mean() - a / b) < 4 * share.std() / math.sqrt(n)


# Operator 10 -----------------------------------------------------------------------------------------------------


def quality_brute(t):
    w = words(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    ls = [x for x in (t or "").split("\n") if words(x)]
    n, r = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), r, n < 10 or 100 * r > 20 * n


def test_quality_features(spark):
    rng = random.Random(3)
    rows = corpus(4, 30) + [(700 + k, " ".join(rng.choices("ab", k=rng.randint(0, 40)))) for k in range(30)] + [(800, "#$ |x|\n#$ |x|\n\n \nfoo"), (801, "a b c d e a b c d e a b c d e")]
    p = "__q_"
    got = quality.features(table(spark, rows)).select("doc_id", *[p + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base")]).collect()
    assert sorted((order(r[0]), *tuple(r)[1:]) for r in got) == sorted((order(d), *quality_brute(t)) for d, t in rows)


def shrunk(hosts):
    """({host: rate}, mean) for {host: (documents, failures)}: Kleinman's moments of a beta-binomial."""
    n, k = sum(a for a, _ in hosts.values()), sum(b for _, b in hosts.values())
    mean, h = k / n, len(hosts)
    within = sum(1 - a / n for a, _ in hosts.values())
    between = sum(a * (1 - a / n) for a, _ in hosts.values())
    spread = sum(a * (b / a - mean) ** 2 for a, b in hosts.values())
    scale = mean * (1 - mean) * (between - within)
    rho = min(1, max(0, (spread - mean * (1 - mean) * within) / scale)) if h > 1 and scale > 0 else 0
    return {s: (rho * b + (1 - rho) * mean) / (rho * a + 1 - rho) for s, (a, b) in hosts.items()}, mean


def test_hosts_of_one_document_are_shrunk(spark):
    """Nine of ten hosts with one document, one of ten with 100, all alike: one failure is no verdict on a host."""
    rng = random.Random(6)
    feats = [(f"h{h}", rng.random() < 0.1) for h in range(1000) for _ in range(100 if h % 10 == 0 else 1)]
    hosts = defaultdict(list)
    for h, x in feats:
        hosts[h].append(x)
    df = spark.createDataFrame([(h, x, False) for h, x in feats], "source string, __q_base boolean, __q_soft boolean")
    got = {r["__q_host"]: r["__q_rate"] for r in quality.host_rates(df).collect()}
    want, mean = shrunk({h: (len(x), sum(x)) for h, x in hosts.items()})
    assert got.keys() == want.keys() and all(math.isclose(got[h], want[h], abs_tol=1e-9) for h in want)
    alone = [got[h] for h, x in hosts.items() if x == [True]]
    assert len(alone) > 50 and max(alone) < 0.2 and abs(mean - 0.1) < 0.01
    apart = spark.createDataFrame([(f"h{h}", h % 2 == 0, False) for h in range(20) for _ in range(10)], "source string, __q_base boolean, __q_soft boolean")
    assert {round(r["__q_rate"], 2) for r in quality.host_rates(apart).collect()} == {0.0, 1.0}


def test_quality_soft_rule_needs_a_poor_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    soft = good + " # # # #"
    rows = [(k, good + f" {k}", "fair") for k in range(60)] + [(100 + k, "a b", "poor") for k in range(15)] + [(200 + k, good, "poor") for k in range(45)]
    rows += [(300, soft, "fair"), (301, soft, "poor")]
    kept = {r.doc_id for r in quality.quality_rules(table(spark, rows)).collect()}
    assert kept == {*range(60), *range(200, 245), 300}


def test_own_columns_do_not_touch_those_of_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    df = table(spark, [(1, good, "a"), (2, good + " x", "a"), (3, "#", "a")]).withColumns({c: F.col("size") for c in ("__q_w", "__Q_kept", "__l_dead", "__m_size", "__n_k")})
    for run in (quality.quality_rules, line_dedup.line_dedup, bagminhash.near_dedup, mixing.mix):
        out = run(df)
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r["__q_w"] == r["__Q_kept"] == r["__l_dead"] == r["__m_size"] == r["__n_k"] == 7 for r in rows)


def test_quality_hosts(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(k, good + f" {k}", "good") for k in range(40)] + [(100 + k, "#### " * 20, "bad") for k in range(39)] + [(150, good, "bad"), (151, good, None), (152, None, None)]
    kept = {r.doc_id for r in quality.quality_rules(table(spark, rows)).collect()}
    assert kept == {*range(40), 151}
    out = quality.quality_rules(table(spark, rows))
    assert out.columns == table(spark, rows).columns
    assert quality.quality_rules(table(spark, EMPTY)).count() == 0


# Queries ---------------------------------------------------------------------------------------------------------


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    df = queries.QUERIES[name](spark, sf).select(*names)
    cell = lambda x: round(x, 6) if isinstance(x, float) else x
    key = lambda rows: sorted(([cell(x) for x in r] for r in rows), key=repr)
    assert key(df.collect()) == key(cur.fetchall())


# The pipeline ----------------------------------------------------------------------------------------------------


def mix_brute(rows):
    """rows of (doc_id, text, source) as often as the mix takes them."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    out = []
    for s, target in targets(dict(sizes)).items():
        mine = [r for r in rows if r[2] == s]
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        rest = target - whole * sizes[s]
        digest = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{hashlib.md5((r[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
        groups = defaultdict(list)
        for r in mine:
            groups[digest(r)].append(r)
        upto, more = 0, set()
        for h in sorted(groups):
            own = sum(len(words(r[1])) for r in groups[h])
            if upto > rest:
                break
            last = not any(g > h for g in groups) or upto + own > rest
            if not last or (rest > 0 and abs(upto + own - rest) <= abs(upto - rest)):
                more.add(h)
            upto += own
        for r in mine:
            if words(r[1]):
                out += [r] * (whole + (digest(r) in more))
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(21)
    rows = [(d, t, f"s{rng.randrange(4)}") for d, t in corpus(9, 80) if d is not None]
    boiler = "\n".join(f"shared line {i} of many words to keep" for i in range(30))
    rows += [(5000 + k, f"{boiler}\nown text number {k} " + " ".join(f"q{k}x{j}" for j in range(30)), "s1") for k in range(6)]
    rows = [r for k, r in enumerate(rows) if r[0] not in {q[0] for q in rows[:k]}]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()

    facts = {d: quality_brute(t) for d, t, _ in rows}
    lines = {d: [x for x in (t or "").split("\n") if words(x)] for d, t, _ in rows}
    soft = {d: 100 * f[2] > 10 * f[0] or 100 * f[3] > 30 * len(lines[d]) for d, f in facts.items()}
    hosts = defaultdict(list)
    for d, _, s in rows:
        hosts[s].append(facts[d][5] or soft[d])
    rate, mean = shrunk({s: (len(h), sum(h)) for s, h in hosts.items()})
    now = [r for r in rows if not (facts[r[0]][5] or rate[r[2]] > 0.5 or (soft[r[0]] and rate[r[2]] + 1e-9 >= mean))]
    cut = [(r, "\n".join(c)) for r, c in zip(now, lines_brute([r[:2] for r in now]))]
    now = [(r[0], t, r[2]) for r, t in cut if t == r[1] or t]
    classes = near_classes([(d, t) for d, t, _ in now])
    now = [r for r, c in zip(now, classes) if r[0] == c]
    enc = tiktoken_own()
    want = []
    for d, t, _ in mix_brute(now):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want.append((d, len(ids), sha(ids.tobytes()), sha(t.encode())))
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 20


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null ids, null sources, blank texts and repeated rows; an empty table."""
    cp = pytest.importorskip("corpus_pipeline")
    one, two = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, one, None), (1, one, None), (None, two, None), (2, "", None), (3, None, None)]
    enc = tiktoken_own()
    want = {(d, len(enc.encode_ordinary(t)), sha(t.encode())) for d, t in ((1, one), (None, two))}
    for name, some, answer in (("odd", rows, want), ("empty", EMPTY, set())):
        table(spark, some).write.parquet(str(tmp_path / name / "documents.parquet"))
        out = cp.run(spark, str(tmp_path / name))
        got = out.collect()
        assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert len(got) == len(answer) and {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == answer


def _wrapped(text, width):
    """A text with other line breaks in its paragraphs; a notice keeps a line of its own."""
    import re
    import textwrap

    out = []
    for para in re.split(r"\n[ \t]*\n", text):
        lines = para.strip().split("\n")
        head = lines[:1] if re.match(r"(?i)copyright \(c\) (year|20)", lines[0].strip()) else []
        body = " ".join(" ".join(lines[len(head) :]).split())
        out.append("\n".join([*head, *textwrap.wrap(body, width or 10**6)]))
    return "\n\n".join(out)


def test_licences_do_not_depend_on_line_breaks(spark):
    rows, want = [], {}
    texts = [(n, t) for n, k, t in licences.KNOWN if k == "text"]
    for x in json.load(open(licences.DATA, encoding="utf-8"))["texts"]:
        texts.append((x["licence"], f"{x['titles'][0]}\n\nCopyright (c) 2021 Someone\n\n{x['body']}"))
        texts.append((x["licence"], x["body"]))
    for k, (name, text) in enumerate(texts):
        for j, width in enumerate([*range(60, 100), None]):
            rows.append((100 * k + j, _wrapped(text, width)))
            want[100 * k + j] = name
    got = {r.doc_id: r.licence for r in licences.scan(table(spark, rows)).select("doc_id", "licence").collect()}
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_licences_with_a_clause_changed_are_others(spark):
    rows = []
    for x in json.load(open(licences.DATA, encoding="utf-8"))["texts"]:
        body = x["body"]
        for old, new in ((" may ", " may not "), (" must ", " must not "), (" shall ", " shall never "), ("(c) You must retain", "(c) You must delete"), ("COPYRIGHT HOLDERS", "READERS"), ("is permitted", "is not permitted")):
            at = body.find(old)
            while at >= 0:
                rows.append((len(rows), body[:at] + new + body[at + len(old) :]))
                at = body.find(old, at + 1)
    # The catalogue knows texts without their appendix, so a change behind their end may be met by none of its forms only.
    got = licences.scan(table(spark, rows)).where("licence is not null").select("doc_id", "licence").collect()
    assert len(rows) > 300 and got == []


def test_licences_sql(spark, tmp_path):
    import duckdb

    mit = next(t for n, k, t in licences.KNOWN if (n, k) == ("MIT", "text"))
    zlib_ = next(t for n, k, t in licences.KNOWN if (n, k) == ("Zlib", "text"))
    rows = [(1, mit), (2, _wrapped(mit, 80)), (3, _wrapped(zlib_, 61)), (4, zlib_.replace("must not be misrepresented;", "must be misrepresented;")), (5, None), (6, "(c) You may\nReleased under the MIT License."), (7, "© 2020 X\nCopyright 1999 Y\n" + mit)]
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(licences.OP7_SQL)
    names = [c[0] for c in cur.description]
    want = sorted((dict(zip(names, r)) for r in cur.fetchall()), key=lambda r: r["doc_id"])
    got = sorted((r.asDict() for r in licences.op7_licence_scan(spark, str(tmp_path)).collect()), key=lambda r: r["doc_id"])
    assert got == want
    assert [r["licence"] for r in got] == ["MIT", "MIT", "Zlib", None, None, None, "MIT"]
