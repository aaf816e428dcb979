"""Operator 11: alignment of two tokenizers' ids over the bytes of each text.

Both tokenizers' token ends become bits of packed bitsets over the bytes of a slice of texts. Their AND has the shared cuts,
which select turns into byte offsets; popcount rank turns those into token ranges of either side. The ranges between
neighbouring cuts are the groups, and every A id of a group is linked to every B id of it.

Links are counted, never listed by occurrence: a group of a and b tokens has a * b of them, and its distinct id pairs carry
how often each occurs. One pass over the texts writes, for each slice of about ``SLICE`` bytes, its documents with their
pairs as numbers into the slice's own table of distinct pairs, and that table with the documents of each pair. Tables of
slices are summed by pair (Spark sums within a task first), the highest count of each A id is found, and the counts go
back to the slices that asked, where the documents' sums are made. What moves grows with the slices' distinct pairs, not
with the tokens; no table of all pairs is sent anywhere whole.

A group is as long as the tokenizers disagree, and its distinct pairs are at most its distinct A times its distinct B ids:
such a group is expanded by pieces of at most ``PAIRS`` pairs.

Defined results: null and empty texts, and those whose tokens don't spell out a blank and the text on both sides, have
zeros and '' and take no part in counts; null doc_ids are ordinary values; rows that repeat doc_id and text get equal
results and count as documents of their own; an empty table gives an empty result; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .bpe import _cache, read_file
from .pretoken import PieceEncoder, slices, text_buffers
from .workers import frugal

SLICE = 4_000_000
REMEMBER = 300_000
PAIRS = 4_000_000
BLANK = b" "


# Tokenizers ------------------------------------------------------------------------------------------------------


class Side:
    """encode(bytes, offsets) to (ids, offsets of each text's ids), and each id's bytes."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))


def _byte_names() -> dict[int, str]:
    """The printable stand-ins of bytes that the vocabulary is written in."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(x for x in range(256) if x not in plain)}


def byte_level(shared) -> Side:
    """A byte-level BPE vocabulary of the tokenizers library; special tokens' strings are plain text."""
    path, data = shared.value
    key = f"align:{path}"
    if key not in _cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.decode())
        tok.encode_special_tokens = True
        names, model = _byte_names(), tok.model
        back = {v: k for k, v in names.items()}
        one = lambda p: [t.id for t in model.tokenize(p.decode("latin-1").translate(names))]
        whole = lambda t: tok.encode(t, add_special_tokens=False).ids
        tokens = [b""] * tok.get_vocab_size()
        for token, i in tok.get_vocab().items():
            tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        _cache[key] = Side(PieceEncoder(lambda ps: [one(p) for p in ps], whole, REMEMBER), tokens)
    return _cache[key]


def piece_level(shared) -> Side:
    """A sentencepiece model that puts a blank before each text, without that blank in what it is given.

    Where no piece goes on past a blank that follows another character, texts are cut there and each distinct part is
    encoded once; models with other pieces encode texts whole.
    """
    path, data = shared.value
    key = f"align:{path}"
    if key not in _cache:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        raw = lambda i: bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else names[i].replace("▁", " ").encode()
        tokens = [raw(i) for i in range(len(names))]
        split = all("▁" not in x.lstrip("▁") for x in names)
        encode = _Parts(sp) if split else lambda b, at: _lists([sp.encode(bytes(b[i + 1 : j]).decode(), num_threads=1) for i, j in zip(at[:-1], at[1:])])
        _cache[key] = Side(encode, tokens)
    return _cache[key]


def _lists(got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, got), np.int64, len(got))
    return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])


class _Parts(PieceEncoder):
    """Parts that begin with blanks and end before the next ones, each distinct one encoded once a slice."""

    def __init__(self, sp):
        lone = sp.piece_to_id("▁")
        # The model puts the first blank itself, but not before nothing.
        one = lambda p: sp.encode(p[1:].decode(), num_threads=1) if len(p) > 1 else [lone]
        super().__init__(lambda ps: [one(p) for p in ps], None, REMEMBER)

    def __call__(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = b == BLANK[0]
        starts = blank.copy()
        starts[1:] &= ~blank[:-1]
        starts[offsets[:-1]] = True
        starts = np.flatnonzero(starts)
        ends = np.append(starts, len(b)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b))]).dictionary_encode()
        flat, first = _lists(self._pieces(parts.dictionary.to_pylist()))
        code = parts.indices.to_numpy()
        count = np.diff(first)[code]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = flat[np.repeat(first[code] - upto[:-1], count) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, offsets)]


# Bits ------------------------------------------------------------------------------------------------------------


class Bits:
    """A packed bitset with rank and select by popcounts of 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, positions: np.ndarray, size: int) -> Bits:
        marks = np.zeros(-(-size // 64) * 64, bool)
        marks[positions] = True
        return cls(np.packbits(marks, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __len__(self) -> int:
        return int(self.upto[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks are at or before each position."""
        below = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (at & 63).astype(np.uint64))
        return self.upto[at >> 6] + np.bitwise_count(self.words[at >> 6] & below)

    def select(self) -> np.ndarray:
        """The positions of all marks, in order: the k-th is where rank becomes k."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


# Slices ----------------------------------------------------------------------------------------------------------


def _spelled(b: np.ndarray, at: np.ndarray, side: Side, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which texts their tokens spell out byte for byte."""
    out = np.zeros(len(at) - 1, bool)
    raw, known = b.tobytes(), side.tokens
    listed = ids.tolist()
    for k, (i, j, s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), places[:-1].tolist(), places[1:].tolist())):
        out[k] = b"".join([known[x] for x in listed[s:e]]) == raw[i:j]
    return out


def _only(ids: np.ndarray, places: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.where(keep, np.diff(places), 0)
    return ids[np.repeat(keep, np.diff(places))], np.concatenate([[0], np.cumsum(sizes)])


def _digits(n: int) -> list[np.ndarray]:
    """Decimal names of ids followed by each of the three marks, as rows of bytes padded with zeros."""
    return [np.array([f"{i}{c}" for i in range(n)], "S").view(np.uint8).reshape(n, -1) for c in ",|;"]


class Slice:
    """Groups of the texts of one slice."""

    def __init__(self, a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
        size = int(a_ends[-1]) if len(a_ends) else 0
        if size != (int(b_ends[-1]) if len(b_ends) else 0):
            raise ValueError("both sides must spell the same bytes")
        of_a, of_b = Bits.of(a_ends - 1, size), Bits.of(b_ends - 1, size)
        cuts = (of_a & of_b).select()
        self.a_cut, self.b_cut = of_a.rank(cuts), of_b.rank(cuts)  # tokens up to the end of each group
        #: Groups before each text.
        self.g_at = np.searchsorted(self.a_cut, a_at, "right")

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.diff(self.a_cut, prepend=0), np.diff(self.b_cut, prepend=0)

    def links(self) -> np.ndarray:
        """Links of each text."""
        na, nb = self.sizes()
        upto = np.concatenate([[0], np.cumsum(na * nb)])
        return upto[self.g_at[1:]] - upto[self.g_at[:-1]]

    def names(self, a_names: list[np.ndarray], b_names: list[np.ndarray]) -> list[str]:
        """Digest of each text's written groups; '' for texts without any."""
        width = max(x.shape[1] for x in (*a_names, *b_names))
        na, nb = self.sizes()
        # Each token's place among all: A tokens of a group, then its B tokens.
        a_place = np.arange(len(self.a)) + np.repeat(self.b_cut - nb, na)
        b_place = np.arange(len(self.b)) + np.repeat(self.a_cut, nb)
        rows = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        for ids, place, last, names, mark in ((self.a, a_place, self.a_cut - 1, a_names, 1), (self.b, b_place, self.b_cut - 1, b_names, 2)):
            rows[place, : names[0].shape[1]] = names[0][ids]
            rows[place[last], : names[mark].shape[1]] = names[mark][ids[last]]
        count = np.count_nonzero(rows, axis=1)
        upto = np.concatenate([[0], np.cumsum(count)])
        raw = rows.ravel()
        raw = memoryview(raw[raw != 0].tobytes())
        at = upto[self.a_at + self.b_at].tolist()
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at[:-1], at[1:])]

    def pairs(self, width: int, most: int = PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, pair) with how many links each stands for, by text and pair; pair = a * width + b."""
        na, nb = self.sizes()
        n = na * nb
        texts = np.repeat(np.arange(len(self.g_at) - 1), np.diff(self.g_at))
        found = []
        upto = np.concatenate([[0], np.cumsum(n)])
        g, n_groups = 0, len(n)
        while g < n_groups:
            if n[g] > most:
                found.append(self._large(g, int(texts[g]), width, most))
                g += 1
                continue
            h = max(g + 1, int(np.searchsorted(upto, upto[g] + most, "right")) - 1)
            large = np.flatnonzero(n[g:h] > most)
            h = g + int(large[0]) if len(large) else h
            groups = np.repeat(np.arange(g, h), n[g:h])
            k = np.arange(len(groups)) - (upto[groups] - upto[g])
            ia = (self.a_cut - na)[groups] + k // nb[groups]
            ib = (self.b_cut - nb)[groups] + k % nb[groups]
            found.append(_distinct(texts[groups], self.a[ia].astype(np.int64) * width + self.b[ib]))
            g = h
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text, pair, times = (np.concatenate(x) for x in zip(*found))
        return (text, pair, times) if len(found) == 1 else _distinct(text, pair, times)

    def _large(self, g: int, text: int, width: int, most: int):
        """One group of many tokens: of its distinct ids, each with how often it occurs."""
        na, nb = self.sizes()
        a, ka = np.unique(self.a[self.a_cut[g] - na[g] : self.a_cut[g]], return_counts=True)
        b, kb = np.unique(self.b[self.b_cut[g] - nb[g] : self.b_cut[g]], return_counts=True)
        step = max(1, most // len(b))
        parts = [((a[i : i + step, None].astype(np.int64) * width + b).ravel(), (ka[i : i + step, None] * kb).ravel()) for i in range(0, len(a), step)]
        pair, times = (np.concatenate(x) for x in zip(*parts))
        return np.full(len(pair), text), pair, times


def _distinct(text: np.ndarray, pair: np.ndarray, times: np.ndarray | None = None):
    order = np.lexsort((pair, text))
    text, pair = text[order], pair[order]
    first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (pair[1:] != pair[:-1])]) if len(text) else np.zeros(0, bool))
    total = np.diff(np.append(first, len(text))) if times is None else np.add.reduceat(times[order], first) if len(first) else np.zeros(0, np.int64)
    return text[first], pair[first], total


_SLICES = "slice long, docs binary, pairs binary, held binary"


def _ids(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _aligner(a_file, b_file, size: int):
    """(doc_id, text) to slices: documents, their pairs as numbers into the slice's distinct pairs, and those pairs."""

    def run(batches):
        a_side, b_side = byte_level(a_file), piece_level(b_file)
        a_names, b_names = _cache.setdefault("align:names", (_digits(len(a_side.tokens)), _digits(len(b_side.tokens))))
        width = len(b_side.tokens)
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            raw, at = text_buffers(batch.column(1))
            for i, j in slices(at, size):
                # A blank before each text that is not empty; empty ones have no bytes and so no tokens.
                texts = at[i : j + 1] - at[i]
                some = np.diff(texts) > 0
                b = np.insert(raw[at[i] : at[j]], texts[:-1][some], BLANK[0])
                own = np.concatenate([[0], np.cumsum(np.diff(texts) + some)])
                a, a_at = a_side.encode(b, own)
                p, p_at = b_side.encode(b, own) if len(b) else (np.zeros(0, np.uint32), np.zeros(len(own), np.int64))
                good = _spelled(b, own, a_side, a, a_at) & _spelled(b, own, b_side, p, p_at) & some
                a, a_at = _only(a, a_at, good)
                p, p_at = _only(p, p_at, good)
                s = Slice(a, a_at, p, p_at, a_side.sizes, b_side.sizes)
                text, pair, times = s.pairs(width)
                known, number, held = np.unique(pair, return_inverse=True, return_counts=True)
                docs = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *map(pa.array, (np.diff(a_at), np.diff(p_at), np.diff(s.g_at), s.links(), np.bincount(text, minlength=j - i))), pa.array(s.names(a_names, b_names), pa.string())],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "groups_sha256"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema) as out:
                    out.write_batch(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 24 | seq], pa.int64()), *(pa.array([x], pa.binary()) for x in (sink.getvalue().to_pybytes(), number.astype("<u4").tobytes() + times.astype("<u4").tobytes() if not len(times) or times.max() < 1 << 32 else _too_many(), _ids(known) + _ids(held)))],
                    ["slice", "docs", "pairs", "held"],
                )
                seq += 1

    return run


def _too_many():
    raise ValueError("an id pair of one document has more than 2 ** 32 links")


def _asked(batches):
    """Each slice's distinct pairs as rows."""
    for batch in batches:
        for k in range(batch.num_rows):
            known, held = np.frombuffer(batch.column(1)[k].as_buffer(), "<i8").reshape(2, -1)
            for i in range(0, len(known), 50_000):
                part = known[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), batch.column(0)[k].as_py())), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(held[i : i + 50_000])],
                    ["slice", "slot", "pair", "docs"],
                )


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(key, slices_: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of one slice, with what was counted for its pairs."""
    docs = pa.ipc.open_stream(slices_["docs"][0].as_buffer()).read_all()
    number, times = np.frombuffer(slices_["pairs"][0].as_buffer(), "<u4").reshape(2, -1)
    slot, count, best = (answers[c].to_numpy(zero_copy_only=False) for c in ("slot", "count", "best"))
    counts, top = np.zeros(len(slot), np.int64), np.zeros(len(slot), bool)
    counts[slot], top[slot] = count, best
    at = np.concatenate([[0], np.cumsum(docs["n_pairs"].to_numpy())])
    times = times.astype(np.int64)
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    total, good = upto(times * counts[number]), upto(times * top[number])
    out = docs.drop_columns("n_pairs")
    out = out.append_column("n_best", pa.array(good[at[1:]] - good[at[:-1]])).append_column("count_sum", pa.array(total[at[1:]] - total[at[:-1]]))
    return out.select([x.split()[0] for x in _RESULT.split(", ")]).cast(pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _RESULT.split(", ")]))


def align(docs: DataFrame, a_path: str, b_path: str, size: int = SLICE) -> DataFrame:
    """One row per row of docs (doc_id, text). a_path: a byte-level vocabulary of the tokenizers library; b_path: a
    sentencepiece model that puts a blank before texts. size: bytes of a slice; changes no result."""
    import sentencepiece

    spark = docs.sparkSession
    a_file, b_file = read_file(spark, a_path), read_file(spark, b_path)
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    slices_ = materialise(rows.mapInArrow(frugal(_aligner(a_file, b_file, size)), _SLICES), "aligned-slices")
    asked = slices_.select("slice", "held").mapInArrow(_asked, "slice long, slot int, pair long, docs long")
    counts = materialise(asked.groupBy("pair").agg(F.sum("docs").alias("count")), "aligned-pairs").withColumn("a", F.expr(f"pair div {width}"))
    # An A id has as many rows here as B ids it meets: the vocabulary bounds them.
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    told = counts.join(top, "a").select(F.col("pair").alias("of"), "count", (F.col("count") == F.col("top")).alias("best"))
    answers = asked.select("slice", "slot", "pair").join(told, F.col("pair") == F.col("of")).select(F.col("slice").alias("to"), "slot", "count", "best")
    return slices_.select("slice", "docs", "pairs").groupBy("slice").cogroup(answers.groupBy("to")).applyInArrow(_sums, _RESULT)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
