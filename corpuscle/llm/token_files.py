"""Operator 5: token-id shards with Elias-Fano document boundaries.

A shard is one binary value: header, Elias-Fano coded end offsets of its documents, Elias-Fano coded doc_ids
(ascending, less the smallest), then the ids of all documents end to end, two bytes each where the vocabulary
allows. Shards are the rows of a Parquet table in ascending doc_id order (part, seq), so that Spark's own commit
protocol places them in any store it can write. A document's offsets come from the select structure; there is no
table of 64-bit offsets.

Texts that hold an added token of the vocabulary (<|endoftext|>, say) are encoded whole by the library, which gives that
token its own id.

Defined results: null text is empty and has the end id alone; null doc_ids come last; rows that share doc_id are
ordered by the hash of their text; an empty table gives no shard and an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import elias_fano
from .bpe import _cache, read_file
from .pretoken import PieceEncoder, slices, text_buffers
from .workers import frugal

MAGIC = b"TOKSHRD1"
#: magic, documents, null doc_ids at the end, ids, bytes for each id, smallest doc_id.
HEAD = struct.Struct("<8sQQQBq")
SHARD_IDS = 2_000_000
#: Bytes of text encoded together, and pre-tokens remembered between: here a new pre-token costs most.
SLICE = 8_000_000
REMEMBER = 300_000
END_ID = 0


def pack(doc_ids: np.ndarray, n_null: int, ends: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """doc_ids: of the documents that have one, ascending; then n_null without."""
    low = int(doc_ids[0]) if len(doc_ids) else 0
    head = HEAD.pack(MAGIC, len(ends), n_null, len(ids), width, low)
    keys = (doc_ids - low).astype(np.uint64) if len(doc_ids) else doc_ids
    return head + elias_fano.encode(ends) + elias_fano.encode(keys) + ids.astype(f"<u{width}").tobytes()


class Shard:
    """Random access to the documents of one packed shard."""

    def __init__(self, raw: bytes):
        magic, self.n_docs, self.n_null, self.n_ids, width, self.low = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ends = elias_fano.EliasFano(raw, HEAD.size)
        self.keys = elias_fano.EliasFano(raw, HEAD.size + self.ends.size)
        self.ids = np.frombuffer(raw, np.uint8, self.n_ids * width, HEAD.size + self.ends.size + self.keys.size).view(f"<u{width}")

    def doc_ids(self) -> pa.Array:
        known = self.keys.select(np.arange(self.n_docs - self.n_null)) + self.low
        return pa.concat_arrays([pa.array(known, pa.int64()), pa.nulls(self.n_null, pa.int64())])

    def bounds(self, i):
        """(start, end) of the i-th documents' ids."""
        i = np.atleast_1d(i)
        start = np.where(i > 0, self.ends.select(np.maximum(i - 1, 0)), 0)
        return start, self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        (start,), (end,) = self.bounds(i)
        return self.ids[start:end]


def _encoder(shared) -> tuple[PieceEncoder, int]:
    path, data = shared.value
    key = f"tokenizers:{path}"
    if key not in _cache:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data.decode())
        # The printable stand-ins of bytes that the vocabulary is written in.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {x: chr(x) for x in plain} | {x: chr(256 + k) for k, x in enumerate(x for x in range(256) if x not in plain)}
        model = tok.model
        one = lambda p: [t.id for t in model.tokenize(p.decode("latin-1").translate(names))]
        width = 2 if tok.get_vocab_size() <= 1 << 16 else 4
        marks = tuple(t.content.encode() for t in tok.get_added_tokens_decoder().values())
        whole = lambda t: tok.encode(t, add_special_tokens=False).ids
        _cache[key] = PieceEncoder(lambda ps: [one(p) for p in ps], whole, REMEMBER, marks), width
    return _cache[key]


def _writer(shared, end_id: int, shard_ids: int):
    """Sorted (doc_id, text) of one range to shard rows."""

    def run(batches):
        encode, width = _encoder(shared)
        part = TaskContext.get().partitionId()
        seq, first = 0, 0
        docs, ends, ids, size = [], [], [], 0

        def flush():
            nonlocal seq, first, size
            keys = pa.concat_arrays(docs)
            known = keys.drop_null().to_numpy()
            raw = pack(known, keys.null_count, np.concatenate(ends), np.concatenate(ids), width)
            row = pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (part, seq, len(keys), size, first)] + [pa.array([raw], pa.binary())],
                ["part", "seq", "n_docs", "n_ids", "first", "shard"],
            )
            seq, first = seq + 1, first + size
            docs.clear(), ends.clear(), ids.clear()
            size = 0
            return row

        for batch in batches:
            b, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets, SLICE):
                got, at = encode(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole = np.insert(got, at[1:], end_id)
                docs.append(batch.column(0).slice(i, j - i).cast(pa.int64()))
                ends.append(at[1:] + np.arange(1, j - i + 1) + size)
                ids.append(whole)
                size += len(whole)
                if size >= shard_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode docs and write the shards in ascending doc_id order; returns the written table.

    part, seq: order of the shards; n_docs, n_ids; first: ids before it in its part; shard: the bytes.
    """
    shared = read_file(docs.sparkSession, tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), F.col("h"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "h").select("doc_id", "text")
    shards = rows.mapInArrow(frugal(_writer(shared, end_id, shard_ids)), "part long, seq long, n_docs long, n_ids long, first long, shard binary")
    return materialise(shards, "token-shards")


def read(shards: DataFrame) -> DataFrame:
    """One row per document, from the written shards alone: doc_id, start (ids of all before it), n_tokens, ids_crc32."""
    # One number per range partition, whose count is a setting; the shards themselves stay where they are.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, total = {}, 0
    for part, n in sorted(map(tuple, parts)):
        before[part], total = total, total + n

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard(batch.column(2)[k].as_buffer())
                base = before[batch.column(0)[k].as_py()] + batch.column(1)[k].as_py()
                start, end = shard.bounds(np.arange(shard.n_docs))
                wide = shard.ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(start.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [shard.doc_ids(), pa.array(start + base), pa.array(end - start), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.select("part", "first", "shard").mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, public_tokenizers.path("byte_bpe_50k.json")))
