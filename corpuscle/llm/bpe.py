"""Operator 3: byte-level BPE encoding and decoding.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Neighbouring chunks are stitched
at the first pre-token boundary on which both agree inside their overlap: from there on the later chunk's
boundaries are those of the whole text, since a match depends only on what follows. Pieces between stitches are
then encoded apart and their ids put together in order. Where a chunk never agrees with the one before (one
pre-token longer than the overlap), it and all that follow are joined to that piece and encoded as one: exact,
only less parallel. Texts no longer than a chunk are one piece and are never shuffled. Decoding concatenates the
tokens' raw bytes.

Defined results: null text counts as empty and has no ids; null doc_id is an ordinary value; rows that repeat
doc_id and text get equal results, each its own row; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .pretoken import PieceEncoder, boundaries, slices, text_buffers
from .workers import frugal

CHUNK = 32_768  # bytes
OVERLAP = 1_024
#: Matches that start so near to a chunk's end might go on differently in the whole text.
MARGIN = 8
SLICE = 2_000_000
_IDS = "doc_id long, n_tokens long, ids binary"
_cache: dict[str, object] = {}


def read_file(spark: SparkSession, path: str):
    """The vocabulary file's bytes as a broadcast: about a megabyte, fixed by the vocabulary."""
    ship(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(r) for a, r in (line.split() for line in data.splitlines() if line)}


def _encoder(shared, pattern: str) -> PieceEncoder:
    path, data = shared.value
    key = f"tiktoken:{path}:{pattern}"
    if key not in _cache:
        import tiktoken

        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=_ranks(data), special_tokens={})
        one = enc._encode_single_piece
        _cache[key] = PieceEncoder(lambda pieces: [one(p) for p in pieces], enc.encode_ordinary)
    return _cache[key]


def _vocabulary(shared) -> pa.Array:
    path, data = shared.value
    key = f"vocabulary:{path}"
    if key not in _cache:
        ranks = _ranks(data)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        _cache[key] = pa.array(table, pa.binary())
    return _cache[key]


def _encode_batches(shared, pattern):
    """Batches of (keys..., text) to (keys..., n_tokens, ids)."""

    def run(batches):
        encode = _encoder(shared, pattern)
        for batch in batches:
            b, offsets = text_buffers(batch.column(batch.num_columns - 1))
            for i, j in slices(offsets, SLICE):
                ids, at = encode(b[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                keys = [c.slice(i, j - i) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(at)), out], [*batch.schema.names[:-1], "n_tokens", "ids"])

    return run


def cut_points(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the overlapping chunks of n bytes."""
    return [(s, min(n, s + chunk + overlap)) for s in range(0, max(n - overlap, 1), chunk)]


def _align(raw: bytes, at: int) -> int:
    """The first byte at or after ``at`` that starts a character."""
    while at < len(raw) and (raw[at] & 0xC0) == 0x80:
        at += 1
    return at


def _cut(chunk, overlap):
    """Long texts to chunk rows (doc_id, h, k, base, body)."""

    def run(batches):
        for batch in batches:
            doc, h = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                raw = batch.column(2)[i].as_buffer().to_pybytes()
                for k, (s, e) in enumerate(cut_points(len(raw), chunk, overlap)):
                    s, e = _align(raw, s), _align(raw, e)
                    yield pa.RecordBatch.from_arrays(
                        [doc.slice(i, 1), h.slice(i, 1), pa.array([k], pa.int64()), pa.array([s], pa.int64()), pa.array([raw[s:e]], pa.binary())],
                        ["doc_id", "h", "k", "base", "body"],
                    )

    return run


def _mark(chunk, overlap):
    """Chunk rows with ``head`` and ``tail``: boundaries in the overlaps with the chunk before and the one after."""

    def run(batches):
        for batch in batches:
            heads, tails = [], []
            base = batch.column(3).to_pylist()
            for i in range(batch.num_rows):
                b = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint8)
                starts, unsure = boundaries(b, np.array([0, len(b)]))
                if unsure[0]:
                    starts = starts[:0]
                heads.append(starts[starts < overlap] + base[i])
                # A boundary counts if the match before it began clear of the cut-off end.
                sure = starts[1:][starts[:-1] < len(b) - MARGIN]
                tails.append(sure[(sure >= chunk - MARGIN) & (sure < len(b))] + base[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                [*batch.schema.names, "head", "tail"],
            )

    return run


def _join_ids(batches):
    """(doc_id, h, list of (g, n_tokens, ids) in order) to (doc_id, h, n_tokens, ids)."""
    for batch in batches:
        for i in range(batch.num_rows):
            parts = batch.column(2)[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([sum(p["n_tokens"] for p in parts)], pa.int64()), pa.array([b"".join(p["ids"] for p in parts)], pa.binary())],
                ["doc_id", "h", "n_tokens", "ids"],
            )


def _join_bodies(batches):
    """(doc_id, h, g, list of (k, part) in order) to (doc_id, h, g, text)."""
    for batch in batches:
        texts = [b"".join(p["part"] for p in x.as_py()) for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], ["doc_id", "h", "g", "text"])


def encode_long(docs: DataFrame, shared, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids) of texts longer than a chunk, by chunks, stitches and pieces."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    # Repeated rows are encoded once and joined back.
    once = rows.groupBy("doc_id", "h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    copies = once.select("doc_id", "h", "copies")
    chunks = once.select("doc_id", "h", F.col("text").cast("binary")).mapInArrow(frugal(_cut(chunk, overlap)), "doc_id long, h long, k long, base long, body binary")
    chunks = chunks.repartition("doc_id", "h", "k").mapInArrow(frugal(_mark(chunk, overlap)), "doc_id long, h long, k long, base long, body binary, head array<long>, tail array<long>")
    order = Window.partitionBy("doc_id", "h").orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    chunks = chunks.withColumn("met", met)
    # Chunks count as stitched only up to the first that did not meet the one before.
    lost = F.max(F.when((F.col("k") > 0) & F.col("met").isNull(), 1).otherwise(0)).over(upto)
    chunks = chunks.withColumn("cut", F.when(lost == 0, F.col("met")))
    start = F.coalesce("cut", "base")
    chunks = chunks.withColumns({"g": F.sum(F.when(F.col("cut").isNotNull(), 1).otherwise(0)).over(upto), "start": start})
    stop = F.coalesce(F.lead("start").over(order), F.col("base") + F.octet_length("body"))
    part = F.substring("body", (F.col("start") - F.col("base") + 1).cast("int"), (stop - F.col("start")).cast("int"))
    pieces = chunks.select("doc_id", "h", "g", "k", part.alias("part")).groupBy("doc_id", "h", "g").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"))
    code = _encode_batches(shared, pattern)
    coded = pieces.mapInArrow(frugal(lambda batches: code(_join_bodies(batches))), "doc_id long, h long, g long, n_tokens long, ids binary")
    whole = coded.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct("g", "n_tokens", "ids"))).alias("parts")).mapInArrow(frugal(_join_ids), "doc_id long, h long, n_tokens long, ids binary")
    back = whole.join(copies.withColumnsRenamed({"doc_id": "d", "h": "x"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")))
    return back.select("doc_id", "n_tokens", "ids", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    shared = read_file(docs.sparkSession, ranks_path)
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    short = docs.where(~long).select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(_encode_batches(shared, pattern)), _IDS)
    return short.unionByName(encode_long(docs.where(long).select(F.col("doc_id").cast("long"), "text"), shared, pattern, chunk, overlap))


def _decode_batches(shared, at: int):
    """Batches with ids in column ``at`` to the same with ``bytes`` behind."""

    def run(batches):
        table = _vocabulary(shared)
        size = np.diff(np.frombuffer(table.buffers()[1], np.int32)[: len(table) + 1])
        for batch in batches:
            b, offsets = text_buffers(batch.column(at))
            for i, j in slices(offsets, SLICE):
                ids = np.frombuffer(b[offsets[i] : offsets[j]], "<u4")
                upto = np.concatenate([[0], np.cumsum(size[ids], dtype=np.int64)])
                ends = upto[(offsets[i : j + 1] - offsets[i]) // 4].astype(np.int32)
                data = table.take(pa.array(ids)).buffers()[2] if len(ids) else pa.py_buffer(b"")
                out = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends), data])
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns], out], [*batch.schema.names, "bytes"])

    return run


def decode(coded: DataFrame, ranks_path: str) -> DataFrame:
    """coded with ``bytes``: the raw bytes of each row's ids."""
    shared = read_file(coded.sparkSession, ranks_path)
    schema = T.StructType([*coded.schema, T.StructField("bytes", T.BinaryType())])
    return coded.mapInArrow(frugal(_decode_batches(shared, coded.columns.index("ids"))), schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """decode(encode(docs)), where texts of one chunk are decoded in the task that encoded them."""
    shared = read_file(docs.sparkSession, ranks_path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk
    there, back = _encode_batches(shared, pattern), _decode_batches(shared, 2)
    short = docs.where(~long).mapInArrow(frugal(lambda batches: back(there(batches))), _IDS + ", bytes binary")
    return short.unionByName(decode(encode_long(docs.where(long), shared, pattern, chunk, overlap), ranks_path))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return round_trip(docs, ranks_path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op3_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
