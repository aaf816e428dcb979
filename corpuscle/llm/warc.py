"""Operator 12: WARC archives and their capture index.

Writing: payloads of at least ``LEAST`` bytes are compared by SHA-256 and length; of equal ones the page of largest page_id is
stored as a response, the others as revisits that name it and hold no payload. Each record is a gzip member of its own, so
an index entry (archive, offset, length) is enough to read it. An archive is one binary value of about ``ARCHIVE`` bytes;
archives are rows of a Parquet table, so that Spark's own commit protocol places them in any store it can write.

Reading: archives are read member by member, payload digests are computed again and compared with the header. Each task sorts
the captures it has read, ``RUN`` at a time, by URL key (host labels reversed), capture time and page_id: the runs of an
external merge sort. Evenly spaced samples of all runs give the bounds of ranges, one a shuffle partition; each range
gathers a slice of every run and merges the slices by a loser tree. Ranges in order make up one globally ordered index,
in which the captures of a URL stand together in order of time. One URL with many captures is cut by time and page_id
like any others, and payloads never take part: only index entries move.

Defined results: null html is an empty payload; null url is written without WARC-Target-URI and has the key '' (first);
blanks and control characters of a url are percent-encoded; null capture times are those of the epoch; a null page_id
is written without one, is less than every other as a payload's holder and comes last among ties in the index; rows that
repeat page_id and payload are all responses or all revisits alike; an empty table gives no archive and an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, ship
from .workers import frugal

LEAST = 1000
#: Compressed bytes of an archive, after which the next one begins.
ARCHIVE = 8_000_000
LEVEL = 4
#: Captures of a sorted run, and every so many-th is a sample for the bounds of ranges.
RUN, STEP = 50_000, 16
_CHUNK = 16_384
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# One record ------------------------------------------------------------------------------------------------------


def _date(seconds: int) -> str:
    return (_EPOCH + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _urn(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(':'.join(map(str, parts)).encode()).digest())}>"


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    plain = b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(plain) + deflate.flush()


def members(raw) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member."""
    at, raw = 0, memoryview(raw)
    while at < len(raw):
        inflate, parts, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if pos >= len(raw):
                raise ValueError("an archive ends inside a record")
            chunk = raw[pos : pos + _CHUNK]
            parts.append(inflate.decompress(chunk))
            pos += len(chunk)
        end = pos - len(inflate.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, found, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip(" \t") for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a WARC record of another length than its header says")
    return fields, rest[:size]


def fetch(archive: bytes, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, without the rest of the archive."""
    return parse(zlib.decompressobj(31).decompress(archive[offset : offset + length]))


_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?")


def url_key(url: str) -> str:
    """Host labels reversed, without scheme, user, default port and www; then path and query: hosts of a domain sort together."""
    m = _URL.match(url)
    if not m:
        return url.partition("#")[0].lower()
    host = re.sub(r":(80|443)$", "", m[1].rpartition("@")[2].lower())
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/") + (m[3] or "")


# Writing ---------------------------------------------------------------------------------------------------------

_ARCHIVES = "part long, seq long, n_records long, archive binary"


def _record(row: dict, own: tuple) -> bytes:
    html, page, holder = row["html"] or b"", row["page_id"], row["holder"]
    digest = hashlib.sha1(html)
    revisit = row["revisit"]
    held = holder is not None and not revisit  # others refer to it by name
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn("page", page, digest.hexdigest()) if held else _urn(*own)),
        ("WARC-Date", _date(row["captured"])),
        ("WARC-Target-URI", None if row["url"] is None else _uri(row["url"])),
        ("WARC-Payload-Digest", _sha1(digest.digest())),
        ("Page-Id", page),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", _PROFILE),
            ("WARC-Refers-To", _urn("page", holder, digest.hexdigest())),
            ("WARC-Refers-To-Target-URI", None if row["holder_url"] is None else _uri(row["holder_url"])),
            ("WARC-Refers-To-Date", _date(row["holder_captured"])),
            ("Refers-To-Page-Id", holder),
        ]
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    return record(fields, answer if revisit else answer + html)


def _writer(archive_bytes: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        seq, size, n, out = 0, 0, 0, []

        def begin():
            return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn("info", part, seq)), ("WARC-Date", _date(0)), ("Content-Type", "application/warc-fields")], b"software: corpuscle\r\nformat: WARC File Format 1.1\r\n")

        def flush():
            nonlocal seq, size, n
            values = [pa.array([x], pa.int64()) for x in (part, seq, n)] + [pa.array([b"".join([begin(), *out])], pa.binary())]
            seq, size, n = seq + 1, 0, 0
            out.clear()
            return pa.RecordBatch.from_arrays(values, ["part", "seq", "n_records", "archive"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}
                out.append(_record(row, ("record", part, seq, n)))
                size, n = size + len(out[-1]), n + 1
                if size >= archive_bytes:
                    yield flush()
        if out:
            yield flush()

    return run


def write(pages: DataFrame, captured: Column, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Archives of all pages (page_id, url, html), in no order; captured: seconds since the epoch."""
    ship(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(captured.cast("long"), F.lit(0)).alias("captured"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"),
    )
    key = F.when(F.octet_length("html") >= LEAST, F.concat_ws(":", F.sha2("html", 256), F.octet_length("html").cast("string"))).alias("key")
    # Payloads that occur once need no holder; this table is written, so that Spark knows its size before it joins.
    holder = F.max(F.struct("page_id", "url", "captured")).alias("h")
    repeated = rows.select(key, "page_id", "url", "captured").where("key is not null").groupBy("key").agg(holder, F.count("*").alias("k")).where("k > 1 and h.page_id is not null")
    repeated = materialise(repeated.select(F.col("key").alias("held"), F.col("h.page_id").alias("holder"), F.col("h.url").alias("holder_url"), F.col("h.captured").alias("holder_captured")), "warc-repeated")
    told = rows.withColumn("key", key).join(repeated, F.col("key") == F.col("held"), "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    told = told.select("page_id", "url", "captured", "html", "holder", "holder_url", "holder_captured", revisit.alias("revisit"))
    return materialise(told.mapInArrow(frugal(_writer(archive_bytes)), _ARCHIVES), "warc-archives")


# Reading and index -----------------------------------------------------------------------------------------------

_ENTRY = "url_key string, captured long, page_id long, payload_digest string, payload_bytes long, record_type string, refers_to long, part long, seq long, offset long, length long"
_NAMES = [x.split()[0] for x in _ENTRY.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in _ENTRY.split(", ")]


def _capture(fields: dict[str, str], block: bytes) -> tuple | None:
    """What the index has of a record; None for records that are no captures."""
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record says")
    number = lambda k: int(fields[k]) if k in fields else None
    seconds = int((datetime.strptime(fields["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc) - _EPOCH).total_seconds())
    return url_key(fields.get("warc-target-uri", "")), seconds, number("page-id"), digest.hex(), size, kind, number("refers-to-page-id")


def order_key(url: str, captured: int, page_id: int | None, digest: str) -> tuple:
    return 0, url.encode(), captured, page_id is None, page_id or 0, digest


def _runs(run_size: int):
    """Archives to sorted runs of captures: run, at (place in it) and the entry."""

    def run(batches):
        part, seq, entries = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal seq
            entries.sort(key=lambda e: order_key(*e[:4]))
            cols = [pa.array([part << 24 | seq] * len(entries), pa.int64()), pa.array(range(len(entries)), pa.int64())]
            cols += [pa.array(x, t) for x, t in zip(zip(*entries), _TYPES)]
            seq += 1
            entries.clear()
            return pa.RecordBatch.from_arrays(cols, ["run", "at", *_NAMES])

        for batch in batches:
            for k in range(batch.num_rows):
                place = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for offset, length, plain in members(batch.column(2)[k].as_buffer()):
                    got = _capture(*parse(plain))
                    if got:
                        entries.append((*got, *place, offset, length))
                        if len(entries) >= run_size:
                            yield flush()
        if entries:
            yield flush()

    return run


def read_runs(archives: DataFrame, run_size: int = RUN) -> DataFrame:
    """The captures of all archives as sorted runs, written."""
    ship(archives.sparkSession)
    return materialise(archives.select("part", "seq", "archive").mapInArrow(frugal(_runs(run_size)), "run long, at long, " + _ENTRY), "warc-runs")


_END = (1,)


def loser_tree(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """Merges sorted runs of order keys: (run, place) in order. Inner nodes keep the loser of their match, so that each step
    replays the winner's path alone."""
    k = len(runs)
    at = [0] * k
    heads = [r[0] if r else _END for r in runs]
    won, lost = [0] * k + list(range(k)), [0] * max(k, 1)
    for i in range(k - 1, 0, -1):
        a, b = won[2 * i], won[2 * i + 1]
        won[i], lost[i] = (b, a) if heads[b] < heads[a] else (a, b)
    w = won[1] if k > 1 else 0
    while k and heads[w] is not _END:
        yield w, at[w]
        at[w] += 1
        heads[w] = runs[w][at[w]] if at[w] < len(runs[w]) else _END
        i = (w + k) // 2
        while i:
            if heads[lost[i]] < heads[w]:
                lost[i], w = w, lost[i]
            i //= 2


def _bounds(runs: DataFrame, step: int) -> list[tuple]:
    """First keys of the ranges: as many as shuffle partitions at most, like the bounds of Spark's own sorts."""
    key = [F.col("url_key"), F.col("captured"), F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page"), F.col("payload_digest")]
    # Each run starts its samples elsewhere: many short runs would give little but their first keys otherwise.
    samples = runs.where(F.pmod(F.col("at") + F.xxhash64("run"), F.lit(step)) == 0).select(*key)
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    firsts = samples.repartitionByRange(n, *samples.columns).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*samples.columns)).alias("k"))
    return sorted((0, r.k.url_key.encode(), *r.k[1:]) for r in firsts.collect())[1:]


def merged(runs: DataFrame, step: int = STEP) -> DataFrame:
    """The index: entries with ``range`` and ``place`` in it; ranges in order, and places in them, are the global order."""
    bounds = _bounds(runs, step)

    def deal(batches):
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _NAMES[:4]))
            ranges = [bisect_right(bounds, order_key(*k)) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), *batch.columns], ["range", *batch.schema.names])

    def merge(key, table):
        table = table.sort_by([("run", "ascending"), ("at", "ascending")])
        keys = [order_key(*k) for k in zip(*(table[c].to_pylist() for c in _NAMES[:4]))]
        numbers = table["run"].to_pylist()
        starts = [i for i, x in enumerate(numbers) if not i or x != numbers[i - 1]]
        slices = [keys[i:j] for i, j in zip(starts, [*starts[1:], len(keys)])]
        order = [starts[r] + i for r, i in loser_tree(slices)]
        return table.select(["range", *_NAMES]).take(pa.array(order, pa.int64())).append_column("place", pa.array(range(len(order)), pa.int64()))

    dealt = runs.mapInArrow(deal, "range long, run long, at long, " + _ENTRY)
    return materialise(dealt.groupBy("range").applyInArrow(merge, "range long, " + _ENTRY + ", place long"), "warc-index")


def positions(index: DataFrame) -> DataFrame:
    """index with position, from 0, in the global order; one row a range is summed up for it."""
    sizes = index.groupBy("range").agg(F.count("*").alias("n"))
    bases = sizes.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("base"))
    return index.join(bases, F.col("range") == F.col("r")).withColumn("position", F.col("base") + F.col("place")).drop("r", "base")


def history(index: DataFrame, url: str) -> DataFrame:
    """All captures of a URL, in order; the filter reaches the index's files."""
    return positions(index).where(F.col("url_key") == url_key(url)).sort("position")


def op12_warc_index(spark, sf_dir: str) -> DataFrame:
    """Pages have no capture time: page_id stands for it, in seconds."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    index = merged(read_runs(write(pages, F.pmod(F.col("page_id").cast("long"), F.lit(1 << 31)))))
    return positions(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position")


OP12_SQL = r"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS h FROM pages),
k AS (SELECT h, max(page_id) AS holder FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1),
u AS (SELECT p.*, k.holder, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://') AS whole,
regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query FROM p LEFT JOIN k ON p.h = k.h),
r AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN holder IS NULL OR holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN holder != page_id OR page_id IS NULL THEN holder END AS refers_to,
CASE WHEN whole THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query ELSE lower(regexp_replace(url, '#.*', '')) END AS url_key FROM u)
SELECT *, row_number() OVER (ORDER BY url_key, coalesce((page_id % 2147483648 + 2147483648) % 2147483648, 0), page_id NULLS LAST, payload_digest) - 1 AS position FROM r"""
