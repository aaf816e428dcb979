"""Operator 12: whole round trips through archives, against plain Python."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import warc

SCHEMA = "page_id long, url string, html string, captured long"


def brute(rows):
    held = {}
    for page, _, html, _ in rows:
        h = (html or "").encode()
        if len(h) >= 1000 and page is not None:
            held[h] = max(held.get(h, page), page)
    many = [(r[2] or "").encode() for r in rows]
    out = []
    for page, url, html, at in rows:
        h = (html or "").encode()
        last = held.get(h) if many.count(h) > 1 else None
        revisit = last is not None and last != page
        key = warc.url_key(warc._uri(url or ""))
        out.append((warc.order_key(key, at or 0, page, hashlib.sha1(h).hexdigest()), (page, len(h), hashlib.sha1(h).hexdigest(), "revisit" if revisit else "response", last if revisit else None, key)))
    return [x for _, x in sorted(out)]


def run(spark, rows, archive_bytes=3000, run_size=7, step=3):
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    archives = warc.write(pages, F.col("captured"), archive_bytes)
    index = warc.positions(warc.merged(warc.read_runs(archives, run_size), step))
    got = index.sort("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    return archives, got


def fields(r):
    return (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url_key)


def some(n=200, seed=0):
    rng = random.Random(seed)
    big = ["é" * 600, "x" * 1000, "y" * 999, "long " * 50_000, "", None]
    urls = ["http://Hot.example.org/a?b=1#c", "https://www.b.example.org", None, "http://u:p@a.example.org:80/é x\r\nX: y", "no scheme#x"]
    return [(i, rng.choice(urls[:1] * 6 + urls), rng.choice([*big, f"<p>{i}</p>" * 200]), rng.choice([0, 5, 5, -7, None])) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"archive_bytes": 1, "run_size": 1, "step": 1}, {"archive_bytes": 10**9, "run_size": 10**6, "step": 64}])
def test_round_trip_and_order(spark, how):
    rows = some()
    archives, got = run(spark, rows, **how)
    assert list(map(fields, got)) == brute(rows)
    by = {(r.part, r.seq): bytes(r.archive) for r in archives.collect()}
    for r in got[::17]:
        head, block = warc.fetch(by[r.part, r.seq], r.offset, r.length)
        assert head["warc-type"] == r.record_type
        payload = block.partition(b"\r\n\r\n")[2]
        html = (rows[r.page_id][2] or "").encode()
        assert payload == (html if r.record_type == "response" else b"")


def test_archives_are_plain_gzip_of_warc_records(spark):
    rows = some(30)
    archives = warc.write(spark.createDataFrame(rows, SCHEMA), F.col("captured"))
    ids, refers = [], []
    for r in archives.collect():
        plain = gzip.decompress(bytes(r.archive))
        assert plain.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        for _, _, one in warc.members(bytes(r.archive)):
            head, _ = warc.parse(one)
            ids.append(head["warc-record-id"])
            refers.append(head.get("warc-refers-to"))
    assert len(ids) == len(set(ids)) and {x for x in refers if x} <= set(ids) and any(refers)


def test_repeated_rows_and_null_ids(spark):
    page = "z" * 2000
    rows = [(5, "http://a.b/", page, 1), (5, "http://a.b/", page, 1), (3, "http://a.b/", page, 1), (None, "http://a.b/", page, 1), (None, None, "w" * 1500, None), (None, None, "w" * 1500, None), (9, "http://a.b/", "short", 1), (8, "http://a.b/", "short", 1)]
    _, got = run(spark, rows)
    assert list(map(fields, got)) == brute(rows)
    assert sorted(r.record_type for r in got) == ["response"] * 6 + ["revisit"] * 2


def test_empty_table_and_further_columns(spark):
    assert run(spark, [])[1] == []
    pages = spark.createDataFrame([(1, "http://a.b/c", "x" * 1200, 0), (2, "http://a.b/c", "x" * 1200, 0)], SCHEMA)
    more = pages.withColumns({c: F.lit("?") for c in ("key", "held", "holder", "revisit", "range", "run", "at")})
    got = warc.positions(warc.merged(warc.read_runs(warc.write(more, F.col("captured"))))).sort("position").collect()
    assert [(r.page_id, r.refers_to) for r in got] == [(1, 2), (2, None)]


def test_history_of_one_url(spark):
    rows = [(i, "http://one.example/x" if i % 3 else f"http://two.example/{i}", f"{i}", 100 - i) for i in range(60)]
    index = warc.merged(warc.read_runs(warc.write(spark.createDataFrame(rows, SCHEMA), F.col("captured")), 5), 2)
    got = warc.history(index, "https://www.one.example:443/x#part").collect()
    assert [r.page_id for r in got] == [i for i in range(59, -1, -1) if i % 3]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted((0, rng.choice("abc").encode(), rng.randrange(9)) for _ in range(rng.choice([0, 1, 40]))) for _ in range(k)]
    assert [runs[r][i] for r, i in warc.loser_tree(runs)] == sorted(x for r in runs for x in r)


def test_damaged_archives_are_found():
    one = warc.record([("WARC-Type", "response")], b"block")
    with pytest.raises(ValueError):
        list(warc.members(one[:-3]))
    head, block = warc.parse(next(warc.members(one))[2])
    assert block == b"block" and head["warc-type"] == "response"
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nblock\r\n\r\n")
