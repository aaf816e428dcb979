"""State over streams against the same rule over tables."""

import random

from pyspark.sql import functions as F

from corpuscle.streaming import incremental, states

def args():
    return ("item", "ts", "seq", F.col("kind") == "d", F.col("kind") == "f")


def test_a_stream_that_stops_and_starts_gives_the_answer_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 0
    for i in range(400):
        t += rng.choice([0, 1, 2, 30]) * 1000
        rows.append((rng.choice("aaaabcdefghij") + str(i // 150), t + 3_600_000, i, rng.choice("offod" if i % 3 else "off")))
    rows.append((None, t, 500, "d"))
    flush = [("end", t + 10_000_000, 999, "o")]
    fields = "item string, ms long, seq long, kind string"
    timed = lambda x: spark.createDataFrame(x, fields).select("item", F.timestamp_millis("ms").alias("ts"), "seq", "kind")
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = timed(rows).schema
    for lo in range(0, 401, 101):
        part = rows[lo : lo + 101]
        # Out of order, but no row later than the delay.
        timed(rng.sample(part, len(part))).coalesce(1).write.mode("append").parquet(source)
        with states.stored(spark):
            d = states.decisions(incremental.file_stream(spark, source, schema), *args(), tries=3, patience_us=60_000_000, late="2 hours")
            incremental.run_available(d, incremental.once_per_batch(out), ck)
    timed(flush).coalesce(1).write.mode("append").parquet(source)
    with states.stored(spark):
        incremental.run_available(states.decisions(incremental.file_stream(spark, source, schema), *args(), tries=3, patience_us=60_000_000, late="2 hours"), incremental.once_per_batch(out), ck)
    got = spark.read.schema(states.OUT).parquet(out).drop("batch").collect()
    until = F.timestamp_millis(F.lit(t + 10_000_000 - 7_200_000))
    want = states.decided(timed(rows + flush), *args(), tries=3, patience_us=60_000_000, until=until).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r.status for r in want} == {"done", "skipped", "expired"}


def test_decided_by_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab") + str(rng.randrange(20)), rng.randrange(0, 400) * 1000, i, rng.choice("ofod")) for i in range(200)]
    df = spark.createDataFrame(rows, "item string, ms long, seq long, kind string").select("item", F.timestamp_millis("ms").alias("ts"), "seq", "kind")
    end = max(r[1] for r in rows)
    want = set()
    for item in {r[0] for r in rows}:
        fails, last = 0, None
        for _, ms, _, kind in [*sorted((r for r in rows if r[0] == item and r[1] < end), key=lambda r: r[1:]), (item, end, 0, "")]:
            if last is not None and ms - last > 90_000:
                want.add((item, "expired", fails))
                break
            last, fails = ms, fails + (kind == "f")
            if kind == "d" or (kind == "f" and fails == 2):
                want.add((item, "done" if kind == "d" else "skipped", fails))
                break
    got = states.decided(df, *args(), tries=2, patience_us=90_000_000).collect()
    assert {(r.item, r.status, r.failures) for r in got} == want and len({w[1] for w in want}) == 3
    assert states.decided(df.limit(0), *args(), tries=2, patience_us=1).count() == 0


def test_late_rows_land_in_a_side_table_and_others_find_their_verdicts(spark, tmp_path):
    path = lambda x: str(tmp_path / x)
    put = lambda name, rows, fields: spark.createDataFrame(rows, fields).select("unit", F.timestamp_seconds(F.col("s") + 1000).alias("at" if name == "c" else "told"), *(["verdict"] if name == "v" else [])).coalesce(1).write.mode("append").parquet(path(name))
    c, v = "unit string, s long", "unit string, s long, verdict string"
    steps = [
        ([("a", 0), ("b", 10)], [("a", 30, "good")]),
        ([("c", 4000)], [("b", 5000, "too late for b"), ("c", 4100, "fair")]),
        ([("late", 100), ("edge", 3400), ("near", 3401), ("d", 8000), (None, None)], [("x", 8000, "no candidate")]),
        ([("e", 90000)], [("y", 90000, "no candidate")]),
        ([("f", 99000)], [("z", 99000, "no candidate")]),
    ]
    for cs, vs in steps:
        put("c", cs, c), put("v", vs, v)
        for name in "cv":
            stream = incremental.file_stream(spark, path(name), spark.read.parquet(path(name)).schema)
            incremental.split_late(stream, "at" if name == "c" else "told", "10 minutes", path(name + "-good"), path(name + "-late"), path(name + "-ck"))
        sides = [incremental.file_stream(spark, path(n + "-good"), spark.read.parquet(path(n)).schema, glob="*.parquet").drop("batch") for n in "cv"]
        incremental.run_available(incremental.verdicts_of(*sides, "unit", "at", "told", "10 minutes"), incremental.once_per_batch(path("out")), path("ck"))
    assert {r.unit for r in spark.read.parquet(path("c-late")).collect() if r.unit} == {"late", "edge"}
    got = {(r.unit, r.verdict) for r in spark.read.parquet(path("out")).collect()}
    assert got >= {("a", "good"), ("b", None), ("c", "fair"), ("near", None), ("d", None)} and not {"late", "edge"} & {u for u, _ in got}
    table = incremental.verdicts_of(spark.read.parquet(path("c")), spark.read.parquet(path("v")), "unit", "at", "told", "10 minutes")
    assert {(r.unit, r.verdict) for r in table.collect()} >= got
