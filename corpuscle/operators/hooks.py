"""Steps that a model, a person or a service does: pluggable providers with deterministic offline stubs.

A provider is a callable on a pandas batch. Batches go through mapInPandas, so a model loads once per task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keeps_text
from ..session import BATCH_ROWS, ship
from .select import judge as _judge


def _map(df: DataFrame, schema: str, provider: Callable[[pd.DataFrame], pd.DataFrame], workers: int | None) -> DataFrame:
    """workers: at most so many batches at once, for services with a rate limit."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)

    # A limit holds for the provider alone: what comes before it keeps its own tasks.
    return (df.repartition(workers) if workers else df).mapInPandas(run, schema)


def ocr(images: DataFrame, provider: Callable | None = None, workers: int | None = None) -> DataFrame:
    """binaryFile rows to (image, text, confidence). The stub reads UTF-8 bytes; what isn't that fails (null text)."""
    return _map(images.select(F.col("path").alias("image"), "content"), "image string, text string, confidence double", provider or stub_ocr, workers)


def stub_ocr(batch: pd.DataFrame) -> pd.DataFrame:
    def read(raw):
        try:
            text = bytes(raw).decode()
        except UnicodeDecodeError:
            return None, None
        good = sum(n for c, n in Counter(text).items() if c.isalnum() or c.isspace() or c in ".,;:!?")
        return text, good / len(text) if text else 0.0

    out = [read(x) for x in batch["content"]]
    return pd.DataFrame({"image": batch["image"], "text": [t for t, _ in out], "confidence": pd.Series([c for _, c in out], dtype="float64")})


def enhance(boards: DataFrame, provider: Callable | None = None, workers: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(board, zh, en) to (board, p, s, zh, en, kept): provider's sentence pairs; ``kept`` tells whether they only split
    what was there. carry: columns of the board that all its rows get, so that they need no join."""
    use, schema = provider or stub_enhance, "board string, p int, zh string, en string, zh_parts array<string>, en_parts array<string>"

    def carried(batch: pd.DataFrame) -> pd.DataFrame:
        known = batch.dropna(subset="board").drop_duplicates("board").set_index("board")[list(carry)]
        return use(batch[["board", "zh", "en"]]).join(known, on="board", how="inner")

    fields = "".join(f", {c} {boards.schema[c].dataType.simpleString()}" for c in carry)
    rows = _map(boards.select("board", "zh", "en", *carry), schema + fields, carried if carry else use, workers)
    kept = keeps_text(F.col("zh"), F.col("zh_parts")) & keeps_text(F.col("en"), F.col("en_parts"))
    parts = rows.select("board", "p", kept.alias("kept"), *carry, F.posexplode(F.arrays_zip("zh_parts", "en_parts")).alias("s", "x"))
    return parts.select("board", "p", "s", F.col("x.zh_parts").alias("zh"), F.col("x.en_parts").alias("en"), "kept", *carry)


def stub_enhance(batch: pd.DataFrame) -> pd.DataFrame:
    import re

    rows = []
    for b in batch.itertuples():
        zh, en = (b.zh or "").split("\n"), (b.en or "").split("\n")
        for p in range(max(len(zh), len(en))):
            z, e = (x[p] if p < len(x) else "" for x in (zh, en))
            zs = [x for x in re.split(r"(?<=[。！？])", z) if x.strip()]
            es = [x for x in re.split(r"(?<=[.!?])\s+", e) if x.strip()]
            n = max(len(zs), len(es))
            rows.append((b.board, p, z, e, zs + [""] * (n - len(zs)), es + [""] * (n - len(es))))
    return pd.DataFrame(rows, columns=["board", "p", "zh", "en", "zh_parts", "en_parts"])


_CANDIDATES = "unit_id string, lang string, model string, text string, score double"


def _unbeaten(batch: pd.DataFrame) -> pd.DataFrame:
    """The candidates that none of the batch outscores (null scores lose), one of each model and score, with ``n``: the sum over
    those of a (unit_id, lang) is the number of its candidates in the batch."""
    keys = ["unit_id", "lang"]
    batch = batch.assign(score=batch["score"].astype("float64"))
    by = batch.groupby(keys, dropna=False, sort=False)
    best = by["score"].transform("max")
    batch = batch.assign(n=by["score"].transform("size"))[(batch["score"] == best) | best.isna()].drop_duplicates([*keys, "score", "model"])
    return batch.assign(n=batch["n"].where(~batch.duplicated(keys), 0))


def _folded(candidates: DataFrame, provider: Callable, workers: int | None) -> DataFrame:
    """The provider's candidates, folded by _unbeaten() where they are made."""
    return _map(candidates, f"{_CANDIDATES}, n long", lambda batch: _unbeaten(provider(batch)), workers)


def translate(units: DataFrame, langs, models, provider: Callable | None = None, workers: int | None = None, fold: bool = False) -> DataFrame:
    """(unit_id, text) to candidates (unit_id, lang, model, text, score): every language by every model. fold: for judge() alone,
    without what is outscored in its batch; ``n`` tells for how many candidates a row stands."""
    grid = units.select("unit_id", "text", F.explode(F.array(*[F.lit(x) for x in langs])).alias("lang"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return _folded(grid, provider or stub_translate, workers) if fold else _map(grid, _CANDIDATES, provider or stub_translate, workers)


def stub_translate(batch: pd.DataFrame) -> pd.DataFrame:
    import hashlib

    text = batch["lang"] + ":" + batch["model"] + ":" + batch["text"].fillna("")
    return pd.DataFrame({"unit_id": batch["unit_id"], "lang": batch["lang"], "model": batch["model"], "text": text, "score": [int(hashlib.md5(x.encode()).hexdigest()[:12], 16) / 2**48 for x in text]})


def judge(candidates: DataFrame, provider: Callable | None = None, workers: int | None = None) -> DataFrame:
    """The chosen candidate of each (unit_id, lang). With a provider, scores are its own; else as given."""
    if provider:
        if "n" in candidates.columns:
            raise ValueError("a provider must see all candidates, and these are folded")
        candidates = _folded(candidates.select("unit_id", "lang", "model", "text", "score"), provider, workers)
    folded = "n" in candidates.columns
    rows = candidates.withColumn("tie", _tie("model"))
    # A partial aggregate would sort the whole texts of a task; folded rows are shuffled as they are.
    rows = rows.repartition("unit_id", "lang") if folded else rows
    return _judge(rows, ["unit_id", "lang"], "score", "tie", "model", "text", n="n" if folded else None).drop("tie")


_OFFER = pa.list_(pa.struct([("lang", pa.string()), ("model", pa.string()), ("text", pa.string())]))


def offers(rows: DataFrame, langs, models, translator: Callable | None = None, judger: Callable | None = None) -> DataFrame:
    """rows (unit_id, text, further columns) with ``offers`` for ``text``: of all candidates of the unit_id, in every language
    by every model, those that none outscores (several where scores tie), for first_offers().

    A unit_id's rows must stand together, in one partition: then its candidates are folded where they are made, also those of
    several rows, and no translation is shuffled. Providers get whole rows' candidates, about as many as an Arrow batch has rows.
    """
    ship(rows.sparkSession)
    grid, columns = [(x, m) for x in langs for m in models], ["unit_id", "lang", "model", "text", "score"]
    rest, size = [c for c in rows.columns if c != "text"], int(rows.sparkSession.conf.get(BATCH_ROWS[0]))
    step, translator = max(1, (size if size > 0 else 1 << 30) // max(1, len(grid))), translator or stub_translate

    def made(part: pa.RecordBatch) -> pd.DataFrame:
        n = part.num_rows
        every = part.select(["unit_id", "text"]).to_pandas().iloc[np.repeat(np.arange(n), len(grid))].reset_index(drop=True)
        found = translator(every.assign(lang=[x for x, _ in grid] * n, model=[m for _, m in grid] * n))[columns]
        return _unbeaten(judger(found) if judger else found)[columns]

    def told(part: pa.RecordBatch, found: pd.DataFrame) -> pa.RecordBatch:
        ids, found = part["unit_id"].to_numpy(zero_copy_only=False), found.sort_values("unit_id", kind="stable")
        low, high = (np.searchsorted(found["unit_id"].to_numpy(dtype=object), ids, side) for side in ("left", "right"))
        ends = np.concatenate([[0], np.cumsum(high - low)])
        places = np.arange(ends[-1]) + np.repeat(low - ends[:-1], high - low)
        values = [pa.array(found[c].to_numpy(dtype=object)[places], pa.string(), from_pandas=True) for c in _OFFER.value_type.names]
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=list(_OFFER.value_type)))
        return pa.RecordBatch.from_arrays([*(part[c] for c in rest), listed], [*rest, "offers"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of the last unit_id wait, with what stands of their candidates, for others that may follow.
        wait, best, last = [], None, None
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                found = made(part)
                if best is not None:
                    found = _unbeaten(pd.concat([best, found], ignore_index=True))[columns]
                ids = part["unit_id"].to_numpy(zero_copy_only=False)
                begin = int(np.argmax(ids == ids[-1]))
                if ids[-1] != last:
                    yield from (told(x, found) for x in [*wait, part.slice(0, begin)] if x.num_rows)
                    wait, last = [], ids[-1]
                wait.append(part.slice(begin))
                best = found[found["unit_id"] == last]
        yield from (told(x, best) for x in wait)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest)
    return rows.mapInArrow(run, f"{fields}, offers array<struct<lang:string,model:string,text:string>>")


def first_offers(found: Column) -> Column:
    """Of offers(), the one of each language that judge() takes: (lang, tie, text), by language."""
    return firsts(F.sort_array(F.transform(found, lambda x: F.struct(x["lang"].alias("lang"), _tie(x["model"]).alias("tie"), x["text"].alias("text")))))


def firsts(entries: Column) -> Column:
    """The first of each ``lang`` of a sorted array."""
    start = F.slice(entries, 1, 0)
    return F.aggregate(entries, start, lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["lang"] == x["lang"]), a).otherwise(F.array_append(a, x)))


def _tie(model) -> Column:
    return F.xxhash64(model).bitwiseAND(F.lit((1 << 62) - 1))


def repair(gaps: DataFrame, provider: Callable | None = None, workers: int | None = None) -> DataFrame:
    """Missing texts (unit_id, lang, source) to a model's repairs (unit_id, lang, method, text), as repair.fill takes them."""
    return _map(gaps.select("unit_id", "lang", "source"), "unit_id string, lang string, method string, text string", provider or stub_repair, workers)


def stub_repair(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"unit_id": batch["unit_id"], "lang": batch["lang"], "method": "model", "text": batch["lang"] + ":" + batch["source"].fillna("")})


def visual_check(joined: DataFrame, provider: Callable | None = None, workers: int | None = None) -> DataFrame:
    """(image, content, text) to (image, text, ok). The stub compares with what the OCR stub reads."""
    return _map(joined.select("image", "content", "text"), "image string, text string, ok boolean", provider or stub_visual, workers)


def stub_visual(batch: pd.DataFrame) -> pd.DataFrame:
    read = stub_ocr(batch)["text"]
    return pd.DataFrame({"image": batch["image"], "text": batch["text"], "ok": [a == b for a, b in zip(read, batch["text"])]})


def transcribe(audio: DataFrame, provider: Callable | None = None, workers: int | None = None) -> DataFrame:
    """binaryFile rows to segments (path, ordinal, start_s, end_s, text). The stub reads one line a segment, 0.1 s a character."""
    return _map(audio.select("path", "content"), "path string, ordinal int, start_s double, end_s double, text string", provider or stub_transcribe, workers)


def stub_transcribe(batch: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for b in batch.itertuples():
        at = 0.0
        for k, line in enumerate(bytes(b.content).decode("utf-8", "replace").splitlines()):
            rows.append((b.path, k, at, at + 0.1 * len(line), line))
            at += 0.1 * len(line)
    return pd.DataFrame(rows, columns=["path", "ordinal", "start_s", "end_s", "text"])
