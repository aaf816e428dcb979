"""All stages in one call: images to graded, exported units, each stage a DataFrame to DataFrame function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import nonblank
from ..operators import grading, hooks, repair, units
from ..session import discard, materialise, release
from ..sources import readers, writers

#: Compression of the exports: each holds every text in every language.
EXPORT = "gzip"


def build(
    spark: SparkSession,
    images: DataFrame,
    museum_of: Callable,
    out: str,
    reviews: DataFrame | None = None,
    repairs: DataFrame | None = None,
    done: DataFrame | None = None,
    english: DataFrame | None = None,
    targets=("ja", "es", "bg"),
    models=("m1", "m2"),
    config: readers.Config | None = None,
    providers: dict | None = None,
    keep: bool = True,
) -> DataFrame:
    """Recognise, review, split and align, check, translate, judge, repair, grade and export.

    images: binaryFile rows; museum_of: image column to museum column; english: (image, en), the boards' English side;
    done: (image) of earlier runs, skipped. Results of models are written once per stage, so that a retry doesn't ask
    again, and deleted when the units are. Exports but the progress are gzip files. Returns the units; keep=False: as the graded
    export has them, and their own table is deleted.
    """
    config, use = config or readers.Config.of(spark), providers or {}
    if done is not None:
        images = repair.pending(images, done.select(F.col("image").alias("path")), "path")
    seen = materialise(hooks.ocr(images, use.get("ocr"), config.workers), "stage-ocr")
    read = seen.where("text is not null")
    if reviews is not None:
        decisions = grading.latest(reviews, "item", F.col("reviewed_at"), F.xxhash64("action", "corrected_text")).withColumnRenamed("item", "image")
        read = grading.review_overlay(read, decisions, "image")
    else:
        read = read.withColumns({"action": F.lit(None).cast("string"), "final": F.col("text")})
    board = read.select(F.col("image").alias("board"), F.col("final").alias("zh"), "confidence", F.col("action").isNotNull().alias("reviewed"))
    board = board.join(english.select(F.col("image").alias("board"), "en"), "board", "left") if english is not None else board.withColumn("en", F.lit(""))
    parts = materialise(hooks.enhance(board, use.get("enhance"), config.workers, ("confidence", "reviewed")), "stage-enhance")
    discard(seen)
    stem = ids.image_stem(F.element_at(F.split("board", "/"), -1))
    unit_id = ids.compose_id(museum_of(F.col("board")), stem, F.col("p"), F.col("s"))
    grade = grading.grade(F.col("confidence"), F.col("reviewed"), config.low, config.high)
    sent = parts.where("kept").select(unit_id.alias("unit_id"), museum_of(F.col("board")).alias("museum"), F.element_at(F.split("board", "/"), -1).alias("image"), grade.alias("grade"), "zh", "en")
    # By ranges of unit_id: the one shuffle of texts. Translations are made, judged and put together behind it, and like texts stay together.
    near = sent.repartitionByRange(*([config.workers] if config.workers else []), "unit_id").sortWithinPartitions("unit_id")
    same = Window.partitionBy("unit_id")
    least = {x: F.min(F.when(nonblank(F.col(x)), F.col(x))).over(same) for x in ("zh", "en")}
    told = hooks.offers(near.select("unit_id", "museum", "image", "grade", F.col("zh").alias("text"), *[c.alias(x) for x, c in least.items()]), targets, models, use.get("translate"), use.get("judge"))
    told = told.withColumn("chosen", hooks.first_offers(F.col("offers"))).drop("offers")
    entry = lambda lang, text: F.struct(lang.alias("lang"), text.alias("text"))
    stages = [parts]
    if repairs is None:
        every = F.concat(F.array(*[entry(F.lit(x), F.col(x)) for x in least]), F.transform("chosen", lambda x: entry(x["lang"], x["text"])))
        every = hooks.firsts(F.sort_array(F.filter(every, lambda x: nonblank(x["text"]))))
        some = F.col("zh").isNotNull() | F.col("en").isNotNull() | F.exists("chosen", lambda x: nonblank(x["text"]))
        result = told.where(some).withColumn("translations", F.map_from_entries(every))
    else:
        judged = materialise(told, "stage-judge")
        stages.append(judged)
        gold = sent.select("unit_id", F.explode(F.array(*[entry(F.lit(x), F.col(x)) for x in least])).alias("x")).select("unit_id", "x.*")
        rows = gold.unionByName(judged.select("unit_id", F.explode("chosen").alias("x")).select("unit_id", "x.lang", "x.text"))
        rows = repair.fill(rows, repairs, ["unit_id", "lang"]).select("unit_id", "lang", F.col("final").alias("text"))
        # By unit first, so that texts are shuffled once for both groupings and the join.
        texts = units.to_map(rows.where(nonblank(F.col("text"))).repartition("unit_id"), "unit_id")
        result = judged.select("unit_id", "museum", "image", "grade").join(texts, "unit_id")
    source = F.struct("museum", "image", F.lit(None).cast("string").alias("title_zh"), F.lit(None).cast("string").alias("title_en"))
    result = result.select(F.col("unit_id").alias("id"), source.alias("source"), "grade", "translations")
    result = materialise(result, "stage-units")
    boards = materialise(parts.where("kept").select(F.col("board").alias("item")).distinct(), "stage-boards")
    discard(*stages)
    # What is shuffled for an export comes before the exports that need no shuffle, when little is written yet.
    for lang in config.langs:
        # By ranges of id, which serve the grouping and the order of lines.
        line = result.select("id", F.element_at("translations", lang).alias(lang)).repartitionByRange("id").groupBy("id").agg(F.min(lang).alias(lang))
        writers.parallel_text(line, f"{out}/text", "id", [lang], EXPORT)
        release(spark)
    writers.tmx_units(result, config.langs, f"{out}/tmx", EXPORT)
    writers.by_grade(result, f"{out}/graded", EXPORT)
    if not keep:
        discard(result)
        result = readers.graded(spark, f"{out}/graded", f"id string, source {result.schema['source'].dataType.simpleString()}, translations map<string,string>")
    writers.json_rows(result.select("id", "source", "translations"), f"{out}/json", EXPORT)
    writers.append_progress(boards.select("item", F.lit("units").alias("stage"), F.lit("done").alias("status"), F.current_timestamp().alias("at")), f"{out}/progress")
    discard(boards)
    release(spark)
    return result
