"""Sources. Every reader uses an explicit schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from . import corpus_json


@dataclass(frozen=True)
class Config:
    """Settings of a run, from the session's ``spark.corpuscle.*``. Keys of services are never kept here."""

    langs: tuple[str, ...] = schema.LANGS
    low: float = 0.8
    high: float = 0.9
    workers: int | None = None

    @classmethod
    def of(cls, spark: SparkSession) -> Config:
        get = lambda k, d: spark.conf.get(f"spark.corpuscle.{k}", d)
        workers = get("workers", None)
        return cls(tuple(get("langs", ",".join(cls.langs)).split(",")), float(get("low", str(cls.low))), float(get("high", str(cls.high))), int(workers) if workers else None)


def images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def audio(spark: SparkSession, path: str, pattern: str = "*.{mp3,wav,m4a}") -> DataFrame:
    return images(spark, path, pattern)


def ocr_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """lines: one result a line, which splits a large file; else a document or an array a file."""
    return spark.read.schema(schema.OCR).json(path, multiLine=not lines)


def corpus(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """The root documents' units, one row each, with their document's id and languages. A document is read by as many tasks as
    its file has splits; parts: the files of a folder make up one document (corpus_json.write)."""
    return corpus_json.corpus(spark, path, parts)


def boards(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema.BOARD).json(path, multiLine=not lines)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.GLOSSARY).json(path, multiLine=True).select(F.inline("glossary"))


def graded(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A corpus split by grade: one read, grade from the folders, so that filters on it skip files."""
    return spark.read.schema(columns + ", grade string").json(path)


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.REVIEWS).json(path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.PROGRESS).parquet(path)


def tmx(spark: SparkSession, path: str) -> DataFrame:
    """(id, lang, text) rows of a translation memory."""
    units = spark.read.format("xml").option("rowTag", "tu").schema(schema.TMX_UNIT).load(path)
    return units.select(F.col("_tuid").alias("id"), F.inline("tuv")).select("id", F.col("`_xml:lang`").alias("lang"), F.col("seg").alias("text"))
