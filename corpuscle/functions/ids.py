"""Unit ids: museum, image stem, paragraph and sentence ordinals (0-based)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Read from the right: a museum's name may hold underscores.
ID_PATTERN = r"^(.+)_([^_]+)_p(\d+)s(\d+)$"


def compose_id(museum: Column, stem: Column, p: Column, s: Column) -> Column:
    return F.concat_ws("_", museum, stem, F.concat(F.lit("p"), p.cast("string"), F.lit("s"), s.cast("string")))


def parse_id(unit_id: Column) -> Column:
    """struct<museum, stem, p, s>; p and s are null where the id doesn't fit."""
    part = lambda k: F.regexp_extract(unit_id, ID_PATTERN, k)
    return F.struct(part(1).alias("museum"), part(2).alias("stem"), F.try_to_number(part(3), F.lit("999999999")).cast("int").alias("p"), F.try_to_number(part(4), F.lit("999999999")).cast("int").alias("s"))


def image_stem(image: Column) -> Column:
    return F.regexp_replace(image, r"\.[^.]+$", "")
