"""Sinks. Writers return nothing; export edges alone gather rows into one file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import nonblank


def json_rows(df: DataFrame, path: str, compression: str | None = None) -> None:
    """JSON lines, as many files as tasks."""
    df.write.mode("overwrite").json(path, compression=compression)


def root_json(root: DataFrame, path: str) -> None:
    """The one-row result of units.root_document as one file."""
    root.select("json").coalesce(1).write.mode("overwrite").text(path)


def tmx(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """(id, lang, text) to <tu> elements; blank texts are left out, units without any don't appear."""
    tuv = F.array_sort(F.collect_list(F.struct(F.col("lang").alias("_xml:lang"), F.col("text").alias("seg"))))
    _tus(rows.where(nonblank(F.col("text"))).groupBy(F.col("id").alias("_tuid")).agg(tuv.alias("tuv")), path, compression)


def tmx_units(units: DataFrame, langs, path: str, compression: str | None = None) -> None:
    """As tmx(), from units with their ``translations``: one <tu> a row, without a shuffle."""
    every = F.array(*[F.struct(F.lit(x).alias("_xml:lang"), F.element_at("translations", x).alias("seg")) for x in langs])
    tuv = F.sort_array(F.filter(every, lambda x: nonblank(x["seg"])))
    some = F.exists(every, lambda x: nonblank(x["seg"]))
    _tus(units.where(some).select(F.col("id").alias("_tuid"), tuv.alias("tuv")), path, compression)


def _tus(units: DataFrame, path: str, compression: str | None) -> None:
    units.write.format("xml").option("rootTag", "body").option("rowTag", "tu").option("validateName", "false").option("compression", compression or "none").mode("overwrite").save(path)


TMX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<tmx version="1.4"><header creationtool="corpuscle" segtype="sentence" adminlang="en" srclang="{src}" datatype="plaintext" o-tmf="json"/>'


def tmx_document(rows: DataFrame, path: str, src: str = "zh") -> None:
    """One complete TMX file with its header. A single task by nature; for export only."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    tuv = F.concat(F.lit('<tuv xml:lang="'), esc(F.col("lang")), F.lit('"><seg>'), esc(F.col("text")), F.lit("</seg></tuv>"))
    units = rows.where(nonblank(F.col("text"))).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(tuv)), "").alias("t"))
    line = F.concat(F.lit('<tu tuid="'), esc(F.col("id")), F.lit('">'), F.col("t"), F.lit("</tu>"))
    body = units.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b"))
    body.select(F.concat(F.lit(TMX_HEAD.format(src=src) + "<body>\n"), "b", F.lit("\n</body></tmx>"))).coalesce(1).write.mode("overwrite").text(path)


def parallel_text(wide: DataFrame, path: str, key: str, langs, compression: str | None = None) -> None:
    """One folder per language, lines in key order, so that line n of each is the same unit."""
    for lang in langs:
        line = F.regexp_replace(F.coalesce(lang, F.lit("")), r"[\r\n]+", " ")
        wide.select(key, line.alias("value")).sort(key).select("value").write.mode("overwrite").text(f"{path}/{lang}", compression=compression)


def by_grade(df: DataFrame, path: str, compression: str | None = None) -> None:
    """A folder per grade."""
    df.write.mode("overwrite").partitionBy("grade").json(path, compression=compression)


def append_progress(df: DataFrame, path: str) -> None:
    """A committed append: readers see all of a batch or none of it."""
    df.write.mode("append").parquet(path)
