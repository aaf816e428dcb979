"""The corpus as one JSON document, written and read by many tasks.

Reading: the text source cuts the document at every closing brace, wherever a file is split, so a piece is the text between
two of them. What a piece does to the reader's state (inside a string or not, depth of brackets) depends on the state in
which it begins; both cases are computed, summed within a split, and the splits' sums are put together first to last, one row a
split. With each piece's own state known, units are the pieces from one that opens an object at depth 2 of the array to the
next such; they are put together again by their number, and the rest of the document, without the array, is its header.

What is known of splits and documents, one row each, is broadcast to the pieces: a join by document would send all of one
document to one task.

A brace can't be escaped in JSON, so no cut parts an escape; characters are never cut, because the source cuts at lines of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..session import materialise

UNITS = "alignment_units"
_OPENS = rf'(?s)"{UNITS}"\s*:\s*\['


def _marks(text: Column) -> Column:
    """The quotes and brackets of a text, in order, without those that are escaped: all that tells what a piece does. One pass
    takes out what stands between them in runs; what follows sees few characters."""
    return F.regexp_replace(text, r'(?s)\\.|[^"{\[\]\\]++', "")


def _outside(marks: Column, inside: bool) -> Column:
    """What stands outside of strings, if the text begins inside or outside of one."""
    marks = F.regexp_replace(marks, r'^[^"]*("|$)', "") if inside else marks
    return F.regexp_replace(marks, r'"[^"]*("|$)', "")


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def _depth(marks: Column) -> Column:
    """Brackets opened less brackets closed; there is no closing brace in a piece."""
    return _count(marks, "{") + _count(marks, "[") - _count(marks, "]")


def _pieces(spark: SparkSession, path: str, parts: bool) -> DataFrame:
    """doc, file, split, at (order in it), value and, for both states: q, d0, d1 (quotes and change of depth up to the piece's end
    within its split) with those before the piece."""
    raw = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")).withColumn("at", F.monotonically_increasing_id())
    own = Window.partitionBy("file", "split").orderBy("at")
    # Every piece but a file's first comes after a brace, which closes if it is outside of a string.
    first = (F.col("split") == 0) & (F.row_number().over(own) == 1)
    rows = rows.withColumns({"lead": F.when(first, 0).otherwise(1).cast("long"), "marks": _marks(F.col("value"))})
    outside = {"out": _outside(F.col("marks"), False), "in": _outside(F.col("marks"), True)}
    rows = rows.withColumns({"q": _count(F.col("marks"), '"'), **outside}).drop("marks")
    rows = rows.withColumns({"d_out": _depth(F.col("out")) - F.col("lead"), "d_in": _depth(F.col("in"))}).drop("out", "in")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("q_upto", F.sum("q").over(upto))
    odd = (F.col("q_upto") - F.col("q")) % 2 == 1
    # d0: if the split begins outside of strings, d1: inside.
    rows = rows.withColumns({"d0": F.when(odd, F.col("d_in")).otherwise(F.col("d_out")), "d1": F.when(odd, F.col("d_out")).otherwise(F.col("d_in"))})
    rows = rows.withColumns({"d0_upto": F.sum("d0").over(upto), "d1_upto": F.sum("d1").over(upto)})
    doc = F.regexp_replace("file", "/[^/]*$", "") if parts else F.col("file")
    return rows.withColumn("doc", doc).drop("d_out", "d_in")


def _placed(pieces: DataFrame) -> DataFrame:
    """pieces with inside (begins in a string) and depth (after the brace before it); order is (file, split, at)."""
    by = pieces.groupBy("doc", "file", "split").agg(F.sum("q").alias("q"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    earlier = Window.partitionBy("doc").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("s_in", F.coalesce(F.sum("q").over(earlier), F.lit(0)) % 2 == 1)
    by = by.withColumn("s_depth", F.coalesce(F.sum(F.when(F.col("s_in"), F.col("d1")).otherwise(F.col("d0"))).over(earlier), F.lit(0)))
    by = by.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), "s_in", "s_depth")
    rows = pieces.join(F.broadcast(by), (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split")))
    inside = F.col("s_in") != ((F.col("q_upto") - F.col("q")) % 2 == 1)
    before = F.col("s_depth") + F.when(F.col("s_in"), F.col("d1_upto") - F.col("d1")).otherwise(F.col("d0_upto") - F.col("d0"))
    rows = rows.withColumn("inside", inside)
    return rows.select("doc", "file", "split", "at", "value", "inside", (before - F.when(F.col("inside"), 0).otherwise(F.col("lead"))).alias("depth"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with unit (0 before the first), part: 'units', or 'head' and 'tail' of the rest."""
    head = F.regexp_extract("value", rf"(?s)^(.*?){_OPENS[4:]}\s*\{{", 1)
    there = F.rlike("value", F.lit(rf"{_OPENS}\s*\{{"))
    # The key can't be part of a string: its second quote would be escaped there.
    own = F.when(F.col("inside"), _depth(_outside(_marks(head), True))).otherwise(_depth(_outside(_marks(head), False)))
    begins = there & (F.col("depth") + own == 1)
    at_two = ~F.col("inside") & (F.col("depth") == 2)
    follows = at_two & F.rlike("value", F.lit(r"^\s*,\s*\{"))
    closes = at_two & F.rlike("value", F.lit(r"^\s*\]"))
    place = F.struct("file", "split", "at")
    rows = rows.withColumns({"begins": begins, "follows": follows, "closes": closes})
    # One row a document: where its array begins, and the first end of an array of this depth behind that.
    start = rows.where("begins").groupBy("doc").agg(F.min(place).alias("start")).select(F.col("doc").alias("b_doc"), "start")
    ends = rows.where("closes").select("doc", place.alias("end")).join(F.broadcast(start), F.col("doc") == F.col("b_doc")).where(F.col("end") > F.col("start"))
    bounds = start.join(F.broadcast(ends.groupBy("doc").agg(F.min("end").alias("end"))), F.col("b_doc") == F.col("doc"), "left").drop("doc")
    rows = rows.join(F.broadcast(bounds), F.col("doc") == F.col("b_doc"), "left").drop("b_doc")
    units = (place >= F.col("start")) & (F.col("end").isNull() | (place < F.col("end")))
    part = F.when(F.coalesce(units, F.lit(False)), "units").when(F.coalesce(place >= F.col("start"), F.lit(False)), "tail").otherwise("head")
    rows = rows.withColumn("part", part).withColumn("opens", F.when((F.col("part") == "units") & (F.col("follows") | (place == F.col("start"))), 1).otherwise(0).cast("long"))
    # Numbers of units: within a split, then by split, as for depth.
    own = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = rows.groupBy("doc", "file", "split").agg(F.sum("opens").alias("n"))
    earlier = Window.partitionBy("doc").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    rows = rows.withColumn("upto", F.sum("opens").over(own))
    rows = rows.join(F.broadcast(by), (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split")))
    return rows.select("doc", "file", "split", "at", "value", "part", "start", "begins", (F.col("base") + F.col("upto")).alias("unit"))


def _joined(value: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "split", "at", value.alias("v")))), lambda x: x["v"]), "}")


def documents(spark: SparkSession, path: str, parts: bool = False) -> tuple[DataFrame, DataFrame]:
    """(headers: doc, text; units: doc, unit from 0, text) of the corpus documents under path.

    parts: the files of a folder, in order of their names, are one document, as corpus_json() writes it; each must end with a
    line break. Else every file is one. A document without units, or with an empty array, has its header alone.
    """
    pieces = materialise(_pieces(spark, path, parts), "json-pieces")
    rows = _numbered(_placed(pieces))
    first = F.coalesce(F.struct("file", "split", "at") == F.col("start"), F.lit(False))
    unit = F.when(first, F.regexp_extract("value", rf"{_OPENS}\s*(\{{.*)$", 1)).otherwise(F.regexp_replace("value", r"^\s*,\s*\{", "{"))
    opened = F.row_number().over(Window.partitionBy("doc", "unit").orderBy("file", "split", "at")) == 1
    units = rows.where("part = 'units'").withColumn("v", F.when(opened, unit).otherwise(F.col("value")))
    units = units.groupBy("doc", "unit").agg(F.concat(_joined(F.col("v")), F.lit("}")).alias("text")).select("doc", (F.col("unit") - 1).alias("unit"), "text")
    # The header: what stands before the first unit, and from the array's end on.
    cut = F.when(first, F.regexp_extract("value", rf"(?s)^(.*?{_OPENS[4:]})\s*\{{", 1)).otherwise(F.col("value"))
    rest = rows.where(first | (F.col("part") != "units")).withColumn("v", cut)
    both = rest.groupBy("doc").agg(
        F.coalesce(_filtered("head", first), F.lit("")).alias("h"), F.coalesce(_filtered("begin", first), F.lit("")).alias("b"), F.coalesce(_filtered("tail", first), F.lit("")).alias("t")
    )
    lead = F.when(F.col("h") == "", F.col("b")).when(F.col("b") == "", F.col("h")).otherwise(F.concat("h", F.lit("}"), "b"))
    return both.select("doc", F.concat(lead, "t").alias("text")), units


def _filtered(which: str, first: Column) -> Column:
    here = first if which == "begin" else ~first & (F.col("part") == which)
    kept = F.collect_list(F.when(here, F.struct("file", "split", "at", "v")))
    return F.array_join(F.transform(F.array_sort(kept), lambda x: x["v"]), "}")


def corpus(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """One row per unit: corpus_id, version, created, languages of its document, and the unit's fields."""
    shape = T.StructType.fromDDL(schema.CORPUS)
    unit_type = shape[UNITS].dataType.elementType.simpleString()
    head = T.StructType([f for f in shape if f.name != UNITS])
    headers, units = documents(spark, path, parts)
    # A file that ends with its last brace has no piece behind it, so that brace is put back.
    known = F.from_json(F.concat("text", F.lit("}")), head), F.from_json("text", head)
    roots = headers.select(F.col("doc").alias("h_doc"), F.when(F.rlike("text", F.lit(r"\}\s*$")), known[1]).otherwise(known[0]).alias("h"))
    rows = units.join(F.broadcast(roots), F.col("doc") == F.col("h_doc")).withColumn("u", F.from_json("text", unit_type))
    return rows.select("h.corpus_id", "h.version", F.to_date("h.created").alias("created"), "h.languages", "u.*")


def write(units: DataFrame, path: str, corpus_id: str, name: str, version: str, created: str, langs) -> None:
    """units (id, source, translations) as one JSON document in parts, in order of id: the files of the folder, one after the other
    by name, are the document. No task holds more than its part.
    """
    rows = units.select("id", F.to_json(F.struct("id", "source", "translations")).alias("json"))
    spark = units.sparkSession
    rows = materialise(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()), "json-units")
    first = rows.agg(F.min("at")).head()[0]
    head = spark.range(1).select(F.to_json(F.struct(F.lit(corpus_id).alias("corpus_id"), F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(created).alias("created"), F.array(*[F.lit(x) for x in langs]).alias("languages"))).alias("h"))
    opening = head.select(F.lit(-1).cast("long").alias("at"), F.concat(F.regexp_replace("h", r"\}$", ""), F.lit(f', "{UNITS}": [')).alias("value"))
    closing = spark.range(1).select(F.lit((1 << 63) - 1).alias("at"), F.lit("]}").alias("value"))
    body = rows.select("at", F.concat(F.when(F.col("at") == (first if first is not None else -2), "").otherwise(","), "json").alias("value"))
    lines = opening.unionByName(body).unionByName(closing)
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)
