"""Table functions for SQL: nested and flat forms of any table.

After ``register(spark)``::

    SELECT * FROM lines_of(TABLE(SELECT id, text FROM t), 'text')
    SELECT * FROM nested(TABLE(SELECT museum, board, n, text FROM t) PARTITION BY museum, board ORDER BY (n), 'text')

Rows pass through Python, in Arrow batches; from Python, DataFrame functions do the same (operators/segment.py).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from ..session import ship

#: Rows of one array: longer groups come in several rows, numbered by ``part``, so that none is held whole.
PART = 10_000


def _field(table: AnalyzeArgument, column: AnalyzeArgument):
    if not table.isTable or not isinstance(column.value, str):
        raise ValueError("a table and the name of one of its columns are needed")
    if column.value not in table.dataType.names:
        raise ValueError(f"the table has no column {column.value!r}, only {table.dataType.names}")
    return table.dataType[column.value]


class _Lines:
    """The table's other columns, and each line of the named one with its number from 0; nulls have no line, "" has one."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(_field(table, column).dataType, StringType):
            raise ValueError(f"{column.value!r} is not a text")
        schema = StructType([f for f in table.dataType.fields if f.name != column.value])
        return AnalyzeResult(schema.add("ordinal", LongType()).add("line", StringType()))

    def eval(self, row, column):
        rest = tuple(v for k, v in row.asDict().items() if k != column)
        for i, line in enumerate(row[column].split("\n") if row[column] is not None else ()):
            yield (*rest, i, line)


class _Nested:
    """One row a partition (or for each PART rows of it): its number and the named column's values in the partition's order.

    Nulls stay in their places. The columns of PARTITION BY are put before by Spark only if the function's own rows have them,
    so name them: the first row's other columns are returned with the array.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
        field = _field(table, column)
        schema = StructType([f for f in table.dataType.fields if f.name != column.value])
        return AnalyzeResult(schema.add("part", LongType()).add(column.value, ArrayType(field.dataType)))

    def __init__(self):
        self.first, self.held, self.part = None, [], 0

    def eval(self, row, column):
        if self.first is None:
            self.first = tuple(v for k, v in row.asDict().items() if k != column)
        self.held.append(row[column])
        if len(self.held) >= PART:
            yield (*self.first, self.part, self.held)
            self.held, self.part = [], self.part + 1

    def terminate(self):
        if self.held:
            yield (*self.first, self.part, self.held)


def register(spark: SparkSession) -> None:
    """Make ``lines_of`` and ``nested`` known to the session's SQL."""
    ship(spark)
    spark.udtf.register("lines_of", udtf(_Lines, useArrow=True))
    spark.udtf.register("nested", udtf(_Nested, useArrow=True))
