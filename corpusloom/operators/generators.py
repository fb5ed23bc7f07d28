"""Set-returning functions for SQL: rows that a text gives, called in lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


@udtf
class Matches:
    """``matches(text, pattern)``: position (code points, from 0), match, and a column for each group, named as the pattern
    names it, else g1, g2, ...; so the pattern decides the schema when the query is analysed.

    A null text gives no row; a pattern that isn't constant, or doesn't compile, raises before anything runs.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument) -> AnalyzeResult:
        if not pattern.isConstantExpression or not isinstance(pattern.value, str):
            raise ValueError("the pattern must be a constant text")
        try:
            form = re.compile(pattern.value)
        except re.error as e:
            raise ValueError(f"the pattern doesn't compile: {e}") from e
        names = {i: n for n, i in form.groupindex.items()}
        schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("match", T.StringType())])
        for i in range(1, form.groups + 1):
            schema.add(names.get(i, f"g{i}"), T.StringType())
        return AnalyzeResult(schema)

    def eval(self, text: str, pattern: str) -> Iterator[tuple]:
        if text is not None:
            for m in re.finditer(pattern, text):
                yield (m.start(), m[0], *m.groups())


@udtf
class Gaps:
    """``gaps(TABLE(rows))``: of rows with a key and a position, dealt by key, the stretches of positions that a key lacks
    between its own: key, first, last. A table argument, so its first two columns are taken whatever their names."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("name a table of a key and a position")
        key, at = (f.name for f in rows.dataType.fields[:2])
        schema = T.StructType([T.StructField("key", rows.dataType.fields[0].dataType), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key)], orderBy=[_ordering(at)])

    def __init__(self):
        self.before = None

    def eval(self, rows: Row) -> Iterator[tuple]:
        key, at = rows[0], rows[1]
        if at is not None:
            if self.before is not None and at > self.before + 1:
                yield key, self.before + 1, at - 1
            self.before = at


def _ordering(name: str):
    from pyspark.sql.udtf import OrderingColumn

    return OrderingColumn(name)


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL as ``matches`` and ``gaps``."""
    spark.udtf.register("matches", Matches)
    spark.udtf.register("gaps", Gaps)
