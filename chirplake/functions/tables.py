"""Table functions for SQL."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import ArrayType, DoubleType, LongType, Row, StructField, StructType


@udtf
class Frames:
    """frames(TABLE(rows) PARTITION BY key ORDER BY (t, id), value => 'column', n => 32): for each row of a partition that has n - 1 before it
    its partition's columns, its place from 0, the last n values, oldest first, and their mean square. A null value counts as 0; only n values are held."""

    def __init__(self):
        self.frame, self.held = -1, None

    @staticmethod
    def analyze(table: AnalyzeArgument, value: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        names = [f.name for f in table.dataType.fields]
        if value.value not in names:
            raise ValueError(f"the table has no column {value.value}")
        if not isinstance(n.value, int) or n.value < 1:
            raise ValueError("n must be a whole number of 1 at least")
        first = table.dataType.fields[0]
        return AnalyzeResult(StructType([first, StructField("frame", LongType()), StructField("patch", ArrayType(DoubleType())), StructField("energy", DoubleType())]))

    def eval(self, table: Row, value: str, n: int) -> Iterator[tuple]:
        if self.held is None:
            self.held = deque(maxlen=n)
        self.frame += 1
        self.held.append(float(table[value] or 0.0))
        if len(self.held) == n:
            yield table[0], self.frame, list(self.held), sum(x * x for x in self.held) / n


def register(spark: SparkSession) -> None:
    """Makes `frames` known to the session's SQL."""
    spark.udtf.register("frames", Frames)
