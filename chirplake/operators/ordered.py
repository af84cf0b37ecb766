"""Jobs that see the rows of a group in order, a batch at a time.

Rows are sorted within partitions by Spark, which spills, and come to Python in batches; a group
is never whole in memory, however long it is. What is carried from row to row is the job's state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def in_order(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Each group of `by` in one partition, and sorted; nulls form a group and come first."""
    return df.repartition(*by).sortWithinPartitions(*by, *order)


def plain_rows(batches: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The batches' rows as tuples with None for nulls."""
    for rows in batches:
        values = rows[columns].astype(object)
        yield from values.where(values.notna(), None).itertuples(index=False, name=None)


def in_batches(rows: Iterable[tuple], columns: list[str], most: int = 10_000) -> Iterator[pd.DataFrame]:
    """Tuples as DataFrames of at most so many rows."""
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) == most:
            yield pd.DataFrame(waiting, columns=columns)
            waiting = []
    if waiting:
        yield pd.DataFrame(waiting, columns=columns)
