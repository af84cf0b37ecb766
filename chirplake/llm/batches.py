"""Bounded pieces of Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text of one piece; a longer text is a piece of its own.
PIECE_BYTES = 4 << 20
PIECE_ROWS = 2048


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of up to PIECE_ROWS consecutive rows whose texts have up to `most` bytes together, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for k, n in enumerate(sizes):
            if k > start and (held + n > most or k - start >= PIECE_ROWS):
                yield batch.slice(start, k - start)
                start, held = k, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(df: DataFrame, text: str, carry: list[str], added: str, work: Callable[[pa.Array], dict], most: int = PIECE_BYTES) -> DataFrame:
    """The carry columns of df with the columns of the schema string `added`, which work gives for the texts of each piece of rows (up to `most` bytes)."""
    kept = [f for f in df.schema.fields if f.name in carry]
    schema = T.StructType(kept + T.StructType.fromDDL(added).fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", most):
            made = work(piece.column("_text"))
            yield pa.RecordBatch.from_arrays([piece.column(n) for n in names] + list(made.values()), names + list(made))

    return df.select(*[F.col(n) for n in names], F.col(text).alias("_text")).mapInArrow(run, schema)
