"""Recordings replayed as a stream of short blocks, as a Python data source for `spark.readStream`.

`spark.dataSource.register(BlockReplay)`, then `spark.readStream.format("recording_blocks")` with
the options `path`, `block` (samples), `rate` and `pace` (blocks a trigger; 0: all that there are, which
`availableNow` needs, as Spark asks only once then). The offset counts blocks from the recordings' starts, so
that all streams run side by side. Tasks read row groups; the driver reads footers only.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: 20 ms at 48 kHz.
BLOCK, RATE = 960, 48_000
BLOCKS = "stream string, seq long, ts timestamp, pcm array<float>, last boolean"
#: Samples of one Arrow batch.
BATCH = 1 << 20


def write_recordings(recordings: DataFrame, path: str) -> None:
    """recordings: (stream, pcm). Writes them with their length, whose greatest value the footers tell."""
    recordings.select(F.col("stream").cast("string").alias("stream"), F.size("pcm").cast("long").alias("n"), F.col("pcm").cast("array<float>").alias("pcm")).write.parquet(path)


@dataclass
class Piece(InputPartition):
    """Blocks from `start` to before `end` of the recordings of one row group."""

    path: str
    group: int
    start: int
    end: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class BlockReplay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording_blocks"

    def schema(self) -> str:
        return BLOCKS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BlockReader(self.options)


class BlockReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.block, self.rate, self.pace = int(options.get("block", BLOCK)), int(options.get("rate", RATE)), int(options.get("pace", 0))
        if self.block < 1 or self.rate < 1 or self.pace < 0:
            raise ValueError("block and rate must be 1 at least, pace 0 at least")
        self.told = 0

    def _groups(self) -> list[tuple[str, int, int]]:
        """Each row group with the samples of its longest recording."""
        system, root = _opened(self.path)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.is_file and info.base_name.endswith(".parquet") and not info.base_name.startswith(("_", ".")):
                with system.open_input_file(info.path) as f:
                    meta = pq.ParquetFile(f).metadata
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    column = next(group.column(k) for k in range(group.num_columns) if group.column(k).path_in_schema == "n")
                    found.append((info.path, g, column.statistics.max if column.statistics and column.statistics.has_min_max else 0))
        return sorted(found)

    def _blocks(self, samples: int) -> int:
        return -(-samples // self.block)

    def initialOffset(self) -> dict:
        return {"block": 0}

    def latestOffset(self) -> dict:
        end = self._blocks(max((n for _, _, n in self._groups()), default=0))
        self.told = min(end, self.told + self.pace) if self.pace else end
        return {"block": self.told}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = max(self.told, end["block"])  # goes on from here after a restart
        return [Piece(path, g, start["block"], end["block"]) for path, g, n in self._groups() if self._blocks(n) > start["block"]]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        with system.open_input_file(piece.path) as f:
            table = pq.ParquetFile(f).read_row_group(piece.group, columns=["stream", "pcm"])
        for stream, pcm in zip(table["stream"].to_pylist(), (x for chunk in table["pcm"].chunks for x in chunk)):
            if not pcm.is_valid:
                continue
            values = pcm.values.fill_null(0).to_numpy(zero_copy_only=False)
            last = self._blocks(len(values)) - 1
            step = max(1, BATCH // self.block)
            for first in range(piece.start, min(piece.end, last + 1), step):
                seqs = np.arange(first, min(first + step, piece.end, last + 1))
                cuts = np.minimum(np.append(seqs, seqs[-1] + 1) * self.block, len(values))
                blocks = pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), pa.array(values[cuts[0] : cuts[-1]], pa.float32()))
                at = pa.array(seqs * self.block * 1_000_000 // self.rate, pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array([stream] * len(seqs), pa.string()), pa.array(seqs, pa.int64()), at, blocks, pa.array(seqs == last)], ["stream", "seq", "ts", "pcm", "last"])


def block_time(seq: int, block: int = BLOCK, rate: int = RATE) -> datetime.timedelta:
    """When a block begins, from its recording's start."""
    return datetime.timedelta(microseconds=seq * block * 1_000_000 // rate)
