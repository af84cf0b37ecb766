"""What streams measure of themselves: totals that Spark counts on the way, and the time that batches take, as a table."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

TOTALS = "totals"
PROGRESS = "query string, batch long, rows long, ms long, blocks long, silent long, dropped long, audio_ms double, max_level double"


def observed(blocks: DataFrame, gate: float, ms_per_block: float = 20.0) -> DataFrame:
    """blocks: a stream of (value, and lost, where blocks went missing). The same rows; each batch's totals are counted on the way, in no job of their own."""
    lost = F.sum("lost") if "lost" in blocks.columns else F.lit(0).cast("long")
    counts = {"blocks": F.count(F.lit(1)), "silent": F.count_if(F.coalesce(F.col("value") < gate, F.lit(True))), "dropped": F.coalesce(lost, F.lit(0)), "audio_ms": F.count(F.lit(1)) * ms_per_block, "max_level": F.max("value")}
    return blocks.observe(TOTALS, *[c.alias(n) for n, c in counts.items()])


class Progress(StreamingQueryListener):
    """Keeps a row for each batch of each query that runs while it listens; `written` gives what is there to a table and forgets it."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.lock, self.ended = threading.Lock(), threading.Condition()
        self.over: set[str] = set()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        seen = p.observedMetrics.get(TOTALS)
        told = [seen[c] if seen is not None else None for c in ("blocks", "silent", "dropped", "audio_ms", "max_level")]
        with self.lock:
            self.rows.append((str(p.runId), p.batchId, p.numInputRows, p.durationMs.get("triggerExecution"), *told))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        with self.ended:
            self.over.add(str(event.runId))
            self.ended.notify_all()

    def wait(self, run: str, seconds: float = 60) -> bool:
        """Waits until all of an ended query has been told."""
        with self.ended:
            return self.ended.wait_for(lambda: run in self.over, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            return spark.createDataFrame(self.rows, PROGRESS)

    def written(self, spark: SparkSession, path: str) -> None:
        with self.lock:
            rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(path)


def totals(progress: DataFrame) -> DataFrame:
    """Of each query: blocks, silent and dropped ones, the loudest level, batches, their mean and longest time, and time a 20 ms of audio."""
    ms = F.sum("ms")
    return progress.groupBy("query").agg(
        F.sum("blocks").alias("blocks"), F.sum("silent").alias("silent"), F.sum("dropped").alias("dropped"), F.max("max_level").alias("max_level"), F.count_if(F.col("blocks") > 0).alias("batches"),
        F.avg("ms").alias("avg_ms"), F.max("ms").alias("max_ms"), (ms * 20 / F.nullif(F.sum("audio_ms"), F.lit(0.0))).alias("ms_per_20ms"),
    )
