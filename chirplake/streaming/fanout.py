"""One stream of results for many readers: each sink gets each batch once, whatever fails in between.

Sinks write the rows of a batch to a place of the batch's own, which a repeated write replaces. A
ledger in the shared folder names the batches that each sink has taken; a sink that fails has its
batches kept, and takes them, in order, before later ones, while the other sinks go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.streaming.detection import COUNTS

Sink = Callable[[DataFrame, int], None]


class Ledger:
    """Small files under one folder, by the cluster's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.system = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(at)) if self.system.exists(at) else []

    def has(self, name: str) -> bool:
        return self.system.exists(self._at(name))

    def mark(self, name: str) -> None:
        self.system.create(self._at(name), True).close()

    def remove(self, name: str) -> None:
        self.system.delete(self._at(name), True)


class FanOut:
    """Gives each micro-batch to all sinks; `errors` has what each sink's last failure was."""

    def __init__(self, spark: SparkSession, sinks: dict[str, Sink], path: str):
        self.spark, self.sinks, self.path = spark, sinks, path.rstrip("/")
        self.ledger = Ledger(spark, f"{self.path}/ledger")
        self.errors: dict[str, str] = {}

    def _name(self, batch: int) -> str:
        return f"{batch:018d}"

    def _give(self, name: str, rows: DataFrame, batch: int) -> bool:
        if self.ledger.has(f"done/{name}/{self._name(batch)}"):
            return True
        try:
            self.sinks[name](rows, batch)
        except Exception as e:  # a reader's fault is its own: it is told, and its batch kept
            self.errors[name] = str(e)
            return False
        self.ledger.mark(f"done/{name}/{self._name(batch)}")
        self.errors.pop(name, None)
        return True

    def _kept(self, name: str) -> str:
        return f"{self.path}/kept/{name}"

    def catch_up(self, name: str) -> bool:
        """Gives a sink the batches that are kept for it, in order; whether none is left."""
        for waiting in self.ledger.names(f"waiting/{name}"):
            if not self._give(name, self.spark.read.parquet(f"{self._kept(name)}/{waiting}"), int(waiting)):
                return False
            self.ledger.remove(f"waiting/{name}/{waiting}")
        return True

    def batch(self, rows: DataFrame, n: int) -> None:
        rows = rows.persist()
        try:
            for name in self.sinks:
                if self.ledger.has(f"done/{name}/{self._name(n)}"):
                    continue
                if not (self.catch_up(name) and self._give(name, rows, n)):
                    rows.write.mode("overwrite").parquet(f"{self._kept(name)}/{self._name(n)}")
                    self.ledger.mark(f"waiting/{name}/{self._name(n)}")
        finally:
            rows.unpersist()

    def start(self, stream: DataFrame):
        """The writer of a stream into all sinks; its checkpoint lies beside the ledger."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint")

    def drain(self) -> bool:
        """Gives all sinks what is kept for them; whether none is left."""
        return all([self.catch_up(name) for name in self.sinks])


def tap(work: Sink, told: Callable[[str], None]) -> Sink:
    """A reader of blocks beside the others, whose faults are told and else ignored: its batches aren't kept."""

    def give(rows: DataFrame, n: int) -> None:
        try:
            work(rows, n)
        except Exception as e:
            told(str(e))

    return give


def _number(c: str, digits: int, none: str) -> Column:
    return F.when(F.abs(c) < float("inf"), F.format_string(f"%.{digits}f", F.col(c))).otherwise(none)


def csv_lines(events: DataFrame) -> DataFrame:
    """Event lines: time in ms, item, score and margin with 4 places (+inf without a rival), level with 2 (-inf for silence)."""
    return events.select(F.col("at").cast("long").alias("time"), "stream", "item", _number("score", 4, "").alias("score"), _number("margin", 4, "+inf").alias("margin"), _number("level", 2, "-inf").alias("level"))


def _finite(c: str) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)


def json_lines(events: DataFrame) -> DataFrame:
    """One JSON document an event; what isn't finite is null."""
    return events.select(F.to_json(F.struct("stream", "item", *map(_finite, ("score", "margin", "level")), "at"), {"ignoreNullFields": "false"}).alias("value"))


def outcome_lines(outcomes: DataFrame) -> DataFrame:
    """One JSON document a row of outcomes, with its type: `event`, `late`, or `tick` with the counts of the windows that a batch stepped through."""
    keep = {"ignoreNullFields": "false"}
    values = [_finite(c) for c in ("score", "margin", "level")]
    event = F.to_json(F.struct(F.col("kind").alias("type"), "stream", "item", *values, "at"), keep)
    tick = F.to_json(F.struct(F.lit("tick").alias("type"), "stream", F.col("n").alias("rows"), *COUNTS), keep)
    return outcomes.select(F.when(F.col("kind") == "stepped", tick).otherwise(event).alias("value"))


def summary_lines(counts: DataFrame, reason: str) -> DataFrame:
    """The last line of each stream: its counts and why it ended."""
    return counts.select(F.to_json(F.struct(F.lit("summary").alias("type"), "stream", "stepped", "late", *COUNTS, F.lit(reason).alias("reason")), {"ignoreNullFields": "false"}).alias("value"))


def csv_sink(path: str) -> Sink:
    """CSV files of each batch's events, in a folder of the batch."""
    return lambda rows, n: csv_lines(rows.where("kind = 'event'")).write.mode("overwrite").option("header", True).csv(f"{path}/batch={n}")


def json_sink(path: str) -> Sink:
    """JSON lines of each batch's outcomes, in a folder of the batch."""
    return lambda rows, n: outcome_lines(rows).write.mode("overwrite").text(f"{path}/batch={n}")
