"""Queries that run as streams to the end of their input: `events` in shuffled files' order, and recordings cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.functions import signal as G
from chirplake.functions import vectors as V
from chirplake.operators.detector import END
from chirplake.plans.series_queries import RULES, _detector_sql, _FIRED, _NO_CHANGES
from chirplake.sources.replay import BlockReplay, write_recordings
from chirplake.sources.shared import shared_path
from chirplake.streaming.detection import counts_of, events_of, outcome_stream


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its source has, written to the shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector over `events` as a stream that Spark's file source reads; each stream is ended by a row behind its last event."""
    windows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").alias("stream"), F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"), F.col("value").alias("level"), F.lit(1).alias("rk"), F.col("event_type").alias("item"), F.col("value").alias("score")
    )
    ends = windows.groupBy("stream").agg((F.max("ts") + F.expr("interval 1 second")).alias("ts"))
    ends = ends.select("stream", "ts", F.lit(None).cast("double").alias("level"), F.lit(END).alias("rk"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("double").alias("score"))
    path = shared_path(spark, "windows")
    windows.write.parquet(path)
    ends.write.mode("append").parquet(path)
    # Files come in no order of time: rows wait for as long as the whole table spans.
    source = spark.readStream.schema(windows.schema).parquet(path)
    return finished(outcome_stream(source, RULES, late_ms=400 * 86_400e3), "outcomes")


def detector_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(_outcomes(spark, sf_dir)).select("stream", "item", F.round("score", 6).alias("score"), F.col("at").cast("long").alias("at"))


def stream_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stepped through, what was late, and the outcomes, of each stream."""
    return counts_of(_outcomes(spark, sf_dir)).withColumn("stepped", F.col("stepped") - 1)  # without the row that ends it


#: Samples of a block: a vector of `embeddings`.
SAMPLES = 64


def block_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of fifty vectors each, replayed as blocks: each block's energy, place in time, and whether it is the last."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 50").alias("stream"), "vec_id", "embedding")
    pcm = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]))
    path = shared_path(spark, "recordings")
    write_recordings(e.groupBy("stream").agg(pcm.alias("pcm")), path)
    spark.dataSource.register(BlockReplay)
    blocks = spark.readStream.format("recording_blocks").options(path=path, block=SAMPLES, rate=6400).load()
    out = blocks.select(F.col("stream").cast("long").alias("stream"), "seq", F.unix_millis("ts").alias("ms"), F.round(G.energy(V.doubles("pcm")), 9).alias("energy"), "last")
    return finished(out, "blocks")


QUERIES = {f.__name__: f for f in (detector_stream, stream_accounts, block_replay)}

_OUTCOMES = """SELECT stream, count(*) AS stepped, 0::BIGINT AS late, count(*) AS ticks, count(*) FILTER (v < 20) AS silent, sum(rejected)::BIGINT AS rejected, sum(fired)::BIGINT AS fired
FROM (SELECT g.stream, s0.v, CASE WHEN no THEN 1 ELSE 0 END AS rejected, CASE WHEN f_at IS NOT NULL THEN 1 ELSE 0 END AS fired FROM g JOIN s0 ON s0.stream = g.stream AND s0.k = g.k) GROUP BY stream"""

ORACLES = {
    "detector_stream": _detector_sql(_NO_CHANGES, _FIRED),
    "stream_accounts": _detector_sql(_NO_CHANGES, _OUTCOMES),
    "block_replay": """SELECT vec_id // 50 AS stream, row_number() OVER w - 1 AS seq, (row_number() OVER w - 1) * 10 AS ms,
  round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / 64, 9) AS energy, row_number() OVER w = count(*) OVER (PARTITION BY vec_id // 50) AS last
FROM embeddings WINDOW w AS (PARTITION BY vec_id // 50 ORDER BY vec_id)""",
}
