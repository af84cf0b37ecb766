"""Streaming features against one pass over the whole recording."""

import numpy as np
import pandas as pd

from chirplake.streaming.features import Analyser, LinearResampler, frames_of_blocks, resampled_blocks


def resampled(x, rate, to=48000):
    """Linear, the last sample held."""
    return np.interp(np.arange(round(len(x) * to / rate)) * rate / to, np.arange(len(x)), x)


SCHEMA = "stream string, seq long, pcm array<float>"


def test_frames_of_blocks_in_any_order(spark, tmp_path):
    x = np.random.default_rng(7).uniform(-0.3, 0.3, 960 * 12).astype(np.float32)
    rows = pd.DataFrame([("s", k, x[k * 960 : k * 960 + 960].tolist()) for k in range(12)], columns=["stream", "seq", "pcm"])
    for part in (rows.iloc[[3, 0, 2]], rows.iloc[[1, 0, 7, 6]], rows.iloc[[4, 5, 8, 9, 10, 11]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = frames_of_blocks(source).writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("frames").toPandas().sort_values("frame")
    whole, energy = Analyser().push(x)
    assert got["frame"].tolist() == list(range(len(whole))) and np.allclose(got["energy"], energy)
    assert np.allclose(np.stack(got["mel"].to_numpy())[:5], whole[:5])


def test_resampling_in_blocks():
    x = np.random.default_rng(1).normal(size=5000)
    r, out, at = LinearResampler(44100), [], 0
    for n in (1, 7, 400, 3000, 5000):
        out.append(r.push(x[at : at + n]))
        at += n
    got = np.concatenate(out)
    assert np.allclose(got, resampled(x, 44100)[: len(got)]) and len(got) >= 5440


def test_a_lost_block_is_given_up_and_counted_and_no_frame_straddles_it(spark, tmp_path):
    x = np.random.default_rng(8).uniform(-0.3, 0.3, 960 * 14).astype(np.float32)
    rows = pd.DataFrame([("s", k, x[k * 960 : k * 960 + 960].tolist()) for k in range(14) if k not in (4, 5)], columns=["stream", "seq", "pcm"])
    for part in (rows.iloc[:6], rows.iloc[6:10], rows.iloc[10:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = frames_of_blocks(source, patience=3).writeStream.format("memory").queryName("lossy").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("lossy").toPandas().sort_values("frame")
    before, after = Analyser().push(x[: 4 * 960])[1], Analyser().push(x[6 * 960 :])[1]
    assert np.allclose(got["energy"], np.concatenate([before, after])) and got["frame"].tolist() == list(range(len(got)))
    assert got["lost"].tolist() == [0] * len(before) + [2] * len(after)
    assert got["sample"].tolist() == [256 * k for k in range(len(before))] + [4 * 960 + 256 * k for k in range(len(after))]


def test_an_idle_stream_gives_what_waits_behind_a_gap(spark, tmp_path):
    x = np.random.default_rng(9).uniform(-0.3, 0.3, 960 * 6).astype(np.float32)
    rows = pd.DataFrame([("s", k, x[k * 960 : k * 960 + 960].tolist()) for k in (0, 1, 3, 4, 5)] + [("t", 0, [0.0] * 960)], columns=["stream", "seq", "pcm"])
    for part in (rows.iloc[:5], rows.iloc[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = frames_of_blocks(source, idle_ms=1).writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("idle").toPandas().sort_values("frame")
    expected = np.concatenate([Analyser().push(x[: 2 * 960])[1], Analyser().push(x[3 * 960 :])[1]])
    assert np.allclose(got["energy"], expected) and got["lost"].max() == 1


def test_resampling_a_stream(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=2 * 4410)
    cuts = [0, 2, 500, 501, 3000, len(x)]
    rows = pd.DataFrame([("s", k, x[a:b].tolist()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], columns=["stream", "seq", "pcm"])
    for part in (rows.iloc[[1, 0]], rows.iloc[2:4], rows.iloc[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = resampled_blocks(source, 44100, channels=2).writeStream.format("memory").queryName("resampled").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = np.concatenate(spark.table("resampled").toPandas().sort_values("seq")["pcm"].to_numpy())
    mono = np.concatenate([x[a : a + (b - a) // 2 * 2].astype(np.float32).reshape(-1, 2).mean(1, dtype=np.float64) for a, b in zip(cuts, cuts[1:])])
    assert len(got) > 4790 and np.allclose(got, resampled(mono, 44100)[: len(got)], atol=1e-6)
