"""Spectral scan of recordings: levels of each channel, the strongest frequency of the loudest one, and whether a wanted tone is in it.

All that belongs to a recording is in its row, so that nothing is shuffled; the sums over frequencies are matrix products in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import vectors as V
from chirplake.functions.signal import DOUBLES

#: Fixed values of the scan: where it begins, ends at most, and how wide it steps (Hz), the share of half the rate that it goes to, the fewest samples.
LOW_HZ, HIGH_HZ, STEP_HZ, OF_NYQUIST, LEAST = 20.0, 20_000.0, 10.0, 0.98, 16
#: Fixed values of the verdict, in dB: a tone's least level, how far under the strongest frequency it may be, and how near (Hz) it is the strongest.
FLOOR_DB, UNDER_DB, NEAR_HZ = -70.0, -20.0, 2.0
#: Samples that one matrix product takes.
BLOCK = 1024


@F.pandas_udf(DOUBLES)
def magnitudes(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Of each row's samples the magnitudes of the transform at its frequencies, in cycles a sample; 0 where they aren't numbers, null for null samples."""

    def one(x: np.ndarray, cycles: np.ndarray) -> np.ndarray:
        nonlocal known, waves
        if known is None or not np.array_equal(known, cycles):
            known, waves = cycles, np.exp(-2j * np.pi * np.outer(np.arange(BLOCK), cycles))
        out = np.zeros(len(cycles), complex)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK]
            out += np.exp(-2j * np.pi * ((at * cycles) % 1.0)) * (part @ waves[: len(part)])
        return np.nan_to_num(np.abs(out))

    known = waves = None
    for samples, cycles in batches:
        yield pd.Series([None if x is None else one(np.asarray(x, float), np.asarray(c, float)) for x, c in zip(samples, cycles, strict=True)])


def channel(pcm: Column, channels: Column, c: Column) -> Column:
    """The samples of one channel of interleaved ones; none for no channels."""
    return F.filter(pcm, lambda x, k: F.try_mod(k, channels) == c)


def levels(pcm: Column, channels: Column) -> Column:
    """(peak, rms, zeros) of each channel, in order: the greatest magnitude, the root mean square and the share of exact zeros; 0 without samples.

    Null for null samples and for fewer channels than one.
    """

    def one(x: Column) -> Column:
        n = F.nullif(F.size(x), F.lit(0))
        zeros = F.size(F.filter(x, lambda y: y == 0)) / n
        numbers = F.array_max(F.transform(x, lambda y: F.abs(y))), F.sqrt(V.dot(x, x) / n), zeros
        return F.struct(*(F.coalesce(value, F.lit(0.0)).alias(name) for value, name in zip(numbers, ("peak", "rms", "zeros"), strict=True)))

    each = F.transform(F.sequence(F.lit(0), F.greatest(channels, F.lit(1)) - 1), lambda c: V.let(channel(pcm, channels, c), one))
    return F.when(pcm.isNotNull() & (channels > 0), each)


def channel_levels(recordings: DataFrame, carry: list[str]) -> DataFrame:
    """recordings: (pcm, channels) and the carried columns. A row for each channel, with levels in dB (null for silence); none without samples or channels."""
    rows = recordings.select(*carry, F.posexplode(levels(F.col("pcm"), F.col("channels"))).alias("channel", "x"))
    return rows.select(*carry, "channel", "x.peak", X.dbfs(F.col("x.peak")).alias("peak_db"), X.dbfs(F.col("x.rms")).alias("rms_db"), (F.col("x.peak") == 0).alias("silent"), "x.zeros")


def sliced(x: Column, rate: Column, from_s: Column, length_s: Column) -> Column:
    """The samples from a time on, for a length or, where that is 0, to the end."""
    start = F.least(F.greatest(F.floor(from_s * rate), F.lit(0)), F.size(x)).cast("int")
    length = F.when(length_s > 0, F.floor(length_s * rate).cast("int")).otherwise(F.size(x))
    return F.slice(x, start + 1, length)


def _top(db: Column, k: Column, low: Column, step: Column) -> Column:
    """The frequency at place k of the levels, moved to the top of the parabola through it and its neighbours, by a step at most."""
    y1, y2, y3 = F.get(db, k - 1), F.get(db, k), F.get(db, k + 1)
    delta = F.try_divide(0.5 * (y1 - y3), y1 - 2 * y2 + y3)
    return low + k * step + F.when(F.abs(delta) <= 1, delta * step).otherwise(0.0)


def scan(recordings: DataFrame, carry: list[str], step_hz: float = STEP_HZ) -> DataFrame:
    """recordings: (pcm, channels, rate, hz, from_s, length_s) and the carried columns: interleaved samples, the wanted tone, and the slice to look at.

    Gives the carried columns and, of the loudest channel (the first of equally loud ones):
    channel, samples, dominant (Hz) and its level dominant_db, the tone's level tone_db, its share of the
    windowed energy, nearest (whether the tone is the strongest frequency), and verdict:

    * `silent`: no sample other than 0, null and empty recordings too;
    * `unusable`: no channel, or a rate too low for any frequency of the scan;
    * `too short`: under 16 samples are left in the slice;
    * `found`: the tone is over -70 dB and at most 20 dB under the strongest frequency; else `not found`.

    Numbers that a verdict leaves without a meaning are null. Samples that aren't numbers leave no frequency with a level.
    """
    rate, low, step = F.col("rate"), F.lit(LOW_HZ), F.lit(float(step_hz))
    high = F.least(F.lit(HIGH_HZ), 0.5 * rate * OF_NYQUIST)
    loud = F.transform("levels", lambda x: x["rms"])
    usable = F.coalesce((F.col("channels") > 0) & rate.isNotNull() & (high >= low), F.lit(False))
    silent = F.coalesce(F.forall("pcm", lambda x: x == 0), F.lit(True))
    df = recordings.withColumn("levels", levels(F.col("pcm"), F.col("channels")))
    df = df.withColumn("state", F.when(silent, "silent").when(~usable, "unusable"))
    df = df.withColumn("channel", F.when(F.col("state").isNull(), (F.array_position(loud, F.array_max(loud)) - 1).cast("int")))
    df = df.withColumn("x", F.when(F.col("channel").isNotNull(), sliced(channel(F.col("pcm"), F.col("channels"), F.col("channel")), rate, F.col("from_s"), F.col("length_s"))))
    df = df.withColumn("samples", F.when(F.col("x").isNotNull(), F.size("x")))
    df = df.withColumn("state", F.coalesce("state", F.when(F.col("samples") < LEAST, "too short")))
    n = F.col("samples")
    hann = F.transform("x", lambda x, k: x * (0.5 - 0.5 * F.cos(2 * np.pi * k / n)))
    grid = F.transform(F.sequence(F.lit(0), F.floor((high - low) / step).cast("int")), lambda k: (low + k * step) / rate)
    ready = F.col("state").isNull()
    df = df.withColumn("x", F.when(ready, hann)).withColumn("cycles", F.when(ready, F.concat(grid, F.array(F.col("hz") / rate))))
    df = df.withColumn("db", F.transform(magnitudes("x", "cycles"), lambda m: X.dbfs(2 * m / (n / 2))))
    df = df.withColumn("tone_db", F.element_at("db", -1)).withColumn("db", F.slice(F.col("db"), F.lit(1), F.greatest(F.size("db") - 1, F.lit(0))))
    ranked = F.transform("db", lambda y: F.round(y, 6))
    df = df.withColumn("k", F.array_position(ranked, F.array_max(ranked)).cast("int") - 1)
    df = df.withColumn("dominant", _top(F.col("db"), F.col("k"), low, step)).withColumn("dominant_db", F.get("db", F.col("k")))
    # A sine of amplitude a leaves a * a / 2 times the sum of the squared window, which is 3 n / 8.
    energy = F.pow(F.lit(10.0), F.col("tone_db") / 10) / 2 * (3 * n / 8)
    share = F.when(ready, F.coalesce(F.least(F.lit(1.0), F.try_divide(energy, V.dot(F.col("x"), F.col("x")))), F.lit(0.0)))
    found = F.coalesce((F.col("tone_db") > FLOOR_DB) & (F.col("tone_db") - F.col("dominant_db") > UNDER_DB), F.lit(False))
    nearest = F.abs(F.col("dominant") - F.col("hz")) <= F.greatest(step, F.lit(NEAR_HZ))
    verdict = F.coalesce("state", F.when(found, "found").otherwise("not found"))
    return df.select(*carry, "channel", "samples", "dominant", "dominant_db", "tone_db", share.alias("share"), nearest.alias("nearest"), verdict.alias("verdict"))
