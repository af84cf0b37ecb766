"""Expressions over arrays of samples. Fixed values follow the engine's defaults: 48 kHz, frames of 1024 samples every 256, 64 mel bands from 40 Hz to 16 kHz. What Spark has no expression for (the Fourier transform, products with a fixed matrix, wrapped integers) is numpy on Arrow batches of rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.functions import vectors as V

DOUBLES = T.ArrayType(T.DoubleType())
RATE, FRAME, HOP, BANDS, F_MIN, F_MAX = 48_000, 1024, 256, 64, 40.0, 16_000.0
#: Frames that are transformed together.
AT_ONCE = 256


def downmixed(pcm: Column, channels: int | Column) -> Column:
    """The mean over the channels of interleaved samples; what is left of a last, incomplete frame goes."""
    channels = F.lit(channels) if isinstance(channels, int) else channels
    at = F.sequence(F.lit(0), F.floor(F.size(pcm) / channels).cast("int") - 1)
    return F.when(F.size(pcm) < channels, F.array().cast("array<double>")).otherwise(F.transform(at, lambda k: V.total(F.slice(pcm, k * channels + 1, channels)) / channels))


def resampled(pcm: Column, rate: int | Column, to: int) -> Column:
    """Linear, without a low-pass; one sample at least, and the last one is held."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    n = F.size(pcm)
    at = F.sequence(F.lit(0), F.greatest(F.round(n * (F.lit(to) / rate)).cast("int"), F.lit(1)) - 1)

    def one(k: Column) -> Column:
        place = k * (rate / F.lit(to))
        low = F.floor(place).cast("int")
        return F.when(low >= n - 1, F.get(pcm, n - 1)).otherwise(F.get(pcm, low) + (place - low) * (F.get(pcm, low + 1) - F.get(pcm, low)))

    return F.when((n == 0) | (rate == to), pcm).otherwise(F.transform(at, one))


def canonical(pcm: Column, channels: int | Column, rate: int | Column, to: int = 48_000) -> Column:
    """Interleaved samples of any number of channels and rate as one channel at `to`; each row has a format of its own."""
    return V.let(downmixed(pcm, channels), lambda mono: resampled(mono, rate, to))


def framed(pcm: Column, size: int, hop: int) -> Column:
    """Overlapping frames, in order; none for fewer samples than one."""
    at = F.sequence(F.lit(0), F.floor((F.size(pcm) - size) / hop).cast("int"))
    return F.when(F.size(pcm) < size, F.array().cast("array<array<double>>")).otherwise(F.transform(at, lambda k: F.slice(pcm, k * hop + 1, F.lit(size))))


def tapered(frame: Column) -> Column:
    """The mean taken off, times the periodic Hann window."""
    step = 2 * math.pi / F.size(frame)
    return F.transform(V.centred(frame), lambda x, k: x * (0.5 - 0.5 * F.cos(step * k)))


def energy(frame: Column) -> Column:
    return V.dot(frame, frame) / F.size(frame)


def amplitude(pcm: Column, cycles: Column) -> Column:
    """Of a tapered signal at a frequency given as cycles a sample: twice the magnitude of its transform over the window's sum."""
    turn = lambda f: V.total(F.transform(pcm, lambda x, k: x * f(2 * math.pi * cycles * k)))
    re, im = turn(F.cos), turn(F.sin)
    return 2 * F.sqrt(re * re + im * im) / (F.size(pcm) / 2)


def one_sided(frames: np.ndarray) -> np.ndarray:
    """Power spectra of rows; all bins but the first and last count twice."""
    p = np.abs(np.fft.rfft(frames)) ** 2
    p[:, 1:-1] *= 2
    return p


def spectra_of(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of samples: power of the tapered rows with the mean taken off, and with it left."""
    n = frames.shape[1]
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return one_sided((frames - frames.mean(1, keepdims=True)) * taper), one_sided(frames * taper)


def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rows that are in work together, as arrays are copied several times there and what is made of them leaves the task part by part."""
    return (rows.iloc[k : k + AT_ONCE] for rows in batches for k in range(0, len(rows), AT_ONCE))


@F.pandas_udf(T.StructType([T.StructField("power", DOUBLES), T.StructField("tracked", DOUBLES)]))
def spectra(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Both spectra of frames of one length."""
    for part in _parts(frames):
        power, tracked = spectra_of(np.stack(part.to_numpy()))
        yield pd.DataFrame({"power": list(power), "tracked": list(tracked)})


def mel_weights() -> np.ndarray:
    """Triangles of unit area between edges that are equally far apart on the mel scale, bands x bins."""
    low, high = (2595 * math.log10(1 + f / 700) for f in (F_MIN, F_MAX))
    edges = 700 * (10 ** (np.linspace(low, high, BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - left) / (mid - left), (right - f) / (right - mid))) * 2 / (right - left)


def log_mel_of(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(power @ mel_weights().T, 1e-12))


@F.pandas_udf(DOUBLES)
def log_mel(power: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Levels of the mel bands, in dB, of spectra of frames of FRAME samples."""
    for part in _parts(power):
        yield pd.Series(list(log_mel_of(np.stack(part.to_numpy()))))


@F.pandas_udf(DOUBLES)
def power(frames: pd.Series) -> pd.Series:
    """One-sided power spectra of tapered frames; all bins but the first and last count twice."""

    out = [None] * len(frames)
    sizes = frames.map(lambda x: -1 if x is None else len(x))
    for n in sizes.unique():  # frames of one length are transformed at once
        at = np.flatnonzero(sizes == n)
        if n > 0:
            p = one_sided(np.stack(frames.iloc[at].to_numpy()))
        for k, row in zip(at, p if n > 0 else [None if n < 0 else np.zeros(0)] * len(at)):
            out[k] = row
    return pd.Series(out)


def smoothed(v: Column, half: int) -> Column:
    """Centred mean over 2 * half + 1 places; the window is cut at the ends."""

    def at(k: Column) -> Column:
        low, high = F.greatest(k - half, F.lit(0)), F.least(k + half, F.size(v) - 1)
        return V.total(F.slice(v, low + 1, high - low + 1)) / (high - low + 1)

    return F.transform(F.sequence(F.lit(0), F.size(v) - 1), at)


#: Fixed values of the confirm embedding: patches' distance from the peak in frames, and the half width of its smoothing.
OFFSETS, EMBED_HALF = (-8, 0, 8), 4


def confirm_patch(frames: Column, n: int, offsets: tuple[int, ...] = OFFSETS, half: int = EMBED_HALF) -> Column:
    """The mean of unit patches of n frames, centred on the loudest frame (smoothed, the first on ties) and `offsets` away, starts kept
    inside the recording; null for fewer frames than n. frames: arrays of log-mel bands."""
    energies = F.transform(frames, lambda f: V.dot(f, f))
    last = F.size(frames) - n

    def patches(peak: Column) -> Column:
        starts = [F.greatest(F.lit(0), F.least(peak + k - (n - 1) // 2, last)) for k in offsets]
        return F.array(*[V.patch_normalise(F.flatten(F.slice(frames, s + 1, F.lit(n)))) for s in starts])

    def pooled(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(p[0]) - 1), lambda k: V.total(F.transform(p, lambda x: F.get(x, k))) / len(offsets))

    peak = lambda sm: (F.array_position(sm, F.array_max(sm)) - 1).cast("int")
    return F.when(F.size(frames) >= n, V.let(V.let(V.let(smoothed(energies, half), peak), patches), pooled))


#: Fixed values of the sign hash: factors of the two places, what is mixed in, and the factor between its two shifts (16 and 15).
SIGN_HASH = (0x9E3779B9, 0x85EBCA6B, 0xA5A5A5A5, 0x7FEB352D)
#: Fixed values of the noise generator: factor and increment.
NOISE_STEPS = (1664525, 1013904223)


def projected(dim: int):
    """Random signs by a hash of the two places, then unit length: arrays of one length to `dim` values."""

    @F.pandas_udf(DOUBLES)
    def run(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return vectors
        v = np.stack(vectors.to_numpy())
        of_place, of_dim, mixed, factor = map(np.uint32, SIGN_HASH)
        x = np.arange(v.shape[1], dtype=np.uint32)[:, None] * of_place ^ np.arange(dim, dtype=np.uint32)[None, :] * of_dim ^ mixed
        x = (x ^ x >> np.uint32(16)) * factor
        out = v @ np.where(np.bitwise_count(x ^ x >> np.uint32(15)) & 1, 1.0, -1.0)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(np.divide(out, norm, out=out, where=norm > 0)))

    return run


def _noise(n: int, seed: int) -> np.ndarray:
    """n values in [-1, 1) of a linear congruential generator."""
    factor, increment = map(np.uint32, NOISE_STEPS)
    powers = np.cumprod(np.full(n, factor, np.uint32), dtype=np.uint32)
    before = np.concatenate((np.ones(min(n, 1), np.uint32), powers[:-1]))
    state = powers * np.uint32(seed or 1) + increment * np.cumsum(before, dtype=np.uint32)
    return (state >> np.uint32(8)) / (1 << 24) * 2 - 1


@F.pandas_udf(DOUBLES)
def with_noise(pcm: pd.Series, snr_db: pd.Series, seed: pd.Series) -> pd.Series:
    """White noise added at a ratio to the signal's own power; silence stays."""
    loud = [math.sqrt(3 * np.mean(np.square(x)) / 10 ** (db / 10)) if len(x) else 0.0 for x, db in zip(pcm, snr_db, strict=True)]
    return pd.Series([np.asarray(x) + scale * _noise(len(x), s) for x, scale, s in zip(pcm, loud, seed, strict=True)])
