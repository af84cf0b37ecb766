"""The noise front-end as Spark jobs: a high-pass on arrays of samples, and one ordered pass over each stream's spectra.

The pass tracks the noise power of each bin, tells short transients from the energy of the raw
signal, and attenuates what is noise. Each frame's outcome depends on the ones before it, so a
stream stays on one task, a batch of frames at a time (`ordered.py`); many streams run side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.operators.series import folded

#: Samples that the filter takes at once; samples of several recordings, and frames of one, that are in work together.
BLOCK, AT_ONCE, FRAMES_AT_ONCE = 64, 1 << 20, 256

#: Fixed values of the tracker: shares of the new power in the fast track, of the track in the noise and in a new scene's, ratios of track to noise
#: that are an event and hot, the part of the bins that must be hot, frames that are averaged at first, and how long a new scene rises.
FAST, SLOW, SCENE, EVENT, HOT, BROAD, FIRST, SCENE_S, LEAST_HOPS = 0.55, 0.03, 0.25, 3.5, 4.0, 3, 5, 0.20, 4
#: Fixed values of transients: the ratio to the energy's floor, the hops they last at most, and shares of the energy in the floor.
RISE, MOST_HOPS, FLOOR_FAST, FLOOR_SLOW = 2.0, 6, 0.15, 0.08
#: Fixed value of the gain's release: the share of the gain before.
RELEASE = 0.75


@dataclass(frozen=True)
class Settings:
    """over: how often the noise counts; floor_db: the least gain; mix: the share of the cleaned signal; hop_s: seconds between frames."""

    over: float = 1.5
    floor_db: float = -8.0
    mix: float = 1.0
    hop_s: float = 256 / 48_000

    @property
    def scene_hops(self) -> int:
        return max(LEAST_HOPS, math.floor(SCENE_S / self.hop_s + 0.5))


def _filter(rate: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """What a block gives: of its samples, and of the two inputs and outputs before it (x1, x2, y1, y2)."""
    w = 2 * math.pi * cutoff / rate
    alpha, c = math.sin(w) / (2 * math.sqrt(2)), math.cos(w)
    b, a1, a2 = np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + alpha), -2 * c / (1 + alpha), (1 - alpha) / (1 + alpha)

    def response(x: list[float], x1: float, x2: float, y1: float, y2: float) -> list[float]:
        out = []
        for v in x:
            y = b[0] * v + b[1] * x1 + b[2] * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        return out

    impulse = response([1.0] + [0.0] * (BLOCK - 1), 0, 0, 0, 0)
    within = np.array([[0.0] * k + impulse[: BLOCK - k] for k in range(BLOCK)])
    return within, np.array([response([0.0] * BLOCK, *[float(k == j) for k in range(4)]) for j in range(4)])


class HighPass:
    """The filter over blocks of samples of several recordings at once, with what it carries from block to block. A cutoff of half the rate or more leaves samples as they are."""

    def __init__(self, rate: float, cutoff: float = 120.0, recordings: int = 1):
        self.within, self.before = (None, None) if cutoff >= rate / 2 else _filter(rate, cutoff)
        self.state = np.zeros((recordings, 4))

    def push(self, x: np.ndarray) -> np.ndarray:
        """x: recordings x samples."""
        if self.within is None:
            return x
        y = np.zeros_like(x, float)
        for k in range(0, x.shape[1], BLOCK):
            a, m = x[:, k : k + BLOCK], min(BLOCK, x.shape[1] - k)
            b = a @ self.within[:m, :m] + self.state @ self.before[:, :m]
            y[:, k : k + m] = b
            ins, outs = np.column_stack([self.state[:, 1::-1], a]), np.column_stack([self.state[:, 3:1:-1], b])
            self.state = np.column_stack([ins[:, -1], ins[:, -2], outs[:, -1], outs[:, -2]])
        return y


def high_passed(rate: float, cutoff: float = 120.0):
    """A second-order high-pass over arrays of samples. Arrays of one length are filtered together, AT_ONCE samples or one array at a time."""

    def filtered(pcm: pd.Series, sizes: np.ndarray) -> pd.Series:
        out = [None] * len(pcm)
        for n in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == n)
            for row, place in zip(HighPass(rate, cutoff, len(at)).push(np.stack(pcm.iloc[at].to_numpy()).astype(float, copy=False)), at, strict=True):
                out[place] = row
        return pd.Series(out, dtype=object)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pcm in batches:
            sizes = np.array([-1 if x is None else len(x) for x in pcm], np.int64)
            start = held = 0
            for k, n in enumerate(sizes.tolist()):
                if k > start and held + n > AT_ONCE:
                    yield filtered(pcm.iloc[start:k], sizes[start:k])
                    start, held = k, 0
                held += max(n, 0)
            if start < len(pcm):
                yield filtered(pcm.iloc[start:], sizes[start:])

    return run


CLEANED = "struct<noise:array<double>,ready:boolean,scene:boolean,protected:boolean,clean:array<double>,cut_db:double>"


class Tracker:
    """What one stream's pass carries from frame to frame."""

    def __init__(self, settings: Settings):
        self.s, self.least = settings, 10 ** (settings.floor_db / 20)
        self.track = self.noise = self.gain = self.floor = None
        self.seen = self.rising = self.loud = 0

    def learn(self, p: np.ndarray) -> bool:
        """Takes a frame's power into the noise; whether a new scene is being learnt."""
        if self.track is None:
            self.track, self.noise, self.gain = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
        self.track = (1 - FAST) * self.track + FAST * p
        if self.seen < FIRST:
            self.seen, self.noise = self.seen + 1, self.noise + p
            if self.seen == FIRST:
                self.noise = self.noise / FIRST
            return False
        self.rising = self.rising + 1 if (self.track > HOT * self.noise).sum() > len(p) // BROAD else 0
        scene = self.rising >= self.s.scene_hops
        slow = np.where(self.track > EVENT * self.noise, self.noise, (1 - SLOW) * self.noise + SLOW * self.track)
        self.noise = (1 - SCENE) * self.noise + SCENE * self.track if scene else slow
        return scene

    def short(self, energy: float) -> bool:
        """Whether a frame of this energy is part of a short transient."""
        if self.floor is None:
            self.floor = energy
        elif self.floor > 0 and energy > RISE * self.floor:
            self.loud += 1
            if self.loud <= MOST_HOPS:
                return True
            self.floor = (1 - FLOOR_FAST) * self.floor + FLOOR_FAST * energy
        else:
            self.loud, self.floor = 0, (1 - FLOOR_SLOW) * self.floor + FLOOR_SLOW * energy
        return False

    def cleaned(self, p: np.ndarray) -> np.ndarray:
        some = p > 0
        wanted = self.s.mix * np.maximum(p / np.where(some, p + self.s.over * self.noise, 1), self.least) + (1 - self.s.mix)
        self.gain = np.where(some, np.where(wanted > self.gain, wanted, RELEASE * self.gain + (1 - RELEASE) * wanted), self.gain)
        return np.where(some, p * self.gain, p)

    def push(self, power: np.ndarray, energy: float, tracked: np.ndarray) -> dict:
        """The outcome of a frame, of whose power `tracked` is learnt."""
        scene, short = self.learn(tracked), self.short(energy)
        ready, clean, cut = self.seen == FIRST, power, 0.0
        if ready and self.noise.sum() > 0 and not short:
            clean = self.cleaned(power)
            pre, post = power[power > 0].sum(), clean[power > 0].sum()
            cut = 10 * math.log10(pre / post) if 0 < post < pre else 0.0
        return {"noise": self.noise if ready else np.zeros(len(power)), "ready": ready, "scene": scene, "protected": short, "clean": clean, "cut_db": cut}

    def step(self, r) -> dict:
        """Of a row with power, energy and perhaps tracked."""
        p = np.asarray(r.power, float)
        out = self.push(p, r.energy, np.asarray(r.tracked, float) if hasattr(r, "tracked") else p)
        return out | {"noise": out["noise"].tolist(), "clean": out["clean"].tolist()}


def denoised(frames: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """frames: (stream, t, id, power, energy), one-sided spectra of one size a stream and the mean square of each frame's last 10 ms of raw signal. With
    a column `tracked` the noise is learnt from that (spectra whose mean was not taken off) and power is what is cleaned.

    Adds noise (zeros until ready, which takes FIRST frames), scene, whether a new scene is being learnt, protected, whether the frame is part of a short
    transient and stays as it is, clean, the attenuated spectrum, and cut_db, by how much its power fell.
    """
    out = folded(frames, ["stream"], lambda: Tracker(settings).step, "_out", CLEANED, FRAMES_AT_ONCE)
    return out.select(*frames.columns, "_out.*")


def long_enough(recordings: DataFrame, least: int = 1024 + 31 * 256) -> DataFrame:
    """recordings: (pcm, ...). Adds reject: why a recording is too short for one patch, null for others and for those without samples to tell."""
    n = F.size("pcm")
    return recordings.withColumn("reject", F.when(F.col("pcm").isNotNull() & (n < least), F.format_string(f"too short: %d samples, {least} at least", n)))
