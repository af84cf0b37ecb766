"""Streaming features: blocks of samples of many streams become log-mel frames, the same for any cut into blocks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chirplake.functions.signal import BANDS, FRAME, HOP, RATE, log_mel_of, spectra_of
from chirplake.operators.denoise import HighPass, Settings, Tracker
from chirplake.sources.recordings import RECENT
from chirplake.streaming.detection import SETTINGS

FRAMES = "stream string, frame long, sample long, mel array<double>, energy double, lost long"
STATE = "analyser binary, next_seq long, frames long, samples long, lost long, waiting binary"


class Analyser:
    """Log-mel frames of one stream's samples, which come in pieces of any length: the same frames as of the whole (`recordings.features`). What is carried is under a frame of
    samples, the filter's last values and the noise pass."""

    def __init__(self, settings: Settings | None = None, cutoff: float = 120.0):
        self.high_pass, self.tracker = HighPass(float(RATE), cutoff), Tracker(settings or Settings())
        self.raw, self.clean = np.zeros(0), np.zeros(0)

    def push(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The new frames' levels and mean squares."""
        x = np.asarray(x, np.float64)
        self.raw, self.clean = np.concatenate([self.raw, x]), np.concatenate([self.clean, self.high_pass.push(x[None, :])[0]])
        n = (len(self.raw) - FRAME) // HOP + 1 if len(self.raw) >= FRAME else 0
        if not n:
            return np.zeros((0, BANDS)), np.zeros(0)
        raw, clean = (np.lib.stride_tricks.sliding_window_view(a, FRAME)[::HOP] for a in (self.raw, self.clean))
        recent = np.mean(raw[:, -RECENT:] ** 2, axis=1)
        kept = [self.tracker.push(p, e, t)["clean"] for p, t, e in zip(*spectra_of(clean), recent, strict=True)]
        energy = np.mean(raw**2, axis=1)
        self.raw, self.clean = self.raw[n * HOP :].copy(), self.clean[n * HOP :].copy()
        return log_mel_of(np.stack(kept)), energy


class LinearResampler:
    """Downmixed blocks at another rate to 48 kHz, with the phase and the last sample carried from block to block."""

    def __init__(self, rate: int, to: int = 48000):
        self.rate, self.to, self.seen, self.made = rate, to, 0, 0
        self.last = 0.0

    def push(self, x: np.ndarray) -> np.ndarray:
        """What can be told so far: outputs up to the last sample that came."""
        if not len(x):
            return x
        begin = self.seen - 1 if self.seen else 0
        known = np.concatenate(([self.last], x)) if self.seen else np.asarray(x, np.float64)
        self.seen += len(x)
        end = (self.seen - 1) * self.to // self.rate + 1
        at = np.arange(self.made, end) * self.rate / self.to
        self.made, self.last = max(self.made, end), float(x[-1])
        return np.interp(at, begin + np.arange(len(known)), known)


RESAMPLED = "stream string, seq long, pcm array<double>"


def resampled_blocks(blocks: DataFrame, rate: int, to: int = 48000, channels: int = 1) -> DataFrame:
    """blocks: a stream of (stream, seq, pcm), interleaved samples of `channels` at `rate`, a stream's blocks in the order of seq over the batches. Each block as
    one channel at `to`: the same samples as of the whole recording in one piece, but for the last that await a next sample. State is a count in, a count out
    and the last sample. A block that is no multiple of channels loses what is over."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        r = LinearResampler(rate, to)
        if state.exists:
            r.seen, r.made, r.last = state.get
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, pcm in zip(rows["seq"], rows["pcm"], strict=True):
            x = np.asarray([] if pcm is None else pcm, np.float64)
            out.append((key[0], seq, r.push(x[: len(x) // channels * channels].reshape(-1, channels).mean(1)).tolist()))
        state.update((r.seen, r.made, r.last))
        yield pd.DataFrame(out, columns=["stream", "seq", "pcm"])

    return blocks.groupBy("stream").applyInPandasWithState(run, RESAMPLED, "seen long, made long, last double", "append", GroupStateTimeout.NoTimeout)


#: How far, in blocks, a stream may be ahead of a missing one (a second of audio); then that counts as lost. Time without blocks after which a stream is ended.
PATIENCE, IDLE_MS = 50, 600_000


def frames_of_blocks(blocks: DataFrame, settings: Settings | None = None, patience: int = PATIENCE, idle_ms: int = IDLE_MS) -> DataFrame:
    """blocks: a stream of (stream, seq, pcm), seq from 0. Gives (stream, frame, sample, mel, energy, lost); sample is where the frame begins, without what was lost.

    Blocks are taken in the order of seq whatever order they come in: those after a gap wait in the state until it is filled, or until the
    stream's latest block is over `patience` blocks past it; then the missing blocks are given up and counted in `lost`, which every later frame carries, and the analysis
    begins anew behind them, so that no frame holds samples of both sides. A repeated or late block is left out. A stream that brings nothing for idle_ms
    is taken to its end, gaps given up, and its state is removed. State is the samples of one frame, the noise tracker's arrays and the blocks that wait.
    """
    for name, value in SETTINGS.items():
        blocks.sparkSession.conf.set(name, value)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        analyser, expected, done, samples, lost, waiting = Analyser(settings), 0, 0, 0, 0, {}
        if state.exists:
            saved, expected, done, samples, lost, held = state.get
            analyser, waiting = pickle.loads(saved), pickle.loads(held)
        for rows in batches:
            for seq, pcm in zip(rows["seq"], rows["pcm"], strict=True):
                if seq >= expected:
                    waiting[int(seq)] = np.asarray(pcm, np.float32)
        parts = []
        while waiting and (expected in waiting or state.hasTimedOut or max(waiting) - expected > patience):
            if expected not in waiting:
                lost += min(waiting) - expected
                expected, analyser, samples = min(waiting), Analyser(settings), samples + len(analyser.raw)
            ready = []
            while expected in waiting:
                ready.append(waiting.pop(expected))
                expected += 1
            mel, energy = analyser.push(np.concatenate(ready))
            at = np.arange(len(energy))
            parts.append(pd.DataFrame({"stream": key[0], "frame": done + at, "sample": samples + at * HOP, "mel": list(mel), "energy": energy, "lost": lost}))
            done, samples = done + len(energy), samples + len(energy) * HOP
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((pickle.dumps(analyser), expected, done, samples, lost, pickle.dumps(waiting)))
            state.setTimeoutDuration(idle_ms)
        yield pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("stream", "frame", "sample", "mel", "energy", "lost")})

    return blocks.groupBy("stream").applyInPandasWithState(run, FRAMES, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
