"""The detector: silence gate, search result, peak hold, threshold and margin, cooldown, refractory, confirmation.

One class serves the batch form (sorted streams, a batch at a time) and the streaming form (state
between micro-batches); times are milliseconds of audio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.operators.ordered import in_batches, in_order, plain_rows


@dataclass(frozen=True)
class Rules:
    """Fixed values of the detector's defaults; a negative hold is none."""

    threshold: float = 0.75
    margin: float = 0.05
    gate_db: float = -60.0
    cooldown_ms: float = 400
    refractory_ms: float = 50
    hold_ms: float = 48
    hold_drop: float = 0.02
    top: int = 5
    thresholds: dict = field(default_factory=dict)
    cooldowns: dict = field(default_factory=dict)


@dataclass
class Held:
    item: str
    score: float
    margin: float | None
    level: float
    armed: float
    template: int | None = None
    accept: bool | None = None


class Detector:
    """step() takes one window and gives the event that it fires, or None; `counts` has each window's outcome."""

    def __init__(self, rules: Rules, confirm: Callable[[Held], bool] | None = None):
        self.rules, self.confirm = rules, confirm
        self.thresholds: dict[str, float] = dict(rules.thresholds)
        self.reset()

    def reset(self) -> None:
        """Forgets timers, what is held and the counts; thresholds stay."""
        self.last_any: float | None = None
        self.last: dict[str, float] = {}
        self.held: Held | None = None
        self.counts = {"ticks": 0, "silent": 0, "rejected": 0, "fired": 0}

    def state(self) -> dict:
        return {"last_any": self.last_any, "last": dict(self.last), "held": asdict(self.held) if self.held else None, "counts": dict(self.counts), "thresholds": dict(self.thresholds)}

    def restore(self, state: dict) -> None:
        self.last_any, self.last, self.counts = state["last_any"], dict(state["last"]), dict(state["counts"])
        self.thresholds = dict(state["thresholds"])
        self.held = Held(**state["held"]) if state["held"] else None

    def change(self, item: str | None, threshold: float | None) -> None:
        """Gives an item its own threshold from now on; none or one of 0 or less takes it back. No item: reset."""
        if item is None:
            self.reset()
        elif threshold is None or threshold <= 0:
            self.thresholds.pop(item, None)
        else:
            self.thresholds[item] = threshold

    def _fire(self, now: float, onset: bool | None = None) -> dict | None:
        held, self.held = self.held, None
        if held is None:
            return None
        if held.accept is False or onset is False or self.confirm and not self.confirm(held):
            self.counts["rejected"] += 1  # the timers stay as they are
            return None
        self.last[held.item] = self.last_any = now
        self.counts["fired"] += 1
        return {"item": held.item, "score": held.score, "margin": held.margin, "level": held.level, "at": now}

    def step(self, now: float, level: float | None, ranking: list[tuple], accept: bool | None = None, onset: bool | None = None) -> dict | None:
        """ranking: (item, score[, template]) in rank order, None level: digital silence.

        accept: whether the window would be confirmed as its first item; it stays with the window that is held. onset: whether a sound has
        set in by this window; it counts when the window fires what is held. A False refuses the event, and the timers stay.
        """
        r = self.rules
        self.counts["ticks"] += 1
        if level is None or level < r.gate_db:
            self.counts["silent"] += 1
            return self._fire(now, onset)
        if not ranking:
            return self._fire(now, onset)
        item, score, *template = ranking[0]
        rival = next((s for i, s, *_ in ranking[1 : r.top] if i != item), None)
        margin = None if rival is None else score - rival
        good = score >= self.thresholds.get(item, r.threshold) and (margin is None or margin >= r.margin)
        found = Held(item, score, margin, level, now, template[0] if template else None, accept)
        held = self.held
        if held:
            same = held.item == item
            if same and score > held.score:
                found.armed = held.armed
                self.held = held = found
            if not same or score < held.score - r.hold_drop or now - held.armed >= r.hold_ms or not good:
                return self._fire(now, onset)
            return None
        cooling = item in self.last and now - self.last[item] < r.cooldowns.get(item, r.cooldown_ms)
        waiting = self.last_any is not None and now - self.last_any < r.refractory_ms
        if not good or cooling or waiting:
            self.counts["rejected"] += 1
            return None
        self.held = found
        return self._fire(now, onset) if r.hold_ms < 0 else None


EVENTS = "stream long, item string, score double, margin double, level double, at double"


def with_changes(scores: DataFrame, changes: DataFrame, time: str = "t") -> DataFrame:
    """Adds changes while a stream runs, (stream, time, item, threshold), as rows of rank 0: they hold from their time on, before its window.

    A null threshold or one of 0 or less takes an item's own threshold back; a null item resets the
    stream's detector. Of several changes at one time those without an item come first, then by item and threshold.
    """
    kinds = {f.name: f.dataType for f in scores.schema.fields}
    values = {"level": F.lit(None), "rk": F.lit(0), "score": F.col("threshold")}
    return scores.unionByName(changes.select(*[values.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in ("stream", time, "level", "rk", "item", "score")]))


#: The rank of a row that ends a stream; it is no window.
END = -1
#: Columns of what is known about a window before it is stepped through; null: nothing.
EVIDENCE = ["accept", "onset"]


def run(detector: Detector, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Takes the detector through (t, level, rk, item, score, accept, onset), sorted by t, rk, item and score, and gives its events' values.

    Rows without an item are windows without a result; rows of rank 0 are changes, those of rank END nothing.
    Evidence counts from the window's first row.
    """
    for t, window in groupby(rows, key=lambda r: r[0]):
        level, ranking, known, seen = None, [], (None, None), False
        for _, loud, rk, item, score, *evidence in window:
            if rk == 0:
                detector.change(item, score)
                continue
            if rk == END:
                continue
            if not seen:
                level, known, seen = loud, evidence or known, True
            if item is not None:
                ranking.append((item, score))
        event = detector.step(float(t), level, ranking, *known) if seen else None
        if event:
            yield tuple(event.values())


ORDER = ["t", "rk", "item", "score"]
COLUMNS = ["stream", "t", "level", "rk", "item", "score"]


def _streams(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Each stream with its rows without it."""
    for stream, rows in groupby(plain_rows(batches, COLUMNS + EVIDENCE), key=lambda r: r[0]):
        yield stream, (r[1:] for r in rows)


def _with_evidence(scores: DataFrame) -> DataFrame:
    return scores.select(*COLUMNS, *[F.col(c) if c in scores.columns else F.lit(None).cast("boolean").alias(c) for c in EVIDENCE])


def detect(scores: DataFrame, rules: Rules, confirm: Callable[[Held], bool] | None = None) -> DataFrame:
    """scores: (stream, t in ms, level, rk, item, score, and accept and onset where there is evidence), the ranked items of each window. Gives the events.

    A stream's windows are stepped through in time order, a batch in memory at a time; what is
    still held at its end isn't fired. A null stream is a stream.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = ((stream, *event) for stream, rows in _streams(batches) for event in run(Detector(rules, confirm), rows))
        yield from in_batches(found, ["stream", "item", "score", "margin", "level", "at"])

    return in_order(_with_evidence(scores), ["stream"], ORDER).mapInPandas(work, EVENTS)


def outcomes(scores: DataFrame, rules: Rules) -> DataFrame:
    """Each stream's counts of windows, silent ones, rejections and events."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for stream, rows in _streams(batches):
            d = Detector(rules)
            for _ in run(d, rows):
                pass
            yield stream, *d.counts.values()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_batches(counted(batches), ["stream", "ticks", "silent", "rejected", "fired"])

    return in_order(_with_evidence(scores), ["stream"], ORDER).mapInPandas(work, "stream long, ticks long, silent long, rejected long, fired long")
