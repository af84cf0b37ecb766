"""Operators over ordered values of a stream: frames, averages, anchors, and order-dependent folds.

A fold keeps a stream on one task, as each row's outcome depends on the ones kept before; many
streams run in parallel. Streams of one table are ordered by `t`, then `id`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import vectors as V
from chirplake.operators.ordered import in_batches, in_order, plain_rows


def numbered(df: DataFrame) -> DataFrame:
    """frame from 0 in each stream."""
    return df.withColumn("frame", F.row_number().over(Window.partitionBy("stream").orderBy("t", "id")) - 1)


def moving_average(frames: DataFrame, half: int = 7) -> DataFrame:
    """Centred over 2 * half + 1 frames; the window is cut at the ends."""
    return frames.withColumn("smooth", F.avg("value").over(Window.partitionBy("stream").orderBy("frame").rowsBetween(-half, half)))


def window_peak(frames: DataFrame, n: int = 32) -> DataFrame:
    return frames.withColumn("peak", F.max("value").over(Window.partitionBy("stream").orderBy("frame").rowsBetween(1 - n, 0)))


def sliding_patches(frames: DataFrame, n: int = 32) -> DataFrame:
    """The last n values for each frame that has so many."""
    w = Window.partitionBy("stream").orderBy("frame").rowsBetween(1 - n, 0)
    return frames.withColumn("patch", F.collect_list("value").over(w)).where(F.size("patch") == n)


def anchors(smoothed: DataFrame, digits: int = 9) -> DataFrame:
    """The frame of the greatest smoothed value of each stream, the first on ties."""
    best = F.max(F.struct(F.round("smooth", digits).alias("s"), (-F.col("frame")).alias("down")))
    return smoothed.groupBy("stream").agg(best.alias("b"), F.count("*").alias("frames")).select("stream", (-F.col("b.down")).alias("anchor"), F.col("b.s").alias("smooth"), "frames")


def anchor_patches(frames: DataFrame, found: DataFrame, n: int = 32) -> DataFrame:
    """The frames of the n-frame patch that begins (n - 1) // 2 before each anchor, its start kept inside the stream; streams shorter than n give none."""
    start = F.greatest(F.lit(0), F.least(F.col("anchor") - (n - 1) // 2, F.col("frames") - n))
    spans = found.where(F.col("frames") >= n).select("stream", start.alias("start"))
    return frames.join(spans, "stream").where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + n))


def clip_seconds(frames: Column) -> Column:
    """The length of a recording that has so many frames, 0 for none."""
    return F.when(frames > 0, (1024 + (frames - 1) * 256) / 48000.0).otherwise(0.0)


def weak(long: Column, peak: Column, bed: Column, share: float = 0.25, rise_db: float = 9.0) -> Column:
    """Whether a peak stands out too little from its bed; recordings that aren't `long` never are weak."""
    flat = (bed > 1e-18) & (bed <= share * peak) & (10 * F.log10(peak / bed) < rise_db)
    return F.coalesce(long & ((peak <= 1e-12) | flat), F.lit(False))


def weak_anchors(frames: DataFrame, seconds: Column | None = None, around: int = 3, least_frames: int = 8, share: float = 0.25, rise_db: float = 9.0, least_seconds: float = 0.75) -> DataFrame:
    """For each stream whether its anchor stands out too little: peak is the value at the anchor, the top of the smoothed curve (which need not be the
    greatest value), and bed the mean of what is over `around` frames away from it.

    Streams of least_seconds or less, or of under least_frames frames, are never weak; `seconds` is told from the column frames.
    """
    peaks = anchors(moving_average(frames)).select("stream", F.col("anchor").alias("at"), "frames")
    far = F.abs(F.col("frame") - F.col("at")) > around
    out = frames.join(peaks, "stream").groupBy("stream", "at", "frames").agg(F.max(F.when(F.col("frame") == F.col("at"), F.col("value"))).alias("peak"), F.avg(F.when(far, F.col("value"))).alias("bed"))
    long = ((clip_seconds(F.col("frames")) if seconds is None else seconds) > least_seconds) & (F.col("frames") >= least_frames)
    return out.withColumn("weak", weak(long, F.col("peak"), F.col("bed"), share, rise_db))


#: Fixed values of the onset rule: frames that count, quiet beds and peaks, the bed's share of a sustained sound, and loud frames.
ONSET_FRAMES, QUIET_BED, QUIET_PEAK, AUDIBLE, SUSTAINED, LOUD_FRAMES = 96, 1e-12, 1e-10, 1e-5, 0.05, 5


def onset(energies: Column, rise_db: float = 2.5) -> Column:
    """Over an array of energies, oldest first, of which the last ONSET_FRAMES count: under 8, or a rise of 0 or less, pass.

    Else the last two fifths' peak must rise by rise_db over the mean of the frames before; or be audible over a quiet bed, or over one that is
    itself loud; or enough of the last frames are loud.
    """
    recent = F.slice(energies, F.greatest(F.lit(1), F.size(energies) - ONSET_FRAMES + 1), F.lit(ONSET_FRAMES))

    def told(e: Column) -> Column:
        head = F.floor(F.size(e) * 3 / 5).cast("int")
        tip = F.slice(e, head + 1, F.size(e) - head)
        facts = F.struct(F.greatest(F.array_max(tip), F.lit(0.0)).alias("peak"), (V.total(F.slice(e, F.lit(1), head)) / head).alias("bed"), tip.alias("tip"))
        return V.let(facts, passed)

    def passed(f: Column) -> Column:
        loud = F.size(F.filter(f["tip"], lambda x: x >= F.greatest(f["bed"] * 10 ** (rise_db / 20), F.lit(AUDIBLE))))
        rises = (10 * F.log10(f["peak"] / f["bed"]) >= rise_db) | ((f["peak"] > AUDIBLE) & (f["bed"] > f["peak"] * SUSTAINED)) | (loud >= F.least(F.lit(LOUD_FRAMES), F.size(f["tip"])))
        return F.when(f["bed"] <= QUIET_BED, f["peak"] > QUIET_PEAK).when(f["peak"] <= 0, False).otherwise(rises)

    return F.lit(True) if rise_db <= 0 else F.when(F.size(energies) < 8, True).otherwise(V.let(recent, told))


def level_db(df: DataFrame, samples: int) -> DataFrame:
    """The level of each row's stream over its last `samples` rows, as 20 log10 of the root mean square; null for silence."""
    w = Window.partitionBy("stream").orderBy("t", "id").rowsBetween(1 - samples, 0)
    return df.withColumn("level_db", X.dbfs(F.sqrt(F.avg(F.col("value") * F.col("value")).over(w))))


def latest_guess(df: DataFrame) -> DataFrame:
    """df: (stream, t, id, item), item null where a window has no result. The item of each stream's last window: none if that one has none."""
    return df.groupBy("stream").agg(F.max(F.struct("t", "id", "item")).alias("last")).select("stream", F.col("last.item").alias("item"), F.col("last.t").alias("t"))


def ticks(df: DataFrame, wait: pd.Timedelta) -> DataFrame:
    """df: (stream, t, id, item), item null in silence. A row at least every `wait`, with the last ranking's item, also in silence."""
    upto = Window.partitionBy("stream").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return cooldown(df.withColumn("top", F.last("item", ignorenulls=True).over(upto)), ["stream"], wait)


def shown_sets(df: DataFrame, lifetime: pd.Timedelta, most: int) -> DataFrame:
    """After each row (stream, t, id, item): how many items are shown, and how many were evicted so far.

    A row shows its item for `lifetime`; one that is shown already is refreshed in place and becomes the newest. Where `most` are shown the oldest
    goes, and is counted; what has lived its time goes uncounted.
    """

    def make():
        shown: dict = {}
        evicted = 0

        def step(r):
            nonlocal evicted
            for item in [i for i, t in shown.items() if r.t - t >= lifetime]:
                del shown[item]
            if r.item not in shown and len(shown) >= most:
                del shown[next(iter(shown))]
                evicted += 1
            shown.pop(r.item, None)
            shown[r.item] = r.t
            return {"shown": len(shown), "evicted": evicted}

        return step

    return folded(df, ["stream"], make, "set", "struct<shown:int,evicted:long>").select(*df.columns, "set.shown", "set.evicted")


def trailing(df: DataFrame, seconds: int) -> DataFrame:
    """For each row how many rows of its stream and what sum of values are in the last `seconds`."""
    w = Window.partitionBy("stream").orderBy(F.unix_micros("t")).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("value").over(w))


#: Fixed bounds of a clip's length in seconds.
CLIP_SECONDS = (1, 30)


def clip_length(seconds: float) -> float:
    return min(max(seconds, CLIP_SECONDS[0]), CLIP_SECONDS[1])


def clips(captures: DataFrame, rows: DataFrame, seconds: float) -> DataFrame:
    """captures: (clip, stream, t); rows: (stream, t, ...). For each capture its stream's rows of the last `seconds`, its own time included: rows' columns with clip.

    Rows stand in bins of that length and a capture in two, that of its time and the one before, so that they meet by equality of stream and bin; a
    bin holds no more than a clip does. Nulls meet nothing, but a null stream is a stream.
    """
    span = round(seconds * 1_000_000)
    bin_of = lambda t: F.floor(F.unix_micros(t) / F.lit(span)).cast("long")
    wanted = captures.select("clip", F.struct("stream").alias("_stream"), F.unix_micros("t").alias("_until"), F.explode(F.array(bin_of("t"), bin_of("t") - 1)).alias("_bin"))
    met = rows.withColumns({"_stream": F.struct("stream"), "_bin": bin_of("t"), "_at": F.unix_micros("t")}).join(wanted, ["_stream", "_bin"])
    return met.where((F.col("_at") <= F.col("_until")) & (F.col("_at") > F.col("_until") - span)).select("clip", *rows.columns)


def newest(df: DataFrame, by: list[str], n: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("id")))).where(F.col("rk") <= n)


def folded(df: DataFrame, by: list[str], make: Callable[[], Callable[[object], object]], out: str, kind: str, most: int = 10_000) -> DataFrame:
    """df with the column `out`: for each group of `by` a new step function sees its rows in the order of t and id, a batch in memory at a time.
    What the steps give leaves the task every `most` rows, few where rows are long."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, step = None, None
        for rows in (b.iloc[k : k + most] for b in batches for k in range(0, len(b), most)):
            done = []
            for key, r in zip(plain_rows([rows], by), rows.itertuples(index=False), strict=True):
                if step is None or key != group:
                    group, step = key, make()
                done.append(step(r))
            yield rows.assign(**{out: pd.Series(done, index=rows.index, dtype=object)})

    return in_order(df, by, ["t", "id"]).mapInPandas(run, schema)


def cooldown(df: DataFrame, by: list[str], wait: pd.Timedelta) -> DataFrame:
    """Rows that are kept: the first of each group, then the next at least `wait` after the last kept one."""

    def make():
        last = None

        def step(r):
            nonlocal last
            if last is not None and r.t - last < wait:
                return False
            last = r.t
            return True

        return step

    return folded(df, by, make, "fired", "boolean").where("fired").drop("fired")


def noise_floor(df: DataFrame, rise: float = 0.0083, decay: float = 0.0014) -> DataFrame:
    """floor and peak of each row's stream so far: the floor drops at once and rises slowly, the peak rises at once and decays slowly."""

    def make():
        floor = peak = None

        def step(r):
            nonlocal floor, peak
            x = r.value
            floor = x if floor is None or x < floor else floor + rise * (x - floor)
            peak = x if peak is None or x > peak else peak + decay * (x - peak)
            return {"floor": floor, "peak": peak}

        return step

    return folded(df, ["stream"], make, "track", "struct<floor:double,peak:double>").select(*df.columns, "track.floor", "track.peak")


def adaptive_gate(floor: Column, peak: Column, configured: float = -60.0, over: float = 4.0, least: float = -70.0, spread: float = 12.0, quiet: float = -42.0) -> Column:
    """All in dB: floor + over, at least `least` and the configured gate; the configured one where the range is small and the floor isn't quiet."""
    adapted = F.greatest(F.lit(configured), F.lit(least), floor + over)
    return F.when((peak - floor < spread) & (floor > quiet), configured).otherwise(adapted)


def frame_gate(df: DataFrame, gate_db: float) -> DataFrame:
    """df: (stream, t, id, level, floor), in dB. gated: the level is under floor + gate_db, and under the loudest such level before it; the first
    such frame, and one as loud as any of them, stays. A gate of 0 or less is off."""
    low = F.col("level") < F.col("floor") + gate_db
    before = Window.partitionBy("stream").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    loudest = F.max(F.when(low, F.col("level"))).over(before)
    return df.withColumn("gated", F.coalesce(low & (F.col("level") < loudest), F.lit(False)) if gate_db > 0 else F.lit(False))


def active_spans(df: DataFrame, lifetime: str) -> DataFrame:
    """Spans in which an item of a stream is shown: each event shows it for lifetime, again and again."""
    out = df.groupBy("stream", "item", F.session_window("t", lifetime).alias("w")).agg(F.count("*").alias("events"))
    return out.select("stream", "item", F.col("w.start").alias("shown"), F.col("w.end").alias("hidden"), "events")


def refined(x: Column, level: Column, order: Window) -> Column:
    """The place of the parabola's top through a point and its neighbours; the point's own where that is over a step away."""
    before, after = F.lag(level).over(order), F.lead(level).over(order)
    delta = F.try_divide(0.5 * (before - after), before - 2 * level + after)
    return F.when(F.abs(delta) <= 1, x + delta * (F.lead(x).over(order) - F.lag(x).over(order)) / 2).otherwise(x)


def separated_peaks(points: DataFrame, apart: float, n: int, floor: float = -70.0) -> DataFrame:
    """points: (grp, x, level). The strongest local maxima of a group over the floor of which none is under `apart` from one kept before, up to n.

    A maximum is not below the point before it and above the one behind; its x is refined by the parabola through the three.
    """
    order = Window.partitionBy("grp").orderBy("x")
    top = (F.col("level") >= F.lag("level").over(order)) & (F.col("level") > F.lead("level").over(order)) & (F.col("level") > floor)
    maxima = points.withColumn("top", top).withColumn("at", refined(F.col("x"), F.col("level"), order)).where("top").select("grp", F.col("at").alias("x"), "level")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for grp, rows in groupby(plain_rows(batches, ["grp", "x", "level"]), key=lambda r: r[0]):
            xs: list[float] = []
            for _, x, level in rows:
                if len(xs) < n and all(abs(x - k) >= apart for k in xs):
                    xs.append(x)
                    yield grp, x, level, len(xs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_batches(kept(batches), ["grp", "x", "level", "rk"])

    kinds = dict(points.dtypes)
    return in_order(maxima, ["grp"], [F.desc("level"), "x"]).mapInPandas(run, f"grp {kinds['grp']}, x double, level double, rk int")


def lost_blocks(df: DataFrame, gate: float) -> DataFrame:
    """Of each stream: blocks that came, numbers between its first and last that didn't (dropped), repeats, and silent blocks.

    A block is silent if the highest value under its number is null or below the gate.
    """
    blocks = df.groupBy("stream", "seq").agg(F.count("*").alias("n"), F.max("value").alias("value"))
    silent = F.coalesce(F.col("value") < gate, F.lit(True))
    return blocks.groupBy("stream").agg(
        F.count("*").alias("blocks"),
        (F.max("seq") - F.min("seq") + 1 - F.count("*")).cast("long").alias("dropped"),
        F.sum(F.col("n") - 1).alias("repeated"),
        F.count_if(silent).alias("silent"),
    )


def stream_totals(df: DataFrame, gate: float) -> DataFrame:
    return df.groupBy("stream").agg(F.count("*").alias("blocks"), F.count_if(F.col("value") < gate).alias("silent"), F.max("value").alias("max_level"), F.avg("value").alias("avg_level"))


