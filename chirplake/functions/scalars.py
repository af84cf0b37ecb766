"""Scalar expressions: levels, rounding, text and metadata normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 48000
HOP = 256
DEFAULT_THRESHOLD = 0.72
DEFAULT_COOLDOWN_MS = 400


def dbfs(x: Column) -> Column:
    """20 log10(x); null for silence (0 and below)."""
    return F.when(x > 0, 20 * F.log10(x))


def mel(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hz(mel_value: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel_value / 2595) - 1)


def log_energy(e: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(e, F.lit(floor)))


def to_int16(v: Column, scale: int = 32767) -> Column:
    """Saturating, half away from zero."""
    return F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), F.round(v * scale))).cast("int")


def round3(v: Column) -> Column:
    """Truncation of v * 1000 + 0.5, which differs from rounding for negative values."""
    return (v * 1000 + 0.5).cast("bigint") / 1000


def finite(v: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def clamp_threshold(v: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(v, F.lit(DEFAULT_THRESHOLD))))


def clamp_cooldown(v: Column) -> Column:
    return F.least(F.lit(600_000), F.greatest(F.lit(0), F.coalesce(v, F.lit(DEFAULT_COOLDOWN_MS))))


def tags(text: Column) -> Column:
    """Split on commas and semicolons of both widths, blanks, tabs and line breaks; blanks dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.split(text, "[,;，；\\s]+"), lambda t: t != ""))


def grid_key(text: Column) -> Column:
    return F.replace(F.replace(F.lower(F.trim(text)), F.lit("×"), F.lit("x")), F.lit(" "), F.lit(""))


def valid_grid(key: Column) -> Column:
    return key.rlike(r"^[0-9]{1,2}x[0-9]{1,2}$")


#: Hints of an item at most, and the forms of a multiplication sign that a grid may be written with.
MOST_HINTS = 16
TIMES = "×Ｘｘ"


def normal_hints(hints: Column) -> Column:
    """Of an array of (grid, name): grids in small letters with x, both trimmed, pairs without either dropped; null is none."""
    grid = lambda h: F.translate(F.lower(F.trim(F.coalesce(h["grid"], F.lit("")))), TIMES, "x" * len(TIMES))
    clean = F.transform(hints, lambda h: F.struct(grid(h).alias("grid"), F.trim(F.coalesce(h["name"], F.lit(""))).alias("name")))
    return F.coalesce(F.filter(clean, lambda h: (h["grid"] != "") | (h["name"] != "")), F.array().cast("array<struct<grid:string,name:string>>"))


def hints_error(hints: Column) -> Column:
    """Why an item's hints are refused, null if they aren't: too many, or the first with a bad grid or no name."""
    wrong = F.transform(normal_hints(hints), lambda h: F.when(~valid_grid(h["grid"]), "grid").when(h["name"] == "", "name"))
    return F.when(F.size(hints) > MOST_HINTS, "too many").otherwise(F.get(F.array_compact(wrong), F.lit(0)))


def hit_label(name: Column, hints: Column, most: int = 0) -> Column:
    """The class alone, or with its hints: `class｜3×2 name / 2×2 name`, cut to `most` characters with an ellipsis (0: not cut)."""
    listed = F.array_join(F.transform(hints, lambda h: F.concat_ws(" ", F.replace(h["grid"], F.lit("x"), F.lit("×")), h["name"])), " / ")
    line = F.concat(F.trim(name), F.lit("｜"), listed)
    cut = shortened(line, most) if most > 1 else F.lit("…") if most == 1 else line
    return F.when(F.size(hints) > 0, cut).otherwise(F.trim(name))


def aliased(name: Column, aliases: dict[str, str], default: str) -> Column:
    """The method that a name in any case stands for."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.lower(F.trim(name))], F.lit(default))


def valid_id(id: Column) -> Column:
    return id.rlike("^[A-Za-z0-9_-]{1,64}$")


def shortened(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.left(text, F.lit(n - 1)), F.lit("…"))).otherwise(text)


def candidate_id(seq: Column, ts: Column) -> Column:
    """The number with six digits at least, and the time."""
    return F.concat_ws("-", F.format_string("%06d", seq.cast("long")), F.date_format(ts, "yyyyMMdd-HHmmss"))


def frame_ms(frame: Column) -> Column:
    """Audio time of a frame's start in milliseconds."""
    return frame * HOP * 1000.0 / RATE


def score_level(meter: Column, window: Column, gate: float = -60.0, over: float = 6.0) -> Column:
    """The level that the gate sees: the window's where it is above the meter's and clearly above the gate."""
    return F.when((window > meter) & (window >= gate + over), window).otherwise(meter)


def denoised_level(level: Column, reduction_db: Column) -> Column:
    return level - F.coalesce(reduction_db, F.lit(0.0))
