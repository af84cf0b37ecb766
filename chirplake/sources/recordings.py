"""Recordings as Spark tables: scan, rejects, log-mel frames, templates and windows.

A file is decoded in one row, as its format asks for; its samples are then cut into spans, so that
frames are made and transformed in tasks of their own however long a recording is. Only the noise
pass sees a recording's frames in order (`operators/denoise.py`), a batch at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import signal as G
from chirplake.functions import vectors as V
from chirplake.functions import wav
from chirplake.operators import denoise as D
from chirplake.operators import series as R

#: Frames of a patch; frames cut from one span of samples; samples at a frame's end that tell transients (10 ms).
PATCH, SPAN, RECENT = 32, 256, 480


def sniffed(files: DataFrame) -> DataFrame:
    """format by the first bytes, then by the name's ending, `unknown` without one."""
    head = lambda at, n: F.substring(F.col("content"), at, n)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(ending == "wave", "wav").otherwise(F.coalesce(F.nullif(ending, F.lit("")), F.lit("unknown")))
    magic = F.when((head(1, 4) == F.lit(b"RIFF")) & (head(9, 4) == F.lit(b"WAVE")), "wav").when(head(1, 3) == F.lit(b"ID3"), "mp3")
    return files.withColumn("format", F.coalesce(magic, by_name))


def as_int16(x: Column) -> Column:
    """A sample's 16-bit code: halves away from zero, what is beyond the range kept at its ends."""
    return F.when(x >= 1, 32767).when(x <= -1, -32768).otherwise(F.round(x * 32767)).cast("int")


def decoded(files: DataFrame) -> DataFrame:
    """files: (content, format, ...). Their columns but content, with pcm (48 kHz, one channel), origin and reject. A file that can't be read has `reject` set
    and neither samples nor origin; the others of the batch go on. origin: format as stored, frames and seconds at the stored rate, bytes, what was changed, and the peak in dB of
    the 16-bit form (null for silence)."""
    rest = [c for c in files.columns if c != "content"]
    raw = files.withColumn("_w", F.when(F.col("format") == "wav", wav.decoded(F.col("content")))).withColumn("_bytes", F.octet_length("content"))
    w = F.col("_w")
    df = raw.select(*rest, "_w", "_bytes", F.when(w["pcm"].isNotNull(), G.canonical(w["pcm"], w["channels"], w["rate"])).alias("pcm"))
    frames = F.floor(F.size(w["pcm"]) / w["channels"])
    peak = F.array_max(F.transform("pcm", lambda x: F.abs(as_int16(x))))
    origin = F.struct(
        w["tag"].alias("tag"), w["channels"].alias("channels"), w["rate"].alias("rate"), w["bits"].alias("bits"), frames.alias("frames"), (frames / w["rate"]).alias("seconds"),
        F.col("_bytes").alias("bytes"), (w["rate"] != G.RATE).alias("resampled"), (w["channels"] > 1).alias("downmixed"), X.dbfs(peak / 32768.0).alias("peak_db"),
    )
    reject = F.when(F.col("format") != "wav", F.concat(F.lit("format "), "format")).otherwise(w["reject"])
    return df.select(*rest, "pcm", F.when(F.col("pcm").isNotNull(), origin).alias("origin"), reject.alias("reject"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, pcm, origin, reject) of every file under path."""
    return decoded(sniffed(spark.read.format("binaryFile").load(path)).select("path", "format", "content"))


def features(recordings: DataFrame, settings: D.Settings | None = D.Settings(), cutoff: float = 120.0) -> DataFrame:
    """recordings: (path, pcm). (path, frame, mel, energy) of each frame: levels of the mel bands behind the high-pass and the noise pass, and the mean square
    of the samples as they are. Without settings nothing is cleaned. Recordings of under a frame, empty and null ones give none."""
    clean = D.high_passed(float(G.RATE), cutoff)(F.col("pcm")) if settings else F.col("pcm")
    r = recordings.select("path", "pcm").where(F.size("pcm") >= G.FRAME).select("path", "pcm", clean.alias("clean"))
    last = F.floor((F.size("pcm") - G.FRAME) / (G.HOP * SPAN)).cast("int")
    part = lambda name, k: F.slice(name, k * (G.HOP * SPAN) + 1, F.lit(G.HOP * (SPAN - 1) + G.FRAME))
    spans = r.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(part("pcm", k).alias("raw"), part("clean", k).alias("clean")))).alias("span", "s"))

    def frame(raw: Column, k: Column) -> Column:
        recent = F.slice(raw, G.FRAME - RECENT + 1, F.lit(RECENT))
        return F.struct(G.energy(raw).alias("energy"), G.energy(recent).alias("recent"), F.slice("s.clean", k * G.HOP + 1, F.lit(G.FRAME)).alias("clean"))

    cut = spans.repartition("path", "span").select("path", "span", F.posexplode(F.transform(G.framed(F.col("s.raw"), G.FRAME, G.HOP), frame)).alias("k", "f"))
    numbered = cut.select("path", (F.col("span").cast("long") * SPAN + F.col("k")).alias("frame"), "f.energy", "f.recent", G.spectra("f.clean").alias("p"))
    if not settings:
        return numbered.select("path", "frame", G.log_mel("p.power").alias("mel"), "energy")
    ready = numbered.select(F.col("path").alias("stream"), F.col("frame").alias("t"), F.lit(0).alias("id"), F.col("energy").alias("whole"), F.col("recent").alias("energy"), "p.power", "p.tracked")
    return D.denoised(ready, settings).select(F.col("stream").alias("path"), F.col("t").alias("frame"), G.log_mel("clean").alias("mel"), F.col("whole").alias("energy"))


def anchor_templates(recordings: DataFrame, settings: D.Settings | None = D.Settings()) -> DataFrame:
    """(path, v, frame, reject) of each recording: the unit patch around its anchor, the top of the smoothed energies (the first of those equal to 12 places), and the frame that it ends on;
    or why there is none: what `reject` says already, `too short: ...`, `silent` where nothing is left of the patch, `weak` where a long recording's anchor stands out too little."""
    checked = recordings.select("path", "pcm", F.col("reject").alias("_was")).transform(D.long_enough).withColumn("reject", F.coalesce("_was", "reject"))
    f = features(checked.where("reject is null"), settings).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("frame", "energy", "mel"))).alias("f"))
    f = f.withColumn("sm", F.transform(G.smoothed(F.col("f.energy"), 7), lambda x: F.round(x, 12))).withColumn("at", (F.array_position("sm", F.array_max("sm")) - 1).cast("int"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - (PATCH - 1) // 2, F.size("f") - PATCH))
    bed = F.filter(F.col("f"), lambda x: F.abs(x["frame"] - F.col("at")) > 3)["energy"]
    f = f.select("path", start.alias("start"), F.size("f").alias("frames"), F.get("f.energy", F.col("at")).alias("peak"), V.mean(bed).alias("bed"), "f")
    found = f.select("path", "frames", "peak", "bed", (F.col("start") + PATCH - 1).cast("long").alias("frame"), V.patch_normalise(F.flatten(F.slice("f.mel", F.col("start") + 1, F.lit(PATCH)))).alias("v"))
    out = checked.select("path", (F.size("pcm") / G.RATE).alias("seconds"), "reject").join(found, "path", "left")
    weak = R.weak((F.col("seconds") > 0.75) & (F.col("frames") >= 8), F.col("peak"), F.col("bed"))
    why = F.when(F.col("v").isNull(), "no samples").when(~F.exists("v", lambda x: x != 0), "silent").when(weak, "weak")
    out = out.withColumn("reject", F.coalesce("reject", why))
    kept = lambda c: F.when(F.col("reject").isNull(), F.col(c)).alias(c)
    return out.select("path", kept("v"), kept("frame"), "reject")


def recording_windows(recordings: DataFrame, settings: D.Settings | None = D.Settings()) -> DataFrame:
    """(path, frame, v): the unit patch that ends at each frame from the 32nd on."""
    upto = Window.partitionBy("path").orderBy("frame").rowsBetween(1 - PATCH, 0)
    f = features(recordings.where("reject is null"), settings).select("path", "frame", F.collect_list("mel").over(upto).alias("mel")).where(F.size("mel") == PATCH)
    return f.select("path", "frame", V.patch_normalise(F.flatten("mel")).alias("v"))
