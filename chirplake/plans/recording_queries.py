"""Queries on recordings that Spark makes of `embeddings`: each vector a WAV file, or 600 vectors in a row one recording of 0.8 s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chirplake.functions import vectors as V
from chirplake.sources import recordings as S

ROWS = 600


def _little(n: Column | int, width: int) -> Column:
    """Hex digits of a whole number's bytes, the lowest first."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("long")
    return F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)])


def _text(name: str) -> Column:
    return F.lit(name.encode().hex())


def _files(spark, sf_dir):
    """Files of 8, 16, 24 or 32 bits, one to three channels and two rates; every fifth has an extended header, every fourth a chunk of odd length before its
    format; every ninth begins otherwise and every eleventh lacks its last byte."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", V.doubles("embedding").alias("v"))
    bits, channels = (F.col("vec_id") % 4 * 8 + 8).cast("int"), F.col("vec_id") % 3 + 1
    rate = F.when(F.col("vec_id") % 2 == 0, 44100).otherwise(48000)

    def code(x: Column) -> Column:
        half = F.pow(F.lit(2.0), bits - 1)
        whole = F.least(half - 1, F.greatest(-half, F.floor(x * half))).cast("long")
        digits = _little(F.when(bits == 8, whole + 128).otherwise(whole), 4)
        return F.substring(digits, F.lit(1), (bits / 4).cast("int"))

    plain = F.concat(_little(channels, 2), _little(rate, 4), _little(0, 6), _little(bits, 2))
    form = F.when(F.col("vec_id") % 5 == 0, F.concat(_text("fmt "), _little(40, 4), _little(0xFFFE, 2), plain, _little(0, 8), _little(1, 2), _little(0, 14)))
    form = form.otherwise(F.concat(_text("fmt "), _little(16, 4), _little(1, 2), plain))
    junk = F.when(F.col("vec_id") % 4 == 0, F.concat(_text("junk"), _little(3, 4), _little(0, 4))).otherwise("")
    data = F.concat(_text("data"), _little(F.size("v") * bits / 8, 4), F.array_join(F.transform("v", code), ""))
    magic = F.when(F.col("vec_id") % 9 == 0, _text("RIFX")).otherwise(_text("RIFF"))
    e = e.withColumn("body", F.concat(_text("WAVE"), junk, form, data))
    e = e.withColumn("whole", F.unhex(F.concat(magic, _little(F.length("body") / 2, 4), "body")))
    cut = F.when(F.col("vec_id") % 11 == 0, F.substring("whole", F.lit(1), F.octet_length("whole") - 1)).otherwise(F.col("whole"))
    return e.select("vec_id", F.format_string("%d.wav", "vec_id").alias("path"), cut.alias("content"))


def wav_scan(spark, sf_dir):
    """Samples and origin of every file, or why it can't be read."""
    d = S.decoded(S.sniffed(_files(spark, sf_dir))).select("vec_id", "reject", "origin.*", F.posexplode_outer("pcm").alias("pos", "x"))
    rest = [F.col(c).cast("long").alias(c) for c in ("tag", "channels", "rate", "bits", "frames")]
    return d.select("vec_id", "reject", *rest, "resampled", "downmixed", F.round("peak_db", 6).alias("peak_db"), "pos", F.col("x").cast("float").cast("double").alias("x"))


def _recordings(spark, sf_dir):
    """Recordings of 600 vectors; a part of 40 vectors is louder, four or 2.4 times, in two of three, and each seventh recording is silent."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.expr(f"vec_id div {ROWS}").alias("path"), V.doubles("embedding").alias("v"))
    loud = F.when(F.col("path") % 7 == 6, 0.0).when(~(F.col("vec_id") % ROWS).between(300, 339), 1.0).when(F.col("path") % 3 == 0, 4.0).when(F.col("path") % 3 == 1, 2.4).otherwise(1.0)
    scaled = e.withColumn("v", F.transform("v", lambda x: x * loud))
    return scaled.groupBy("path").agg(F.flatten(F.array_sort(F.collect_list(F.struct("vec_id", "v")))["v"]).alias("pcm")).withColumn("reject", F.lit(None).cast("string"))


def recording_templates(spark, sf_dir):
    """The last frame of each recording's template, or why it gives none."""
    t = S.anchor_templates(_recordings(spark, sf_dir))
    return t.select("path", "frame", "reject", (F.abs(V.dot(F.col("v"), F.col("v")) - 1) < 1e-9).alias("unit"))


def recording_windows(spark, sf_dir):
    w = S.recording_windows(_recordings(spark, sf_dir))
    return w.select("path", "frame", F.round(F.array_max("v"), 6).alias("most"), F.round(V.dot(F.col("v"), F.col("v")), 6).alias("power"))


QUERIES = {f.__name__: f for f in (wav_scan, recording_templates, recording_windows)}

ORACLES = {
    "wav_scan": """WITH f AS (SELECT vec_id, (vec_id % 4 * 8 + 8)::BIGINT AS bits, (vec_id % 3 + 1)::BIGINT AS channels, CASE WHEN vec_id % 2 = 0 THEN 44100 ELSE 48000 END::BIGINT AS rate,
  CASE WHEN vec_id % 9 = 0 THEN 'no RIFF/WAVE file' WHEN vec_id % 11 = 0 THEN 'chunk ''data'' ends behind the file' END AS reject, embedding FROM embeddings),
x AS (SELECT vec_id, bits, channels, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x, len(embedding) AS n FROM f WHERE reject IS NULL),
q AS (SELECT vec_id, channels, k, n, greatest(-1, least(1 - 1 / pow(2.0::DOUBLE, bits - 1), floor(x * pow(2.0::DOUBLE, bits - 1)) / pow(2.0::DOUBLE, bits - 1))) AS x FROM x),
m AS (SELECT vec_id, k // channels AS j, avg(x) AS x FROM q WHERE k // channels < n // channels GROUP BY ALL),
l AS (SELECT vec_id, list(x ORDER BY j) AS v, count(*) AS n FROM m GROUP BY vec_id),
o AS (SELECT vec_id, v, n, unnest(range(round(n * (48000 / rate::DOUBLE))::BIGINT)) AS i, rate / 48000.0::DOUBLE AS step FROM l JOIN f USING (vec_id)),
p AS (SELECT *, i * step AS p FROM o),
r AS (SELECT vec_id, i::INT AS pos, CASE WHEN floor(p) >= n - 1 THEN v[n] ELSE v[floor(p)::INT + 1] + (p - floor(p)) * (v[floor(p)::INT + 2] - v[floor(p)::INT + 1]) END AS x FROM p),
d AS (SELECT vec_id, max(abs(CASE WHEN x >= 1 THEN 32767 WHEN x <= -1 THEN -32768 ELSE round(x * 32767) END)) AS peak FROM r GROUP BY vec_id)
SELECT vec_id, reject, CASE WHEN reject IS NULL THEN CASE WHEN vec_id % 5 = 0 THEN 65534 ELSE 1 END END::BIGINT AS tag, CASE WHEN reject IS NULL THEN channels END AS channels,
  CASE WHEN reject IS NULL THEN rate END AS rate, CASE WHEN reject IS NULL THEN bits END AS bits, CASE WHEN reject IS NULL THEN len(embedding) // channels END AS frames,
  CASE WHEN reject IS NULL THEN rate <> 48000 END AS resampled, CASE WHEN reject IS NULL THEN channels > 1 END AS downmixed,
  CASE WHEN peak > 0 THEN round(20 * log10(peak / 32768.0::DOUBLE), 6) END AS peak_db, pos, x::FLOAT::DOUBLE AS x
FROM f LEFT JOIN r USING (vec_id) LEFT JOIN d USING (vec_id)""",
    "recording_templates": f"""WITH v AS (SELECT vec_id // {ROWS} AS path, row_number() OVER (PARTITION BY vec_id // {ROWS} ORDER BY vec_id) - 1 AS k, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))
    * pow(CASE WHEN vec_id // {ROWS} % 7 = 6 THEN 0.0::DOUBLE WHEN vec_id % {ROWS} NOT BETWEEN 300 AND 339 THEN 1 WHEN vec_id // {ROWS} % 3 = 0 THEN 4 WHEN vec_id // {ROWS} % 3 = 1 THEN 2.4::DOUBLE ELSE 1 END, 2) AS e FROM embeddings),
n AS (SELECT path, count(*) * 64 AS samples FROM v GROUP BY path),
w AS (SELECT path, k, sum(e) OVER (PARTITION BY path ORDER BY k ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) / 1024 AS e FROM v),
f AS (SELECT path, k // 4 AS frame, e, (samples - 1024) // 256 + 1 AS frames, samples FROM w JOIN n USING (path) WHERE k % 4 = 0 AND k * 16 // 64 <= (samples - 1024) // 256 AND samples >= 8960),
s AS (SELECT *, avg(e) OVER (PARTITION BY path ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM f),
a AS (SELECT path, frame AS top, e AS peak, frames, samples FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY round(smooth, 12) DESC, frame) = 1),
b AS (SELECT path, top, frames, samples, peak, avg(CASE WHEN abs(frame - top) > 3 THEN e END) AS bed FROM f JOIN (SELECT path, top, peak FROM a) USING (path) GROUP BY ALL),
r AS (SELECT path, greatest(0, least(top - 15, frames - 32)) + 31 AS frame, CASE WHEN samples < 8960 THEN 'too short: ' || samples || ' samples, 8960 at least' WHEN path % 7 = 6 THEN 'silent'
    WHEN samples / 48000.0::DOUBLE > 0.75 AND bed <= 0.25 * peak AND 10 * log10(peak / bed) < 9 THEN 'weak' END AS reject FROM n LEFT JOIN b USING (path, samples))
SELECT path, CASE WHEN reject IS NULL THEN frame END::BIGINT AS frame, reject, CASE WHEN reject IS NULL THEN TRUE END AS "unit" FROM r""",
}
