"""Queries on samples: the vectors of `embeddings` stand in for recordings of 64 samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import signal as G
from chirplake.functions import vectors as V
from chirplake.operators import denoise as D
from chirplake.operators import scan as S
from chirplake.operators import series as R


def _pcm(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", V.doubles("embedding").alias("v"))


def downmix(spark, sf_dir):
    m = _pcm(spark, sf_dir).select("vec_id", G.downmixed(F.col("v"), 2).alias("m"))
    return m.select("vec_id", F.posexplode("m").alias("pos", "x")).select("vec_id", "pos", F.round("x", 9).alias("x"))


def resample(spark, sf_dir):
    r = _pcm(spark, sf_dir).select("vec_id", F.posexplode(G.resampled(F.col("v"), 44100, 48000)).alias("pos", "x"))
    return r.select("vec_id", "pos", F.round("x", 9).alias("x"))


def frame_energies(spark, sf_dir):
    f = _pcm(spark, sf_dir).select("vec_id", F.posexplode(G.framed(F.col("v"), 16, 8)).alias("frame", "x"))
    return f.select("vec_id", "frame", F.round(G.energy(F.col("x")), 9).alias("energy"))


def frame_spectra(spark, sf_dir):
    f = _pcm(spark, sf_dir).select("vec_id", F.posexplode(G.framed(F.col("v"), 16, 8)).alias("frame", "x")).withColumn("x", G.tapered(F.col("x")))
    p = f.select("vec_id", "frame", F.posexplode(G.power(F.col("x"))).alias("bin", "p"))
    return p.select("vec_id", "frame", "bin", F.round("p", 8).alias("power"))


def tone_scan(spark, sf_dir):
    """The strongest of 31 frequencies of each vector, refined by a parabola over levels in dB."""
    grid = _pcm(spark, sf_dir).select("vec_id", G.tapered(F.col("v")).alias("w"), F.explode(F.sequence(F.lit(1), F.lit(31))).alias("k"))
    db = grid.select("vec_id", F.col("k").cast("double").alias("k"), F.coalesce(X.dbfs(G.amplitude(F.col("w"), F.col("k") / 64.0)), F.lit(-240.0)).alias("db"))
    at = db.withColumn("at", R.refined(F.col("k"), F.col("db"), Window.partitionBy("vec_id").orderBy("k")))
    top = at.groupBy("vec_id").agg(F.max(F.struct(F.round("db", 6).alias("db"), (-F.col("k")).alias("down"), "at")).alias("t"))
    return top.select("vec_id", (-F.col("t.down")).alias("bin"), F.round("t.at", 4).alias("cycles"), F.round("t.db", 4).alias("db"))


def sample_statistics(spark, sf_dir):
    x = _pcm(spark, sf_dir).select("label", F.explode("v").alias("x"))
    s = x.groupBy("label").agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.avg((F.col("x") == 0).cast("double")).alias("zeros"))
    return s.select("label", F.round("peak", 9).alias("peak"), F.round(X.dbfs(F.col("rms")), 6).alias("rms_db"), (F.col("peak") == 0).alias("silent"), "zeros")


def sign_projection(spark, sf_dir):
    p = _pcm(spark, sf_dir).select("vec_id", F.posexplode(G.projected(256)(F.col("v"))).alias("dim", "x"))
    return p.select("vec_id", "dim", F.round("x", 6).alias("x"))


SEED, SEED_STEP = 0xC0FFEE, 97  # fixed values of the variants' seeds


def noise_mix(spark, sf_dir):
    """Three noisy variants of each vector at 12, 6 and 0 dB; every tenth is silent, and stays so."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(db).alias("db")) for k, db in ((1, 12.0), (2, 6.0), (3, 0.0))]))
    silent = F.when(F.col("vec_id") % 10 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    v = _pcm(spark, sf_dir).select("vec_id", silent.alias("v"), each.alias("n"))
    noisy = G.with_noise(F.col("v"), F.col("n.db"), F.lit(SEED) + SEED_STEP * F.col("n.variant"))
    return v.select("vec_id", "n.variant", F.posexplode(noisy).alias("pos", "x")).select("vec_id", "variant", "pos", F.round("x", 8).alias("x"))


def canonical(spark, sf_dir):
    """Every vector as a recording of one, two or three channels, at one of two rates."""
    channels, rate = (F.col("vec_id") % 3 + 1).cast("int"), F.when(F.col("vec_id") % 2 == 0, 44100).otherwise(48000)
    c = _pcm(spark, sf_dir).select("vec_id", F.posexplode(G.canonical(F.col("v"), channels, rate)).alias("pos", "x"))
    return c.select("vec_id", "pos", F.round("x", 9).alias("x"))


def high_pass(spark, sf_dir):
    h = _pcm(spark, sf_dir).select("vec_id", F.posexplode(D.high_passed(48_000.0, 3000.0)(F.col("v"))).alias("pos", "x"))
    return h.select("vec_id", "pos", F.round("x", 9).alias("x"))


def denoise(spark, sf_dir):
    """Fifty vectors make a recording of 350 frames, every seventh vector loud; noise, transients and gains over its spectra."""
    loud = F.transform("v", lambda x: x * F.when(F.col("vec_id") % 7 == 0, 4.0).otherwise(1.0))
    both = F.transform(G.framed(loud, 16, 8), lambda x: F.struct(G.tapered(x).alias("w"), G.energy(F.slice(x, 13, 4)).alias("energy")))
    f = _pcm(spark, sf_dir).select("vec_id", F.posexplode(both).alias("frame", "x")).select("vec_id", "frame", F.round("x.energy", 9).alias("energy"), G.power("x.w").alias("p"))
    frames = f.select(F.expr("vec_id div 50").alias("stream"), F.col("vec_id").alias("t"), F.col("frame").alias("id"), F.col("p").alias("power"), "energy")
    out = D.denoised(frames, D.Settings(hop_s=0.05))
    return out.select("stream", F.col("t").alias("vec_id"), F.col("id").alias("frame"), "scene", "protected", F.round(V.total(F.col("noise")), 6).alias("noise"), F.round(V.total(F.col("clean")), 6).alias("clean"), F.round("cut_db", 6).alias("cut_db"))


def too_short(spark, sf_dir):
    """Recordings of 0 to 63 samples of which 40 are needed."""
    r = _pcm(spark, sf_dir).select("vec_id", F.slice("v", F.lit(1), (F.col("vec_id") % 64).cast("int")).alias("pcm"))
    return D.long_enough(r, 40).where("reject is not null").select("vec_id", "reject")


def _channelled(spark, sf_dir):
    """Every vector as a recording of one, two or three channels at 8 kHz; each fiftieth is silent."""
    silent = F.when(F.col("vec_id") % 50 == 0, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))
    return _pcm(spark, sf_dir).select("vec_id", silent.alias("pcm"), (F.col("vec_id") % 3 + 1).cast("int").alias("channels"))


def channel_levels(spark, sf_dir):
    c = S.channel_levels(_channelled(spark, sf_dir), ["vec_id"])
    return c.select("vec_id", "channel", F.round("peak", 9).alias("peak"), F.round("peak_db", 6).alias("peak_db"), F.round("rms_db", 6).alias("rms_db"), "silent", "zeros")


def tone_verdicts(spark, sf_dir):
    """Slices of every vector, from 0 to 4 ms on, half of them of 3 ms, looked through for one of ten tones."""
    r = _channelled(spark, sf_dir).withColumns({
        "rate": F.lit(8000), "hz": 200.0 + 350 * (F.col("vec_id") % 10), "from_s": F.col("vec_id") % 5 * 0.001, "length_s": F.when(F.col("vec_id") % 2 == 0, 0.003).otherwise(0.0)
    })
    out = S.scan(r, ["vec_id"], step_hz=40.0)
    return out.select("vec_id", "channel", "samples", "nearest", "verdict", *(F.round(c, 4).alias(c) for c in ("dominant", "dominant_db", "tone_db", "share")))


QUERIES = {f.__name__: f for f in (downmix, resample, frame_energies, frame_spectra, tone_scan, sample_statistics, channel_levels, tone_verdicts, sign_projection, noise_mix, canonical, high_pass, denoise, too_short)}

_X = "WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(range(len(v)))::INT AS k, unnest(v) AS x FROM e)"
_F = _X + ", f AS (SELECT vec_id, frame::INT AS frame, (k - frame * 8)::INT AS k, x FROM x, range(7) t(frame) WHERE k >= frame * 8 AND k < frame * 8 + 16)"
_C = _X + """, y AS (SELECT vec_id, k, (k % (vec_id % 3 + 1))::INT AS channel, k // (vec_id % 3 + 1) AS j, CASE WHEN vec_id % 50 = 0 THEN 0 ELSE x END AS x FROM x),
l AS (SELECT vec_id, channel, max(abs(x)) AS peak, sqrt(avg(x * x)) AS rms, avg(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zeros, count(*) AS n FROM y GROUP BY vec_id, channel)"""

ORACLES = {
    "channel_levels": _C + " SELECT vec_id, channel, round(peak, 9) AS peak, CASE WHEN peak > 0 THEN round(20 * log10(peak), 6) END AS peak_db, CASE WHEN peak > 0 THEN round(20 * log10(rms), 6) END AS rms_db, peak = 0 AS silent, zeros FROM l",
    "tone_verdicts": _C + f""", b AS (SELECT vec_id, channel, n, peak FROM l QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY rms DESC, channel) = 1),
r AS (SELECT *, least(floor(vec_id % 5 * 0.001::DOUBLE * 8000)::INT, n) AS a, 200.0::DOUBLE + 350 * (vec_id % 10) AS hz FROM b),
s AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN least(a + 24, n) ELSE n END - a AS samples FROM r),
w AS (SELECT vec_id, hz, samples, j - a AS i, x * (0.5 - 0.5 * cos(2 * pi() * (j - a) / samples)) AS x FROM s JOIN y USING (vec_id, channel) WHERE peak > 0 AND samples >= {S.LEAST} AND j >= a AND j < a + samples),
g AS (SELECT k, {S.LOW_HZ}::DOUBLE + 40 * k AS f FROM range(98) t(k)),
q AS (SELECT vec_id, k, f, i, x, samples FROM w, g UNION ALL SELECT vec_id, -1, hz, i, x, samples FROM w),
d AS (SELECT vec_id, k, f, 20 * log10(2 * sqrt(pow(sum(x * cos(2 * pi() * f / 8000 * i)), 2) + pow(sum(x * sin(2 * pi() * f / 8000 * i)), 2)) / (any_value(samples) / 2)) AS db FROM q GROUP BY vec_id, k, f),
h AS (SELECT *, lag(db) OVER o AS y1, lead(db) OVER o AS y3 FROM d WHERE k >= 0 WINDOW o AS (PARTITION BY vec_id ORDER BY k)),
m AS (SELECT vec_id, f, db, CASE WHEN y1 - 2 * db + y3 <> 0 THEN 0.5::DOUBLE * (y1 - y3) / (y1 - 2 * db + y3) END AS delta FROM h QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(db, 6) DESC, k) = 1),
e2 AS (SELECT vec_id, sum(x * x) AS e FROM w GROUP BY vec_id),
v AS (SELECT s.vec_id, channel, samples, hz, peak, m.f + CASE WHEN abs(delta) <= 1 THEN delta * 40 ELSE 0 END AS dominant, m.db AS dominant_db, d.db AS tone_db, CASE WHEN e > 0 THEN least(1.0::DOUBLE, pow(10.0::DOUBLE, d.db / 10) / 2 * (3 * samples / 8.0::DOUBLE) / e) END AS share
  FROM s LEFT JOIN m USING (vec_id) LEFT JOIN d ON d.vec_id = s.vec_id AND d.k = -1 LEFT JOIN e2 ON e2.vec_id = s.vec_id)
SELECT vec_id, CASE WHEN peak > 0 THEN channel END AS channel, CASE WHEN peak > 0 THEN samples END::INT AS samples, abs(dominant - hz) <= 40 AS nearest,
  CASE WHEN peak = 0 THEN 'silent' WHEN samples < {S.LEAST} THEN 'too short' WHEN tone_db > {S.FLOOR_DB} AND tone_db - dominant_db > {S.UNDER_DB} THEN 'found' ELSE 'not found' END AS verdict,
  round(dominant, 4) AS dominant, round(dominant_db, 4) AS dominant_db, round(tone_db, 4) AS tone_db, round(share, 4) AS share FROM v""",
    "downmix": _X + " SELECT vec_id, k // 2 AS pos, round(sum(x) / 2, 9) AS x FROM x GROUP BY vec_id, k // 2",
    "resample": _X + """, o AS (SELECT i::INT AS pos, i * (44100 / 48000.0::DOUBLE) AS p FROM range(70) t(i))
SELECT vec_id, pos, round(CASE WHEN floor(p) >= 63 THEN v[64] ELSE v[floor(p)::INT + 1] + (p - floor(p)) * (v[floor(p)::INT + 2] - v[floor(p)::INT + 1]) END, 9) AS x FROM e, o""",
    "frame_energies": _F + " SELECT vec_id, frame, round(avg(x * x), 9) AS energy FROM f GROUP BY vec_id, frame",
    "frame_spectra": _F + """, m AS (SELECT vec_id, frame, k, (x - avg(x) OVER (PARTITION BY vec_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS x FROM f)
SELECT vec_id, frame, bin::INT AS bin, round((pow(sum(x * cos(2 * pi() * bin * k / 16)), 2) + pow(sum(x * sin(2 * pi() * bin * k / 16)), 2)) * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END, 8) AS power FROM m, range(9) b(bin) GROUP BY vec_id, frame, bin""",
    "tone_scan": _X + """, m AS (SELECT vec_id, k, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * k / 64)) AS x FROM x),
a AS (SELECT vec_id, b::DOUBLE AS b, 20 * log10(2 * sqrt(pow(sum(x * cos(2 * pi() * b * k / 64)), 2) + pow(sum(x * sin(2 * pi() * b * k / 64)), 2)) / 32) AS db FROM m, range(1, 32) t(b) GROUP BY vec_id, b),
l AS (SELECT *, lag(db) OVER o AS y1, lead(db) OVER o AS y3, lag(b) OVER o AS f1, lead(b) OVER o AS f3 FROM a WINDOW o AS (PARTITION BY vec_id ORDER BY b)),
d AS (SELECT *, CASE WHEN y1 - 2 * db + y3 <> 0 THEN 0.5::DOUBLE * (y1 - y3) / (y1 - 2 * db + y3) END AS delta FROM l)
SELECT vec_id, b AS bin, round(CASE WHEN abs(delta) <= 1 THEN b + delta * (f3 - f1) / 2 ELSE b END, 4) AS cycles, round(round(db, 6), 4) AS db FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(db, 6) DESC, b) = 1""",
    "sample_statistics": _X + " SELECT label, round(max(abs(x)), 9) AS peak, CASE WHEN max(abs(x)) > 0 THEN round(20 * log10(sqrt(avg(x * x))), 6) END AS rms_db, max(abs(x)) = 0 AS silent, avg(CASE WHEN x = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zeros FROM x GROUP BY label",
    "sign_projection": _X + """, h AS (SELECT k, d, xor(xor((k::BIGINT * 2654435769) & 4294967295, (d::BIGINT * 2246822507) & 4294967295), 2779096485) AS y FROM range(64) a(k), range(256) b(d)),
i AS (SELECT k, d, (xor(y, y >> 16) * 2146121005) & 4294967295 AS y FROM h),
s AS (SELECT k, d, CASE WHEN bit_count(xor(y, y >> 15)) & 1 = 1 THEN 1.0::DOUBLE ELSE -1 END AS s FROM i),
p AS (SELECT vec_id, d, sum(x * s) AS y FROM x JOIN s USING (k) GROUP BY vec_id, d)
SELECT vec_id, d::INT AS dim, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 6) AS x FROM p""",
    "noise_mix": _X + """, g AS (SELECT n::INT AS variant, 0 AS k, ((12648430 + 97 * n) * 1664525 + 1013904223) & 4294967295 AS s FROM range(1, 4) t(n) UNION ALL SELECT variant, k + 1, (s * 1664525 + 1013904223) & 4294967295 FROM g WHERE k < 63),
y AS (SELECT vec_id, k, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE x END AS x FROM x), q AS (SELECT vec_id, avg(x * x) AS p FROM y GROUP BY vec_id)
SELECT vec_id, variant, k AS pos, round(x + ((s >> 8) / 16777216.0::DOUBLE * 2 - 1) * sqrt(3 * p / pow(10.0::DOUBLE, [12, 6, 0][variant] / 10.0::DOUBLE)), 8) AS x FROM y JOIN g USING (k) JOIN q USING (vec_id)""",
    "canonical": _X + """, m AS (SELECT vec_id, k // (vec_id % 3 + 1) AS j, avg(x) AS x FROM x WHERE k // (vec_id % 3 + 1) < 64 // (vec_id % 3 + 1) GROUP BY ALL),
l AS (SELECT vec_id, list(x ORDER BY j) AS v, count(*) AS n, CASE WHEN vec_id % 2 = 0 THEN 44100 ELSE 48000 END AS rate FROM m GROUP BY vec_id),
o AS (SELECT vec_id, v, n, unnest(range(round(n * (48000 / rate::DOUBLE))::BIGINT)) AS i, rate / 48000.0::DOUBLE AS step FROM l),
p AS (SELECT *, i * step AS p FROM o)
SELECT vec_id, i::INT AS pos, round(CASE WHEN floor(p) >= n - 1 THEN v[n] ELSE v[floor(p)::INT + 1] + (p - floor(p)) * (v[floor(p)::INT + 2] - v[floor(p)::INT + 1]) END, 9) AS x FROM p""",
    "high_pass": _X + """, w AS (SELECT 2 * pi() * 3000 / 48000 AS w), q AS (SELECT cos(w) AS c, sin(w) / (2 * sqrt(2::DOUBLE)) AS a FROM w),
c AS (SELECT (1 + c) / 2 / (1 + a) AS b0, -(1 + c) / (1 + a) AS b1, -2 * c / (1 + a) AS a1, (1 - a) / (1 + a) AS a2 FROM q),
g AS (SELECT vec_id, -1 AS k, 0::DOUBLE AS x1, 0::DOUBLE AS x2, 0::DOUBLE AS y1, 0::DOUBLE AS y2 FROM e UNION ALL
SELECT g.vec_id, g.k + 1, x.x, g.x1, b0 * x.x + b1 * g.x1 + b0 * g.x2 - a1 * g.y1 - a2 * g.y2, g.y1 FROM g JOIN x ON x.vec_id = g.vec_id AND x.k = g.k + 1, c)
SELECT vec_id, k::INT AS pos, round(y1, 9) AS x FROM g WHERE k >= 0""",
    "denoise": _F + """, s AS (SELECT vec_id, frame, k, x * CASE WHEN vec_id % 7 = 0 THEN 4.0::DOUBLE ELSE 1 END AS x FROM f),
m AS (SELECT vec_id, frame, k, (x - avg(x) OVER (PARTITION BY vec_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * k / 16)) AS x FROM s),
b AS (SELECT vec_id, frame, bin, (pow(sum(x * cos(2 * pi() * bin * k / 16)), 2) + pow(sum(x * sin(2 * pi() * bin * k / 16)), 2)) * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END AS p FROM m, range(9) b(bin) GROUP BY vec_id, frame, bin),
p AS (SELECT vec_id, frame, list(p ORDER BY bin) AS p FROM b GROUP BY ALL), n AS (SELECT vec_id, frame, round(avg(x * x), 9) AS e FROM s WHERE k >= 12 GROUP BY ALL),
r AS (SELECT vec_id // 50 AS stream, vec_id, frame, p, e, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id, frame) AS k FROM p JOIN n USING (vec_id, frame)),
z AS (SELECT list_transform(range(9), lambda i: 0::DOUBLE) AS z),
g AS (SELECT stream, 0::BIGINT AS k, z AS track, z AS noise, 0 AS seen, 0 AS rising, FALSE AS scene, NULL::DOUBLE AS floor, 0 AS loud, FALSE AS short, z AS gain, z AS clean FROM (SELECT DISTINCT stream FROM r), z
UNION ALL SELECT stream, k, track, noise, seen, rising, scene, floor, loud, short, gain, CASE WHEN act THEN list_transform(p, lambda x, i: x * gain[i]) ELSE p END
FROM (SELECT *, CASE WHEN act THEN list_transform(p, lambda x, i: CASE WHEN x <= 0 THEN old[i] WHEN greatest(x / (x + 1.5 * noise[i]), pow(10::DOUBLE, -0.4::DOUBLE)) > old[i] THEN greatest(x / (x + 1.5 * noise[i]), pow(10::DOUBLE, -0.4::DOUBLE))
    ELSE 0.75::DOUBLE * old[i] + 0.25::DOUBLE * greatest(x / (x + 1.5 * noise[i]), pow(10::DOUBLE, -0.4::DOUBLE)) END) ELSE old END AS gain
  FROM (SELECT *, seen = 5 AND list_sum(noise) > 0 AND NOT short AS act
    FROM (SELECT stream, k, p, track, old, seen, rising, scene, loud, loud BETWEEN 1 AND 6 AS short,
        CASE WHEN floor IS NULL THEN e WHEN loud BETWEEN 1 AND 6 THEN floor WHEN loud > 6 THEN 0.85::DOUBLE * floor + 0.15::DOUBLE * e ELSE 0.92::DOUBLE * floor + 0.08::DOUBLE * e END AS floor,
        CASE WHEN was < 5 THEN list_transform(p, lambda x, i: (noise[i] + x) / CASE WHEN was = 4 THEN 5 ELSE 1 END) WHEN scene THEN list_transform(noise, lambda x, i: 0.75::DOUBLE * x + 0.25::DOUBLE * track[i])
          ELSE list_transform(noise, lambda x, i: CASE WHEN track[i] > 3.5::DOUBLE * x THEN x ELSE 0.97::DOUBLE * x + 0.03::DOUBLE * track[i] END) END AS noise
      FROM (SELECT *, rising >= 4 AS scene
        FROM (SELECT *, least(was + 1, 5) AS seen, CASE WHEN was = 5 AND len(list_filter(range(1, 10), lambda i: track[i] > 4.0::DOUBLE * noise[i])) > 3 THEN up + 1 ELSE 0 END AS rising,
            CASE WHEN floor > 0 AND e > 2 * floor THEN run + 1 ELSE 0 END AS loud
          FROM (SELECT r.stream, r.k, r.p, r.e, g.noise, g.seen AS was, g.rising AS up, g.floor, g.loud AS run, g.gain AS old, list_transform(r.p, lambda x, i: 0.45::DOUBLE * g.track[i] + 0.55::DOUBLE * x) AS track
            FROM g JOIN r ON r.stream = g.stream AND r.k = g.k + 1))))))),
o AS (SELECT r.*, g.scene, g.short, CASE WHEN g.seen = 5 THEN list_sum(g.noise) ELSE 0 END AS noise, list_sum(g.clean) AS clean, list_sum(r.p) AS before, g.seen = 5 AND NOT g.short AS act FROM r JOIN g USING (stream, k))
SELECT stream, vec_id, frame, scene, short AS protected, round(noise, 6) AS noise, round(clean, 6) AS clean, round(CASE WHEN act AND clean > 0 AND clean < before THEN 10 * log10(before / clean) ELSE 0 END, 6) AS cut_db FROM o""",
    "too_short": "SELECT vec_id, 'too short: ' || (vec_id % 64) || ' samples, 40 at least' AS reject FROM embeddings WHERE vec_id % 64 < 40",
}
