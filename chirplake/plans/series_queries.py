"""Series queries on `events`: users are streams, event types are items, values are levels or scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.operators import series as R
from chirplake.operators.detector import Rules, detect, outcomes, with_changes


def _events(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("t"), F.col("user_id").alias("stream"), F.col("event_type").alias("item"), "value")


def _frames(spark, sf_dir):
    return R.numbered(_events(spark, sf_dir))


def moving_average(spark, sf_dir):
    return R.moving_average(_frames(spark, sf_dir)).select("stream", "frame", F.round("smooth", 6).alias("smooth"))


def anchor(spark, sf_dir):
    return R.anchors(R.moving_average(_frames(spark, sf_dir))).select("stream", "anchor", F.round("smooth", 6).alias("smooth"), "frames")


def anchor_patch(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    found = R.anchor_patches(frames, R.anchors(R.moving_average(frames)))
    return found.groupBy("stream").agg(F.min("start").alias("start"), F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def sliding_patch(spark, sf_dir):
    p = R.sliding_patches(_frames(spark, sf_dir))
    return p.select("stream", "frame", F.round(F.aggregate("patch", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("patch", 1), 6).alias("oldest"))


def window_peak(spark, sf_dir):
    return R.window_peak(_frames(spark, sf_dir)).select("stream", "frame", F.round("peak", 6).alias("peak"), F.round(X.log_energy(F.col("peak") * F.col("peak")), 4).alias("level_db"))


def weak_anchor(spark, sf_dir):
    """Frames of 10 ms, so that some streams are too short to be weak."""
    return R.weak_anchors(_frames(spark, sf_dir), F.col("frames") / 100.0).select("stream", "at", "frames", F.round("peak", 6).alias("peak"), F.round("bed", 10).alias("bed"), "weak")


def onset(spark, sf_dir):
    """Energies over many decades, so that quiet beds, rises, sustained sounds and loud frames all occur."""
    e = F.pow(F.lit(10.0), F.col("value") / 8 - 14)
    p = R.sliding_patches(_frames(spark, sf_dir).withColumn("value", e), 12)
    return p.groupBy("stream").agg(F.count("*").alias("windows"), F.count_if(R.onset(F.col("patch"), 12.0)).alias("onsets"))


def stream_totals(spark, sf_dir):
    t = R.stream_totals(_events(spark, sf_dir), 20.0)
    return t.select("stream", "blocks", "silent", F.round("max_level", 6).alias("max_level"), F.round("avg_level", 6).alias("avg_level"))


def trailing_clip(spark, sf_dir):
    return R.trailing(_events(spark, sf_dir), 86_400).select("id", "n", F.round("total", 6).alias("total"))


def capture_clip(spark, sf_dir):
    """Every fifth event captures its user's last six hours."""
    e = _events(spark, sf_dir)
    return R.clips(e.where("id % 5 = 0").select(F.col("id").alias("clip"), "stream", "t"), e, 6 * 3600).select("clip", "id", F.round("value", 6).alias("value"))


def last_50(spark, sf_dir):
    return R.newest(_events(spark, sf_dir), ["stream"], 50).select("stream", "id", "rk")


def latest_guess(spark, sf_dir):
    """Windows of a value under 20 have no result."""
    e = _events(spark, sf_dir).withColumn("item", F.when(F.col("value") >= 20, F.col("item")))
    return R.latest_guess(e).select("stream", "item", F.unix_micros("t").alias("us"))


def tick_ranking(spark, sf_dir):
    """A tick at least every 12 hours, with the item of the last window of a value of 20 or more."""
    e = _events(spark, sf_dir).withColumn("item", F.when(F.col("value") >= 20, F.col("item")))
    return R.ticks(e, pd.Timedelta(hours=12)).select("id", "stream", "top")


def shown_sets(spark, sf_dir):
    return R.shown_sets(_events(spark, sf_dir), pd.Timedelta(hours=18), 2).select("id", "shown", "evicted")


def level_window(spark, sf_dir):
    return R.level_db(_events(spark, sf_dir), 10).select("id", F.round("level_db", 6).alias("level_db"))


def mel_scale(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("id", F.round(X.mel(F.col("value") * 40), 6).alias("mel"), F.round(X.hz(X.mel(F.col("value") * 40)), 4).alias("hz"))


def audio_time(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return f.groupBy("stream").agg(F.round(X.frame_ms(F.max("frame")), 6).alias("last_ms"))


def levels_dbfs(spark, sf_dir):
    return _events(spark, sf_dir).select("id", F.round(X.dbfs(F.col("value") / 100), 4).alias("dbfs"), X.to_int16(F.col("value") / 100).alias("code"))


def cooldown(spark, sf_dir):
    kept = R.cooldown(_events(spark, sf_dir), ["stream", "item"], pd.Timedelta(hours=6))
    return kept.select("id", "stream", "item")


def refractory(spark, sf_dir):
    return R.cooldown(_events(spark, sf_dir), ["stream"], pd.Timedelta(hours=1)).select("id", "stream")


def tick_sample(spark, sf_dir):
    return R.cooldown(_events(spark, sf_dir).where("value > 5"), ["stream"], pd.Timedelta(hours=12)).groupBy("stream").agg(F.count("*").alias("ticks"), F.max("id").alias("last_id"))


def noise_floor(spark, sf_dir):
    return R.noise_floor(_events(spark, sf_dir)).select("id", F.round("floor", 6).alias("floor"), F.round("peak", 6).alias("peak"))


def adaptive_gate(spark, sf_dir):
    n = R.noise_floor(_events(spark, sf_dir).withColumn("value", F.col("value") - 90))
    return n.select("id", F.round(R.adaptive_gate(F.col("floor"), F.col("peak")), 6).alias("gate"))


def active_spans(spark, sf_dir):
    s = R.active_spans(_events(spark, sf_dir), "6 hours")
    return s.select("stream", "item", F.unix_micros("shown").alias("shown_us"), F.unix_micros("hidden").alias("hidden_us"), "events")


def capture_guess(spark, sf_dir):
    """Every fifth event is a clip; it gets the last other event of its stream with a value over 60."""
    from chirplake.operators.catalogue import captured

    e = _events(spark, sf_dir)
    clip, hits = e.where("id % 5 = 0"), e.where("id % 5 <> 0 and value > 60")
    return captured(clip.select("stream", "t", "id"), hits.select("stream", "t", "item", F.col("value").alias("score")))


def score_levels(spark, sf_dir):
    f = R.window_peak(_frames(spark, sf_dir), 4)
    level = X.score_level(F.col("value") - 90, F.col("peak") - 90)
    return f.select("id", F.round(level, 6).alias("level"), F.round(X.denoised_level(level, F.when(F.col("frame") % 2 == 0, 3.0)), 6).alias("denoised"))


RULES = Rules(threshold=50.0, margin=5.0, gate_db=20.0, cooldown_ms=6 * 3600e3, refractory_ms=3600e3, hold_ms=2 * 3600e3, hold_drop=10.0)


def _scores(spark, sf_dir):
    """Each event is a window of one ranked item, its value the score and the level."""
    e = _events(spark, sf_dir)
    return e.select("stream", (F.unix_millis("t")).cast("double").alias("t"), F.col("value").alias("level"), F.lit(1).alias("rk"), "item", F.col("value").alias("score"))


def detector(spark, sf_dir):
    return detect(_scores(spark, sf_dir), RULES).select("stream", "item", F.round("score", 6).alias("score"), F.col("at").cast("long").alias("at"))


def detector_outcomes(spark, sf_dir):
    return outcomes(_scores(spark, sf_dir), RULES)


def live_thresholds(spark, sf_dir):
    """The detector while every seventh event changes its item's threshold to twice its value, or takes it back, in its stream."""
    changes = _events(spark, sf_dir).where("id % 7 = 0").select("stream", F.unix_millis("t").cast("double").alias("t"), "item", F.when(F.col("id") % 2 == 0, 2 * F.col("value")).alias("threshold"))
    found = detect(with_changes(_scores(spark, sf_dir), changes), RULES)
    return found.select("stream", "item", F.round("score", 6).alias("score"), F.col("at").cast("long").alias("at"))


def lost_blocks(spark, sf_dir):
    """Orders are streams, line numbers blocks, discounts their levels."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return R.lost_blocks(lines.select(F.col("l_orderkey").alias("stream"), F.col("l_linenumber").alias("seq"), F.col("l_discount").alias("value")), 0.02)


def separated_peaks(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("grp"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("level"))
    strongest = p.groupBy("grp", "x").agg(F.max("level").alias("level"))
    return R.separated_peaks(strongest, 5.0, 8, 500.0).select("grp", F.round("x", 6).alias("x"), F.round("level", 6).alias("level"), "rk")


_E = "WITH RECURSIVE e AS (SELECT event_id AS id, ts AS t, user_id AS stream, event_type AS item, value FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, id) - 1 AS frame FROM e)"
_SM = _E + ", s AS (SELECT *, avg(value) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS smooth FROM f)"
_AN = _SM + ", a AS (SELECT stream, frame AS anchor, round(smooth, 9) AS smooth, count(*) OVER (PARTITION BY stream) AS frames FROM s QUALIFY row_number() OVER (PARTITION BY stream ORDER BY round(smooth, 9) DESC, frame) = 1)"


def _greedy(rows: str, by: str, hours: int) -> str:
    """Recursive SQL for rows kept at least so many hours after the last kept one of their group."""
    join = " AND ".join(f"n.{c} = g.{c}" for c in by.split(", "))
    return (
        f", n AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY t, id) AS k FROM ({rows})), "
        f"g AS (SELECT id, stream, item, t, k, TRUE AS fired, t AS last FROM n WHERE k = 1 UNION ALL "
        f"SELECT n.id, n.stream, n.item, n.t, n.k, n.t - g.last >= INTERVAL {hours} HOUR, CASE WHEN n.t - g.last >= INTERVAL {hours} HOUR THEN n.t ELSE g.last END FROM g JOIN n ON {join} AND n.k = g.k + 1)"
    )


_NF = """, z AS (SELECT *, frame AS k FROM f), g AS (
SELECT id, stream, k, v(value) AS floor, v(value) AS peak FROM z WHERE k = 0 UNION ALL
SELECT z.id, z.stream, z.k, CASE WHEN v(z.value) < g.floor THEN v(z.value) ELSE g.floor + 0.0083::DOUBLE * (v(z.value) - g.floor) END,
  CASE WHEN v(z.value) > g.peak THEN v(z.value) ELSE g.peak + 0.0014::DOUBLE * (v(z.value) - g.peak) END
FROM g JOIN z ON z.stream = g.stream AND z.k = g.k + 1)"""


def _floor(expr: str) -> str:
    import re

    return re.sub(r"v\(([\w.]+)\)", lambda m: expr.replace("x", m[1]), _NF)


def _detector_sql(changes: str, then: str) -> str:
    """The detector as recursive SQL for windows of one item: each row of g is the state after a window.

    changes gives (stream, item, t, threshold) in ms; `own` is the last of the item at or before the window.
    """
    return (
        _E
        + f""", c AS ({changes}), x AS (SELECT stream, (epoch_us(t) // 1000)::DOUBLE AS t, item, value AS v FROM e),
w AS (SELECT x.*, row_number() OVER (PARTITION BY x.stream ORDER BY x.t) AS k, coalesce(c.threshold, 50) AS own FROM x ASOF LEFT JOIN c ON c.stream = x.stream AND c.item = x.item AND x.t >= c.t),
s0 AS (SELECT *, v < 20 AS quiet, v >= own AS good FROM w),
g AS (SELECT stream, 0::BIGINT AS k, NULL::DOUBLE AS last_any, MAP {{}}::MAP(VARCHAR, DOUBLE) AS last, NULL::VARCHAR AS h_item, NULL::DOUBLE AS h_score, NULL::DOUBLE AS h_armed,
  NULL::VARCHAR AS f_item, NULL::DOUBLE AS f_score, NULL::DOUBLE AS f_at, FALSE AS no FROM (SELECT DISTINCT stream FROM s0)
UNION ALL SELECT stream, k, CASE WHEN fire THEN t ELSE last_any END,
  CASE WHEN fire THEN map_concat(last, MAP {{b_item: t}}) ELSE last END,
  CASE WHEN fire THEN NULL WHEN held THEN b_item WHEN arm THEN item END,
  CASE WHEN fire THEN NULL WHEN held THEN b_score WHEN arm THEN v END,
  CASE WHEN fire THEN NULL WHEN held THEN h_armed WHEN arm THEN t END,
  CASE WHEN fire THEN b_item END, CASE WHEN fire THEN b_score END, CASE WHEN fire THEN t END, NOT quiet AND NOT held AND NOT arm
FROM (SELECT *, held AND (quiet OR item <> b_item OR v < b_score - 10 OR t - h_armed >= 7200000 OR NOT good) AS fire,
    NOT held AND NOT quiet AND good AND coalesce(t - last[item] >= 21600000, TRUE) AND coalesce(t - last_any >= 3600000, TRUE) AS arm
  FROM (SELECT s0.*, g.last_any, g.last, g.h_armed, g.h_item IS NOT NULL AS held, g.h_item AS b_item,
      CASE WHEN NOT quiet AND s0.item = g.h_item THEN greatest(s0.v, g.h_score) ELSE g.h_score END AS b_score
    FROM g JOIN s0 ON s0.stream = g.stream AND s0.k = g.k + 1))) """
        + then
    )


_NO_CHANGES = "SELECT 0::BIGINT AS stream, '' AS item, 0::DOUBLE AS t, 0::DOUBLE AS threshold WHERE FALSE"
_CHANGES = "SELECT stream, item, (epoch_us(t) // 1000)::DOUBLE AS t, CASE WHEN id % 2 = 0 AND value > 0 THEN 2 * value END AS threshold FROM e WHERE id % 7 = 0"
_FIRED = "SELECT stream, f_item AS item, round(f_score, 6) AS score, f_at::BIGINT AS \"at\" FROM g WHERE f_at IS NOT NULL"

QUERIES = {f.__name__: f for f in (moving_average, anchor, anchor_patch, sliding_patch, window_peak, weak_anchor, onset, stream_totals, trailing_clip, capture_clip, last_50, latest_guess, audio_time, levels_dbfs, cooldown, refractory, tick_sample, noise_floor, adaptive_gate, active_spans, capture_guess, score_levels, detector, detector_outcomes, live_thresholds, lost_blocks, separated_peaks, tick_ranking, shown_sets, level_window, mel_scale)}

ORACLES = {
    "moving_average": _SM + " SELECT stream, frame, round(smooth, 6) AS smooth FROM s",
    "anchor": _AN + " SELECT stream, anchor, round(smooth, 6) AS smooth, frames FROM a",
    "anchor_patch": _AN + ", p AS (SELECT stream, greatest(0, least(anchor - 15, frames - 32)) AS start FROM a WHERE frames >= 32) SELECT stream, min(start) AS start, count(*) AS n, round(sum(value), 6) AS total FROM f JOIN p USING (stream) WHERE frame BETWEEN start AND start + 31 GROUP BY stream",
    "sliding_patch": _E + " SELECT stream, frame, round(sum(value) OVER w, 6) AS total, round(first_value(value) OVER w, 6) AS oldest FROM f WINDOW w AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) QUALIFY frame >= 31",
    "window_peak": _E + ", p AS (SELECT stream, frame, max(value) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS p FROM f) SELECT stream, frame, round(p, 6) AS peak, round(10 * log10(greatest(p * p, 1e-12)), 4) AS level_db FROM p",
    "weak_anchor": _AN + """, p AS (SELECT a.stream, anchor, frames, value AS peak FROM a JOIN f ON f.stream = a.stream AND f.frame = anchor),
b AS (SELECT stream, peak, anchor, frames, avg(value) FILTER (abs(frame - anchor) > 3) AS bed FROM f JOIN p USING (stream) GROUP BY ALL)
SELECT stream, anchor AS "at", frames, round(peak, 6) AS peak, round(bed, 10) AS bed, coalesce(frames / 100.0 > 0.75 AND frames >= 8 AND (peak <= 1e-12 OR (bed > 1e-18 AND bed <= 0.25 * peak AND 10 * log10(peak / bed) < 9)), FALSE) AS weak FROM b""",
    "onset": _E + """, w AS (SELECT stream, frame, list(pow(10.0::DOUBLE, value / 8 - 14)) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS p FROM f QUALIFY frame >= 11),
x AS (SELECT stream, list_max(p[8:12]) AS peak, list_sum(p[1:7]) / 7 AS bed, p[8:12] AS tip FROM w)
SELECT stream, count(*) AS windows, count(*) FILTER (CASE WHEN bed <= 1e-12 THEN peak > 1e-10 WHEN peak <= 0 THEN FALSE WHEN 10 * log10(peak / bed) >= 12 THEN TRUE WHEN peak > 1e-5 AND bed > peak * 0.05 THEN TRUE
  ELSE len(list_filter(tip, lambda v: v >= greatest(bed * pow(10.0::DOUBLE, 0.6::DOUBLE), 1e-5))) >= 5 END) AS onsets FROM x GROUP BY stream""",
    "tick_ranking": _E + ", m AS (SELECT id, t, stream, item, last_value(CASE WHEN value >= 20 THEN item END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS top FROM e)" + _greedy("SELECT * FROM m", "stream", 12) + " SELECT g.id, g.stream, m.top FROM g JOIN m USING (id) WHERE fired",
    "shown_sets": _E + """, z AS (SELECT stream, id, t, item, frame AS k FROM f), g AS (SELECT stream, id, k, [{'i': item, 't': t}] AS xs, 0::BIGINT AS evicted FROM z WHERE k = 0 UNION ALL
SELECT stream, id, k, list_append(CASE WHEN known OR len(live) < 2 THEN list_filter(live, lambda x: x.i <> item) ELSE live[2:] END, {'i': item, 't': t}), evicted + CASE WHEN known OR len(live) < 2 THEN 0 ELSE 1 END
FROM (SELECT *, len(list_filter(live, lambda x: x.i = item)) > 0 AS known FROM (SELECT z.*, g.evicted, list_filter(g.xs, lambda x: z.t - x.t < INTERVAL 18 HOUR) AS live FROM g JOIN z ON z.stream = g.stream AND z.k = g.k + 1)))
SELECT id, len(xs)::INT AS shown, evicted FROM g""",
    "level_window": _E + ", m AS (SELECT id, avg(value * value) OVER (PARTITION BY stream ORDER BY t, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p FROM e) SELECT id, CASE WHEN p > 0 THEN round(20 * log10(sqrt(p)), 6) END AS level_db FROM m",
    "mel_scale": _E + " SELECT id, round(2595 * log10(1 + value * 40 / 700), 6) AS mel, round(value * 40, 4) AS hz FROM e",
    "stream_totals": _E + " SELECT stream, count(*) AS blocks, count(*) FILTER (value < 20) AS silent, round(max(value), 6) AS max_level, round(avg(value), 6) AS avg_level FROM e GROUP BY stream",
    "trailing_clip": _E + " SELECT id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM e WINDOW w AS (PARTITION BY stream ORDER BY t RANGE BETWEEN INTERVAL 86400 SECOND PRECEDING AND CURRENT ROW)",
    "capture_clip": _E + " SELECT c.id AS clip, r.id, round(r.value, 6) AS value FROM e c JOIN e r ON r.stream = c.stream AND r.t <= c.t AND r.t > c.t - INTERVAL 6 HOUR WHERE c.id % 5 = 0",
    "last_50": _E + " SELECT stream, id, row_number() OVER (PARTITION BY stream ORDER BY t DESC, id DESC) AS rk FROM e QUALIFY rk <= 50",
    "latest_guess": _E + " SELECT stream, CASE WHEN value >= 20 THEN item END AS item, epoch_us(t) AS us FROM e QUALIFY row_number() OVER (PARTITION BY stream ORDER BY t DESC, id DESC) = 1",
    "audio_time": _E + " SELECT stream, round(max(frame) * 256 * 1000.0::DOUBLE / 48000, 6) AS last_ms FROM f GROUP BY stream",
    "levels_dbfs": _E + " SELECT id, CASE WHEN value > 0 THEN round(20 * log10(value / 100), 4) END AS dbfs, least(32767, greatest(-32768, round(value / 100 * 32767)))::INT AS code FROM e",
    "cooldown": _E + _greedy("SELECT * FROM e", "stream, item", 6) + " SELECT id, stream, item FROM g WHERE fired",
    "refractory": _E + _greedy("SELECT * FROM e", "stream", 1) + " SELECT id, stream FROM g WHERE fired",
    "tick_sample": _E + _greedy("SELECT * FROM e WHERE value > 5", "stream", 12) + " SELECT stream, count(*) AS ticks, max(id) AS last_id FROM g WHERE fired GROUP BY stream",
    "noise_floor": _E + _floor("x") + " SELECT id, round(floor, 6) AS floor, round(peak, 6) AS peak FROM g",
    "adaptive_gate": _E + _floor("(x - 90)") + " SELECT id, round(CASE WHEN peak - floor < 12 AND floor > -42 THEN -60 ELSE greatest(-60, -70, floor + 4) END, 6) AS gate FROM g",
    "active_spans": _E + """, b AS (SELECT *, CASE WHEN t - lag(t) OVER o < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM e WINDOW o AS (PARTITION BY stream, item ORDER BY t)),
c AS (SELECT *, sum(new) OVER (PARTITION BY stream, item ORDER BY t) AS span FROM b)
SELECT stream, item, epoch_us(min(t)) AS shown_us, epoch_us(max(t) + INTERVAL 6 HOUR) AS hidden_us, count(*) AS events FROM c GROUP BY stream, item, span""",
    "capture_guess": _E + """, h AS (SELECT * FROM e WHERE id % 5 <> 0 AND value > 60)
SELECT c.id, h.item AS guess_id, round(h.value, 4) AS guess_score FROM (SELECT * FROM e WHERE id % 5 = 0) c ASOF LEFT JOIN h ON c.stream = h.stream AND c.t >= h.t""",
    "score_levels": _E + """, p AS (SELECT *, value - 90 AS m, max(value) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) - 90 AS w FROM f),
l AS (SELECT id, frame, CASE WHEN w > m AND w >= -54 THEN w ELSE m END AS level FROM p)
SELECT id, round(level, 6) AS level, round(level - CASE WHEN frame % 2 = 0 THEN 3 ELSE 0 END, 6) AS denoised FROM l""",
    "detector": _detector_sql(_NO_CHANGES, _FIRED),
    "detector_outcomes": _detector_sql(_NO_CHANGES, "SELECT g.stream, count(*) AS ticks, count(*) FILTER (v < 20) AS silent, count(*) FILTER (no) AS rejected, count(f_at) AS fired FROM g JOIN s0 USING (stream, k) GROUP BY g.stream"),
    "live_thresholds": _detector_sql(_CHANGES, _FIRED),
    "lost_blocks": "WITH b AS (SELECT l_orderkey AS stream, l_linenumber AS seq, count(*) AS n, max(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT stream, count(*) AS blocks, max(seq) - min(seq) + 1 - count(*) AS dropped, sum(n - 1)::BIGINT AS repeated, count(*) FILTER (v IS NULL OR v < 0.02) AS silent FROM b GROUP BY stream",
    "separated_peaks": """WITH RECURSIVE p AS (SELECT p_brand AS grp, p_size::DOUBLE AS x, max(p_retailprice) AS level FROM part GROUP BY 1, 2),
l AS (SELECT *, lag(level) OVER o AS a, lead(level) OVER o AS b, lag(x) OVER o AS xa, lead(x) OVER o AS xb FROM p WINDOW o AS (PARTITION BY grp ORDER BY x)),
d AS (SELECT *, CASE WHEN a - 2 * level + b <> 0 THEN 0.5::DOUBLE * (a - b) / (a - 2 * level + b) END AS delta FROM l WHERE level >= a AND level > b AND level > 500),
n AS (SELECT grp, level, CASE WHEN abs(delta) <= 1 THEN x + delta * (xb - xa) / 2 ELSE x END AS x FROM d),
m AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY level DESC, x) AS k FROM n),
g AS (SELECT grp, x, level, k, TRUE AS kept, [x] AS xs FROM m WHERE k = 1 UNION ALL
SELECT m.grp, m.x, m.level, m.k, len(list_filter(g.xs, lambda y: abs(y - m.x) < 5)) = 0,
  CASE WHEN len(list_filter(g.xs, lambda y: abs(y - m.x) < 5)) = 0 THEN list_append(g.xs, m.x) ELSE g.xs END FROM g JOIN m ON m.grp = g.grp AND m.k = g.k + 1)
SELECT grp, round(x, 6) AS x, round(level, 6) AS level, len(xs)::INT AS rk FROM g WHERE kept AND len(xs) <= 8""",
}
