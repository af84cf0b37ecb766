"""Queries of the library, of captures, of the confirm embedding, of the table function and of a stream's own measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from chirplake.functions import signal as G
from chirplake.functions.tables import register
from chirplake.operators import catalogue as C
from chirplake.operators import library as L
from chirplake.operators import search as S
from chirplake.operators import series as R
from chirplake.plans.search_queries import _BASE, _hits
from chirplake.plans.series_queries import _E, _events, _floor
from chirplake.plans.signal_queries import _F, _pcm
from chirplake.plans.stream_queries import finished
from chirplake.sources.shared import shared_path
from chirplake.streaming.metrics import Progress, observed, totals


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_warnings(spark, sf_dir):
    """Orders are items, of which every eleventh has no metadata; lines are samples, of which every seventh part has no file and every fifth no metadata."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.format_string("%d.wav", "l_linenumber").alias("file"), "l_partkey", F.col("l_returnflag").alias("source"))
    items = _t(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("item_id"))
    return L.loaded(lines.where("l_partkey % 5 <> 0").drop("l_partkey"), items, lines.where("l_partkey % 7 <> 0").select("item_id", "file"))


def library_size(spark, sf_dir):
    """Customers are items, their orders samples of a second for each ten thousand of price."""
    samples = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), (F.col("o_totalprice") / 10_000).cast("double").alias("seconds"))
    return L.totals(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id")), samples).withColumn("seconds", F.round("seconds", 3))


def _patches(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    items = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("note"), F.lit(0).alias("updated_at"))
    name = F.when(F.col("c_custkey") % 4 == 0, F.lit(" \t")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("new "), "c_name"))
    return items, c.where("c_custkey % 3 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 5 == 0, 1_000_000_000).otherwise(0)).alias("id"), name.alias("name"), F.lit("patched").alias("note"))


def patch_refused(spark, sf_dir):
    items, patches = _patches(spark, sf_dir)
    return L.refused(patches, items, "id", "name").select("id", "reason")


def patch_named(spark, sf_dir):
    items, patches = _patches(spark, sf_dir)
    return L.patched(items, patches, "id", "name", F.lit(1)).select("id", "name", "note", "updated_at")


def capture_candidate(spark, sf_dir):
    """Every fifth event captures its user's last six hours: how many samples, the loudest, whether all are silent, and the guess at that time."""
    e = _events(spark, sf_dir).withColumn("value", F.when(F.col("stream") % 10 == 0, 0.0).otherwise(F.col("value")))
    marks = e.where("id % 5 = 0")
    clips = R.clips(marks.select(F.col("id").alias("clip"), "stream", "t"), e, 6 * 3600)
    sound = clips.groupBy(F.col("clip").alias("id")).agg(F.count("*").alias("n"), F.max(F.abs("value")).alias("peak"))
    guess = C.captured(marks.select("stream", "t", "id"), e.where("id % 5 <> 0 and value > 60").select("stream", "t", "item", F.col("value").alias("score")))
    return sound.join(guess, "id").select("id", "n", F.round("peak", 6).alias("peak"), (F.col("peak") == 0).alias("silent"), "guess_id", "guess_score")


def frame_gate(spark, sf_dir):
    """Values less 90 as levels in dB over their stream's noise floor, and a gate of 6 dB."""
    n = R.noise_floor(_events(spark, sf_dir).withColumn("value", F.col("value") - 90)).withColumn("level", F.col("value"))
    return R.frame_gate(n, 6.0).select("id", "gated")


def confirm_embedding(spark, sf_dir):
    """Each vector as seven frames of 16 bands; patches of four frames, and a projection to 32 values."""
    frames = _pcm(spark, sf_dir).select("vec_id", G.framed(F.transform("v", lambda x: x * 20), 16, 8).alias("frames"))
    pooled = frames.select("vec_id", G.confirm_patch(F.col("frames"), 4, offsets=(-2, 0, 2), half=1).alias("v"))
    p = pooled.select("vec_id", F.posexplode(G.projected(32)(F.col("v"))).alias("dim", "x"))
    return p.select("vec_id", "dim", F.round("x", 6).alias("x"))


def sample_provenance(spark, sf_dir):
    """The best template of each window and item with the document that stands for its sample."""
    samples = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("template_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("sample_file"), (F.col("n_chars") % 7).alias("sample_idx"))
    return S.with_provenance(_hits(spark, sf_dir), samples).select("window_id", "item", "sample_file", "sample_idx", F.round("score", 6).alias("score"))


def udtf_frames(spark, sf_dir):
    """Sliding patches by the table function, in SQL."""
    register(spark)
    _events(spark, sf_dir).createOrReplaceTempView("chirplake_events")
    out = spark.sql("SELECT * FROM frames(TABLE(SELECT stream, t, id, value FROM chirplake_events) PARTITION BY stream ORDER BY (t, id), value => 'value', n => 32)")
    return out.select("stream", "frame", F.round(F.element_at("patch", 1), 6).alias("oldest"), F.round("energy", 9).alias("energy"))


def stream_progress(spark, sf_dir):
    """`events` as a stream of blocks in four files, and what was counted on the way."""
    path = shared_path(spark, "levels")
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), "value")
    e.repartition(4).write.parquet(path)
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        blocks = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
        place = shared_path(spark, "progress")
        query = observed(blocks, 20.0).writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    told = totals(listener.table(spark).where(F.col("query") == str(query.runId)))
    return told.select("blocks", "silent", "dropped", F.round("max_level", 6).alias("max_level"), "batches", (F.col("ms_per_20ms") > 0).alias("timed"))


QUERIES = {f.__name__: f for f in (load_warnings, library_size, patch_refused, patch_named, capture_candidate, frame_gate, confirm_embedding, sample_provenance, udtf_frames, stream_progress)}

_PATCHES = """WITH p AS (SELECT c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 1000000000 ELSE 0 END AS id, CASE c_custkey % 4 WHEN 0 THEN ' ' || chr(9) WHEN 1 THEN 'new ' || c_name END AS name FROM customer WHERE c_custkey % 3 = 0),
r AS (SELECT id, CASE WHEN id >= 1000000000 THEN 'not found' ELSE 'name is required' END AS reason FROM p WHERE id >= 1000000000 OR trim(name, ' ' || chr(9)) = '')"""

ORACLES = {
    "load_warnings": """WITH l AS (SELECT l_orderkey AS item_id, l_linenumber || '.wav' AS file, l_partkey, l_returnflag AS source FROM lineitem),
s AS (SELECT item_id, file, source FROM l WHERE l_partkey % 5 <> 0), b AS (SELECT DISTINCT item_id, file, 1 AS has FROM l WHERE l_partkey % 7 <> 0),
j AS (SELECT item_id, file, source, has, item_id % 11 = 0 AS lost, s.file IS NOT NULL AS named FROM s FULL JOIN b USING (item_id, file)),
t AS (SELECT *, CASE WHEN lost THEN 'no_item' WHEN named AND has = 1 THEN 'kept' WHEN named THEN 'missing' ELSE 'recovered' END AS state FROM j)
SELECT item_id, file, CASE WHEN state = 'recovered' THEN 'recovered' ELSE source END AS source, state,
  CASE state WHEN 'no_item' THEN 'item without metadata: ' WHEN 'missing' THEN 'sample file is missing: ' WHEN 'recovered' THEN 'recovered a sample that no metadata names: ' END || file AS warning FROM t""",
    "library_size": "SELECT (SELECT count(*) FROM customer) AS items, count(*) AS samples, round(sum((o_totalprice / 10000)::DOUBLE), 3) AS seconds FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "patch_refused": _PATCHES + " SELECT * FROM r",
    "patch_named": _PATCHES + """ SELECT c_custkey AS id, coalesce(p.name, c_name) AS name, CASE WHEN p.id IS NOT NULL THEN 'patched' ELSE c_mktsegment END AS note, CASE WHEN p.id IS NOT NULL THEN 1 ELSE 0 END AS updated_at
FROM customer LEFT JOIN (SELECT * FROM p WHERE id NOT IN (SELECT id FROM r)) p ON p.id = c_custkey""",
    "capture_candidate": _E + """, z AS (SELECT id, t, stream, item, CASE WHEN stream % 10 = 0 THEN 0 ELSE value END AS value FROM e), c AS (SELECT * FROM z WHERE id % 5 = 0), h AS (SELECT * FROM z WHERE id % 5 <> 0 AND value > 60),
s AS (SELECT c.id, count(*) AS n, max(abs(r.value)) AS peak FROM c JOIN z r ON r.stream = c.stream AND r.t <= c.t AND r.t > c.t - INTERVAL 6 HOUR GROUP BY c.id)
SELECT s.id, n, round(peak, 6) AS peak, peak = 0 AS silent, h.item AS guess_id, round(h.value, 4) AS guess_score FROM s JOIN c USING (id) ASOF LEFT JOIN h ON h.stream = c.stream AND c.t >= h.t""",
    "frame_gate": _E + _floor("(x - 90)") + """, y AS (SELECT f.id, f.stream, f.frame, f.value - 90 AS level, f.value - 90 < g.floor + 6 AS low FROM f JOIN g USING (id))
SELECT id, coalesce(low AND level < max(CASE WHEN low THEN level END) OVER (PARTITION BY stream ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS gated FROM y""",
    "confirm_embedding": _F + """, b AS (SELECT vec_id, frame, k, x * 20 AS x FROM f), n AS (SELECT vec_id, frame, sum(x * x) AS e FROM b GROUP BY ALL),
sm AS (SELECT vec_id, frame, avg(e) OVER (PARTITION BY vec_id ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM n),
pk AS (SELECT vec_id, frame AS peak FROM sm QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, frame) = 1),
st AS (SELECT vec_id, o, greatest(0, least(peak + o - 1, 3)) AS start FROM pk, (SELECT unnest([-2, 0, 2]) AS o)),
pt AS (SELECT st.vec_id, o, (frame - start) * 16 + k AS i, x FROM st JOIN b ON b.vec_id = st.vec_id AND frame >= start AND frame < start + 4),
p1 AS (SELECT *, greatest(x, max(x) OVER w - 20) AS y FROM pt WINDOW w AS (PARTITION BY vec_id, o)),
p2 AS (SELECT *, y - avg(y) OVER (PARTITION BY vec_id, o) AS z FROM p1), p3 AS (SELECT *, z / sqrt(sum(z * z) OVER (PARTITION BY vec_id, o)) AS u FROM p2),
po AS (SELECT vec_id, i, sum(u) / 3 AS x FROM p3 GROUP BY vec_id, i),
h AS (SELECT i, d, xor(xor((i::BIGINT * 2654435769) & 4294967295, (d::BIGINT * 2246822507) & 4294967295), 2779096485) AS y FROM range(64) a(i), range(32) c(d)),
hi AS (SELECT i, d, (xor(y, y >> 16) * 2146121005) & 4294967295 AS y FROM h), sg AS (SELECT i, d, CASE WHEN bit_count(xor(y, y >> 15)) & 1 = 1 THEN 1.0::DOUBLE ELSE -1 END AS s FROM hi),
pr AS (SELECT vec_id, d, sum(x * s) AS y FROM po JOIN sg USING (i) GROUP BY vec_id, d)
SELECT vec_id, d::INT AS dim, round(y / sqrt(sum(y * y) OVER (PARTITION BY vec_id)), 6) AS x FROM pr""",
    "sample_provenance": _BASE + " SELECT window_id, item, source || '/' || doc_id AS sample_file, n_chars % 7 AS sample_idx, round(score, 6) AS score FROM h JOIN documents ON doc_id = template_id",
    "udtf_frames": _E + " SELECT stream, frame, round(first_value(value) OVER w, 6) AS oldest, round(avg(value * value) OVER w, 9) AS energy FROM f WINDOW w AS (PARTITION BY stream ORDER BY frame ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) QUALIFY frame >= 31",
    "stream_progress": "SELECT count(*) AS blocks, count(*) FILTER (value < 20) AS silent, 0::BIGINT AS dropped, round(max(value), 6) AS max_level, 4::BIGINT AS batches, TRUE AS timed FROM events",
}
