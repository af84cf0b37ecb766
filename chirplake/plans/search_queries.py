"""Search queries on `embeddings`: labels are items, every fifth vector is a window, the rest are templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.functions import vectors as V
from chirplake.operators import search as S
from chirplake.operators.confirm import confirmed_by_search

LEAST, MARGIN = 0.36, 0.03


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.template_table(_embeddings(spark, sf_dir).where("vec_id % 5 <> 0"), id="vec_id", item="label", vector="embedding")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _embeddings(spark, sf_dir).where("vec_id % 5 = 0").select(F.col("vec_id").alias("window_id"), V.doubles("embedding").alias("v"))
    return S.search(windows, _templates(spark, sf_dir))


def _recording():
    return F.expr("window_id div 50")


def template_search(spark, sf_dir):
    return S.ranked(_hits(spark, sf_dir), "window_id", 5).select("window_id", "item", "template_id", F.round("score", 6).alias("score"), "rk")


def best_sample(spark, sf_dir):
    return _hits(spark, sf_dir).select("window_id", "item", "template_id", F.concat(F.lit("sample-"), "template_id").alias("sample_file"), F.round("score", 6).alias("score"))


def identify_verdict(spark, sf_dir):
    found = S.verdicts(S.identified(_hits(spark, sf_dir), _recording()), LEAST)
    return found.select("recording", "item", F.round("score", 6).alias("score"), "verdict")


def identify_items(spark, sf_dir):
    found = S.ranked(S.identified(_hits(spark, sf_dir), _recording()), "recording", 3)
    return found.select("recording", "item", "window_id", F.round("score", 6).alias("score"), "rk")


def similarity_matrix(spark, sf_dir):
    m = S.matrix(S.identified(_hits(spark, sf_dir), _recording()), list(range(10)))
    return m.select("recording", *[F.round(f"item_{i}", 6).alias(f"item_{i}") for i in range(10)])


def margin_gate(spark, sf_dir):
    best = S.with_margin(_hits(spark, sf_dir), "window_id")
    fired = (F.col("score") >= LEAST) & (F.col("margin").isNull() | (F.round("margin", 6) >= MARGIN))
    return best.select("window_id", "item", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"), fired.alias("fired"))


def gate_outcomes(spark, sf_dir):
    m = margin_gate(spark, sf_dir)
    why = F.when(F.col("score") < LEAST, "threshold").when(F.col("margin") < MARGIN, "margin").otherwise("fired")
    return m.groupBy(why.alias("outcome")).agg(F.count("*").alias("windows"))


def rival_veto(spark, sf_dir):
    return S.unrivalled(_hits(spark, sf_dir), "window_id").select("window_id", "item", F.round("score", 6).alias("score"), F.round("rival", 6).alias("rival"))


def threshold_overlay(spark, sf_dir):
    live = _embeddings(spark, sf_dir).groupBy(F.col("label").cast("long").alias("item")).agg((F.max("vec_id") % 3 * 0.14).alias("threshold")).where("item < 8")
    top = S.overlay_thresholds(S.ranked(_hits(spark, sf_dir), "window_id", 1), live, LEAST)
    return top.select("window_id", "item", "threshold", (F.round("score", 6) >= F.col("threshold")).alias("passes"))


def hit_enrichment(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") - 1).alias("item"), "p_name", "p_brand")
    top = S.ranked(_hits(spark, sf_dir), "window_id", 3)
    label = F.concat_ws("｜", "p_brand", "p_name")
    return top.join(names, "item", "left").select("window_id", "item", "rk", F.when(F.char_length(label) > 20, F.concat(F.left(label, F.lit(19)), F.lit("…"))).otherwise(label).alias("label"))


def confirm_score(spark, sf_dir):
    """Every third vector against the variants of its own label, every seventh."""
    e = _embeddings(spark, sf_dir)
    live = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("window_id"), F.col("label").alias("item"), V.doubles("embedding").alias("v"))
    return S.confirmed(live, e.where("vec_id % 7 = 0 and label < 8").select(F.col("label").alias("item"), V.doubles("embedding").alias("u"))).select("window_id", "item", F.round("confirm", 6).alias("confirm"))


def confirm_gate(spark, sf_dir):
    """Every third vector as a window of its own label, against the variants of all labels, every seventh."""
    e = _embeddings(spark, sf_dir)
    live = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("window_id"), F.col("label").alias("item"), V.doubles("embedding").alias("v"))
    variants = e.where("vec_id % 7 = 0 and label < 8").select(F.col("vec_id").alias("variant_id"), F.col("label").alias("item"), F.col("embedding").alias("u"))
    told = confirmed_by_search(live, variants, least=0.3)
    return told.select("window_id", "item", F.round("confirm", 6).alias("confirm"), F.round("rival", 6).alias("rival"), "accept")


def frame_mean(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(V.mean(V.doubles("embedding")), 9).alias("mean"))


def index_build_report(spark, sf_dir):
    return S.build_report(_templates(spark, sf_dir), 64).select("item", "built", "unusable", "bytes")


def quantise_roundtrip_snr(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("vec_id", V.doubles("embedding").alias("v")).withColumn("scale", V.scale_of(F.col("v")))
    back = V.dequantise(V.quantise(F.col("v"), F.col("scale")), F.col("scale"))
    err = F.zip_with("v", back, lambda a, b: (a - b) * (a - b))
    # The step is rounded in a select of its own: in one with the ratio, Spark takes the rounded alias for the step that the lambdas read.
    e = e.select("vec_id", "scale", (10 * F.log10(V.dot(F.col("v"), F.col("v")) / V.total(err))).alias("snr_db"))
    return e.select("vec_id", F.round("scale", 9).alias("scale"), F.round("snr_db", 1).alias("snr_db"))


def quantise_odd(spark, sf_dir):
    """Codes of all vectors, of which some get an entry that isn't finite, or are zero."""
    v = V.doubles("embedding")
    odd = F.when(F.col("vec_id") % 4 == 0, float("nan")).when(F.col("vec_id") % 4 == 1, float("inf")).when(F.col("vec_id") % 4 == 2, float("-inf")).otherwise(0.0)
    v = F.when(F.col("vec_id") % 3 == 0, F.concat(F.array(odd), F.slice(v, 2, 63))).when(F.col("vec_id") % 31 == 1, F.transform(v, lambda x: x * 0)).otherwise(v)
    e = _embeddings(spark, sf_dir).select("vec_id", v.alias("v")).withColumn("scale", V.scale_of(F.col("v")))
    codes = e.withColumn("q", V.quantise(F.col("v"), F.col("scale"))).select("vec_id", "scale", F.posexplode("q").alias("pos", "code"))
    return codes.select("vec_id", F.round("scale", 9).alias("scale"), "pos", F.col("code").cast("int").alias("code"))


def patch_normalise(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("vec_id", F.transform(V.doubles("embedding"), lambda x: x * 100).alias("v"))
    n = V.patch_normalise(F.col("v"))
    return e.select("vec_id", n.alias("n")).select("vec_id", F.round(F.col("n")[0], 6).alias("first"), F.round(F.array_max("n"), 6).alias("top"), F.round(V.total(F.col("n")), 6).alias("total"))


def usable_patches(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("label", V.doubles("embedding").alias("v"))
    return e.groupBy("label").agg(F.count("*").alias("patches"), F.count_if(F.exists("v", lambda x: x != 0)).alias("usable"))


def mean_pool(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def mel_projection(spark, sf_dir):
    """16 triangular bands over 64 bins; the weights are a table joined on the bin."""
    bins = spark.range(64).select(F.col("id").alias("bin")).crossJoin(spark.range(16).select(F.col("id").alias("band")))
    w = F.greatest(F.lit(0.0), 1 - F.abs(F.col("bin") - (F.col("band") * 4 + 2)) / 4.0)
    weights = F.broadcast(bins.select("bin", "band", w.alias("w")).where("w > 0"))  # fixed at 64 x 16
    power = _embeddings(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("bin", "x")).withColumn("p", F.col("x").cast("double") * F.col("x").cast("double"))
    return power.join(weights, "bin").groupBy("vec_id", "band").agg(F.round(F.sum(F.col("w") * F.col("p")), 8).alias("energy"))


def template_spectrum_peaks(spark, sf_dir):
    """Local maxima over a vector's places, by its neighbours."""
    from pyspark.sql import Window

    x = _embeddings(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    w = Window.partitionBy("vec_id").orderBy("pos")
    peaks = x.withColumn("a", F.lag("x").over(w)).withColumn("b", F.lead("x").over(w)).where("x > a and x > b")
    return peaks.groupBy("vec_id").agg(F.count("*").alias("maxima"), F.min("pos").alias("first"))


_BASE = """
WITH e AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT *, list_max(list_transform(v, lambda x: abs(x))) / 127 AS scale FROM e),
t AS (SELECT vec_id, label, v, scale, list_transform(v, lambda x: CASE WHEN scale > 0 THEN greatest(-127, least(127, round(x / scale))) ELSE 0 END::DOUBLE) AS q FROM m),
s AS (SELECT w.vec_id AS window_id, t.label AS item, t.vec_id AS template_id, round(greatest(-1, least(1, list_inner_product(w.v, t.q) * t.scale)), 9) AS score
  FROM e w, t WHERE w.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
h AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY window_id, item ORDER BY score DESC, template_id) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY score DESC, item) AS rk FROM h),
i AS (SELECT window_id // 50 AS recording, item, window_id, score FROM h QUALIFY row_number() OVER (PARTITION BY window_id // 50, item ORDER BY score DESC, window_id) = 1),
j AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY score DESC, item) AS rk FROM i),
g AS (SELECT window_id, item, rk, score, score - lead(score) OVER (PARTITION BY window_id ORDER BY rk) AS margin FROM r WHERE rk <= 5),
k AS (SELECT window_id, item, round(score, 6) AS score, round(margin, 6) AS margin, score >= 0.36 AND (margin IS NULL OR round(margin, 6) >= 0.03) AS fired FROM g WHERE rk = 1)
"""

QUERIES = {f.__name__: f for f in (template_search, best_sample, identify_verdict, identify_items, similarity_matrix, margin_gate, gate_outcomes, rival_veto, threshold_overlay, hit_enrichment, confirm_score, confirm_gate, frame_mean, index_build_report, quantise_roundtrip_snr, quantise_odd, patch_normalise, usable_patches, mean_pool, mel_projection, template_spectrum_peaks)}

ORACLES = {
    "template_search": _BASE + "SELECT window_id, item, template_id, round(score, 6) AS score, rk FROM r WHERE rk <= 5",
    "best_sample": _BASE + "SELECT window_id, item, template_id, 'sample-' || template_id AS sample_file, round(score, 6) AS score FROM h",
    "identify_verdict": _BASE + "SELECT recording, CASE WHEN score >= 0.36 THEN item END AS item, round(score, 6) AS score, CASE WHEN score >= 0.36 THEN 'match' ELSE 'no reliable hit' END AS verdict FROM j WHERE rk = 1",
    "identify_items": _BASE + "SELECT recording, item, window_id, round(score, 6) AS score, rk FROM j WHERE rk <= 3",
    "similarity_matrix": _BASE + "SELECT recording, " + ", ".join(f"max(CASE WHEN item = {n} THEN round(score, 6) END) AS item_{n}" for n in range(10)) + " FROM i GROUP BY recording",
    "margin_gate": _BASE + "SELECT * FROM k",
    "gate_outcomes": _BASE + "SELECT CASE WHEN score < 0.36 THEN 'threshold' WHEN margin < 0.03 THEN 'margin' ELSE 'fired' END AS outcome, count(*) AS windows FROM k GROUP BY 1",
    "rival_veto": _BASE + "SELECT a.window_id, a.item, round(a.score, 6) AS score, round(b.score, 6) AS rival FROM r a LEFT JOIN r b ON a.window_id = b.window_id AND b.rk = 2 WHERE a.rk = 1 AND (b.score IS NULL OR b.score <= a.score - 0.06)",
    "threshold_overlay": _BASE + """, l AS (SELECT label AS item, max(vec_id) % 3 * 0.14::DOUBLE AS threshold FROM e WHERE label < 8 GROUP BY label),
c AS (SELECT window_id, item, score, CASE WHEN threshold > 0 THEN threshold ELSE 0.36 END::DOUBLE AS threshold FROM r LEFT JOIN l USING (item) WHERE rk = 1)
SELECT window_id, item, threshold, round(score, 6) >= threshold AS passes FROM c""",
    "hit_enrichment": _BASE + """, p AS (SELECT p_partkey - 1 AS item, p_brand || '｜' || p_name AS label FROM part)
SELECT window_id, item, rk, CASE WHEN length(label) > 20 THEN substr(label, 1, 19) || '…' ELSE label END AS label FROM r LEFT JOIN p USING (item) WHERE rk <= 3""",
    "confirm_score": "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings) SELECT a.vec_id AS window_id, a.label AS item, round(max(CASE WHEN b.v IS NULL THEN -1 ELSE greatest(-1, least(1, list_inner_product(a.v, b.v))) END), 6) AS confirm FROM e a LEFT JOIN (SELECT * FROM e WHERE vec_id % 7 = 0 AND label < 8) b ON a.label = b.label WHERE a.vec_id % 3 = 0 GROUP BY ALL",
    "confirm_gate": """WITH e AS (SELECT vec_id, label::BIGINT AS label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label, b.label AS other, max(round(greatest(-1, least(1, list_inner_product(a.v, b.v))), 9)) AS score FROM e a LEFT JOIN (SELECT * FROM e WHERE vec_id % 7 = 0 AND label < 8) b ON TRUE WHERE a.vec_id % 3 = 0 GROUP BY ALL),
m AS (SELECT vec_id, label, coalesce(max(score) FILTER (WHERE other = label), -1) AS confirm, max(score) FILTER (WHERE other <> label) AS rival FROM s GROUP BY ALL)
SELECT vec_id AS window_id, label AS item, round(confirm, 6) AS confirm, round(rival, 6) AS rival, confirm >= 0.3 AND NOT coalesce(rival > round(confirm - 0.06, 9), FALSE) AS accept FROM m""",
    "frame_mean": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / len(embedding), 9) AS mean FROM embeddings",
    "index_build_report": _BASE + "SELECT label AS item, count(*) AS built, count(*) FILTER (scale = 0) AS unusable, count(*) * 64 AS bytes FROM t WHERE vec_id % 5 <> 0 GROUP BY ROLLUP (label)",
    "quantise_roundtrip_snr": _BASE + "SELECT vec_id, round(scale, 9) AS scale, round(10 * log10(list_inner_product(v, v) / list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2] * scale) * (z[1] - z[2] * scale)))), 1) AS snr_db FROM t",
    "quantise_odd": """WITH a AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT vec_id, pos, CASE WHEN vec_id % 3 = 0 AND pos = 0 THEN ['NaN'::DOUBLE, 'Infinity'::DOUBLE, '-Infinity'::DOUBLE, 0][vec_id % 4 + 1] WHEN vec_id % 3 > 0 AND vec_id % 31 = 1 THEN 0 ELSE x END AS x FROM a),
c AS (SELECT *, max(abs(x)) OVER w AS most, bool_and(isfinite(x)) OVER w AS fine FROM b WINDOW w AS (PARTITION BY vec_id)),
d AS (SELECT *, CASE WHEN fine THEN most / 127 ELSE 0 END AS scale FROM c)
SELECT vec_id, round(scale, 9) AS scale, pos, (CASE WHEN scale > 0 THEN greatest(-127, least(127, round(x / scale))) ELSE 0 END)::INT AS code FROM d""",
    "patch_normalise": """WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS v FROM embeddings),
b AS (SELECT vec_id, list_transform(v, lambda x: greatest(x, list_max(v) - 20)) AS f FROM a),
c AS (SELECT vec_id, list_transform(f, lambda x: x - list_sum(f) / len(f)) AS d FROM b),
n AS (SELECT vec_id, list_transform(d, lambda x: x / sqrt(list_inner_product(d, d))) AS n FROM c)
SELECT vec_id, round(n[1], 6) AS first, round(list_max(n), 6) AS top, round(list_sum(n), 6) + 0 AS total FROM n""",
    "usable_patches": "SELECT label, count(*) AS patches, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) > 0) AS usable FROM embeddings GROUP BY label",
    "mean_pool": "WITH a AS (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, pos, round(avg(x), 6) AS mean FROM a GROUP BY label, pos",
    "mel_projection": """WITH a AS (SELECT vec_id, unnest(range(len(embedding))) AS bin, unnest(embedding)::DOUBLE AS x FROM embeddings),
w AS (SELECT bin, band, greatest(0, 1 - abs(bin - (band * 4 + 2)) / 4.0::DOUBLE) AS w FROM range(64) b(bin), range(16) c(band))
SELECT vec_id, band, round(sum(w * x * x), 8) AS energy FROM a JOIN w USING (bin) WHERE w > 0 GROUP BY vec_id, band""",
    "template_spectrum_peaks": """WITH a AS (SELECT vec_id, unnest(range(len(embedding)))::INT AS pos, unnest(embedding) AS x FROM embeddings),
b AS (SELECT *, lag(x) OVER o AS l, lead(x) OVER o AS n FROM a WINDOW o AS (PARTITION BY vec_id ORDER BY pos))
SELECT vec_id, count(*) AS maxima, min(pos) AS first FROM b WHERE x > l AND x > n GROUP BY vec_id""",
}
