"""Versions, the table function, a stream's measures, clips, substring joins, gates, and patches that are refused."""

import datetime
import json
import random as rnd

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import signal as G
from chirplake.functions import vectors as V
from chirplake.functions.tables import register
from chirplake.operators import library as L
from chirplake.operators.catalogue import _parts, resolved_names
from chirplake.operators.series import clip_length, clips, frame_gate, weak_anchors
from chirplake.sources.versions import Made, Refused, Versions
from chirplake.streaming.metrics import Progress, observed, totals

MADE = Made("f1", "log-mel", 3, 2)


def templates(spark, n):
    return spark.range(n).select(F.col("id").alias("template_id"), F.array(F.col("id").cast("tinyint"), F.lit(1).cast("tinyint")).alias("q"))


def test_versions_are_published_whole_and_refused_when_they_do_not_fit(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/t")
    with pytest.raises(Refused, match="no version"):
        v.read(MADE)
    v.publish(templates(spark, 3), MADE)
    old = v.read(MADE)
    assert v.publish(templates(spark, 5), MADE) == "000000000002.json"
    assert old.count() == 3 and v.read(MADE).count() == 5  # a reader stays with its version
    for other, said in ((Made("f2", "log-mel", 3, 2), "no version"), (Made("f1", "mfcc", 3, 2), "algorithm"), (Made("f1", "log-mel", 99, 2), "version"), (Made("f1", "log-mel", 3, 4), "dim")):
        with pytest.raises(Refused, match=said):
            v.read(other)
    with pytest.raises(Refused, match="3 entries"):
        v.publish(templates(spark, 2), Made("f1", "log-mel", 3, 3))
    assert v.read(MADE).count() == 5


@pytest.mark.parametrize("harm", ["empty", "half", "magic", "longer", "gone"])
def test_damaged_versions_are_refused_and_built_anew(spark, tmp_path, harm):
    v = Versions(spark, f"file://{tmp_path}/t")
    v.publish(templates(spark, 3), MADE)
    manifest = next((tmp_path / "t/manifests/f1").glob("0*.json"))
    part = next((tmp_path / "t/data").glob("*/part-*"))
    at = manifest if harm in ("empty", "half", "magic") else part
    raw = at.read_bytes()
    for crc in at.parent.glob(f".{at.name}.crc"):
        crc.unlink()
    if harm == "gone":
        at.unlink()
    else:
        at.write_bytes({"empty": b"", "half": raw[: len(raw) // 2], "magic": b"XXXX" + raw[4:], "longer": raw + b"\xaa" * 8}[harm])
    with pytest.raises(Refused):
        v.read(MADE)
    df, why = v.read_or_build(MADE, lambda: templates(spark, 4))
    assert df.count() == 4 and why and v.read_or_build(MADE, lambda: templates(spark, 9))[1] is None


def test_a_form_of_another_time_is_refused(spark, tmp_path):
    import hashlib

    v = Versions(spark, f"file://{tmp_path}/t")
    v.publish(templates(spark, 3), MADE)
    at = next((tmp_path / "t/manifests/f1").glob("0*.json"))
    body = json.dumps(json.loads(at.read_bytes().partition(b"\n")[2]) | {"form": 99}).encode()
    at.with_name(f".{at.name}.crc").unlink()
    at.write_bytes(hashlib.sha256(body).hexdigest().encode() + b"\n" + body)
    with pytest.raises(Refused, match="form 99"):
        v.read(MADE)


def test_frames_in_sql(spark):
    register(spark)
    spark.createDataFrame([(s, k, None if k == 3 else float(k)) for s in ("a", None) for k in range(6)] + [("b", 0, 1.0)], "stream string, t long, x double").createOrReplaceTempView("rows")
    out = spark.sql("SELECT * FROM frames(TABLE(rows) PARTITION BY stream ORDER BY t, value => 'x', n => 4)").collect()
    assert sorted((str(r.stream), r.frame, r.patch) for r in out) == sorted((s, k, [0.0 if j == 3 else float(j) for j in range(k - 3, k + 1)]) for s in ("a", "None") for k in (3, 4, 5))
    assert [r.energy for r in out if r.frame == 3] == [(0 + 1 + 4) / 4] * 2
    for wrong in ("value => 'y', n => 4", "value => 'x', n => 0"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM frames(TABLE(rows) PARTITION BY stream ORDER BY t, {wrong})").collect()


def test_progress_counts_what_a_stream_reads(spark, tmp_path):
    values = [float(k) for k in range(40)]
    spark.createDataFrame([(v, 1 if v == 7 else 0) for v in values], "value double, lost long").repartition(4).write.parquet(str(tmp_path / "in"))
    listener = Progress()
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema("value double, lost long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = observed(source, 10.0).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    listener.written(spark, str(tmp_path / "table"))
    assert listener.table(spark).count() == 0
    r = totals(spark.read.parquet(str(tmp_path / "table"))).first()
    assert (r.blocks, r.silent, r.dropped, r.max_level, r.batches) == (40, 10, 1, 39.0, 4)
    assert r.max_ms >= r.avg_ms > 0 and r.ms_per_20ms == pytest.approx(r.avg_ms * 4 * 20 / (40 * 20))


def test_clips(spark):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    r = rnd.Random(3)
    rows = [(s, at(r.randrange(0, 60_000)), k) for k in range(300) for s in ("a", None)] + [("a", None, 1), ("b", at(0), 2)]
    marks = [(k, s, at(r.randrange(0, 60_000))) for k, s in enumerate(["a", None, "c"] * 6)] + [(99, "a", None), (98, "b", at(2000)), (97, "b", at(1999))]
    out = clips(spark.createDataFrame(marks, "clip long, stream string, t timestamp"), spark.createDataFrame(rows, "stream string, t timestamp, k long"), 2).collect()
    wanted = sorted((c, str(s), k) for c, s, t in marks for z, u, k in rows if z == s and t and u and t - datetime.timedelta(seconds=2) < u <= t)
    assert sorted((x.clip, str(x.stream), x.k) for x in out) == wanted and (97, "b", 2) in wanted
    assert [clip_length(x) for x in (0, 5, 99)] == [1, 5, 30]


def test_parts_of_names_that_share_a_beginning(spark):
    """Looked-up pieces grow with the text, not with the number of names that share a prefix."""
    names = [f"common prefix {k:04d}" for k in range(1000)]
    inner = spark.createDataFrame([(n,) for n in names] + [("",), ("prefix 0007",), ("日本",)], "part string")
    outer = spark.createDataFrame([(n + " x",) for n in names] + [("in 日本 here",), ("日",)], "whole string")
    found = sorted(map(tuple, _parts(inner, outer).collect()))
    assert found == sorted([(n, n + " x") for n in names] + [("prefix 0007", "common prefix 0007 x"), ("日本", "in 日本 here")])
    none = resolved_names(outer.select(F.col("whole").alias("name")), inner.where("part = 'q'").select(F.col("part").alias("asset")), spark.createDataFrame([], "alias string, asset string"))
    assert {r.asset for r in none.collect()} == {None}


def test_the_anchor_is_the_top_of_the_smoothed_curve(spark):
    """A spike of one frame and a plateau: the plateau's middle counts."""
    values = [1.0] * 80
    values[3] = 30.0
    values[40:60] = [5.0] * 20
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)], "stream string, frame long, value double")
    r = weak_anchors(df, F.lit(1.0)).first()
    assert (r["at"], r.peak) == (47, 5.0) and r.bed == pytest.approx(np.mean([v for k, v in enumerate(values) if abs(k - 47) > 3])) and r.weak is False


def test_frame_gate_keeps_the_loudest_so_far(spark):
    levels = [-50.0, -55.0, -45.0, -20.0, -45.0, -46.0]
    df = spark.createDataFrame([("a", k, k, v, -40.0) for k, v in enumerate(levels)], "stream string, t long, id long, level double, floor double")
    assert [r.gated for r in frame_gate(df, 3.0).orderBy("t").collect()] == [False, True, False, False, False, True]
    assert not any(r.gated for r in frame_gate(df, 0.0).collect())


def test_steps_of_odd_vectors(spark):
    rows = [([1.0, float("nan")],), ([1.0, float("inf")],), ([0.0, 0.0],), ([1.0, -2.0],)]
    out = spark.createDataFrame(rows, "v array<double>").withColumn("s", V.scale_of(F.col("v"))).withColumn("q", V.quantise(F.col("v"), F.col("s"))).collect()
    assert [r.s for r in out] == [0.0, 0.0, 0.0, 2 / 127] and [r.q for r in out] == [[0, 0], [0, 0], [0, 0], [64, -127]]


def test_spectra_of_frames_of_several_lengths(spark):
    random = np.random.default_rng(0)
    frames = [random.standard_normal(n).tolist() for n in (8, 16, 8)] + [None, []]
    out = spark.createDataFrame([(k, f) for k, f in enumerate(frames)], "k long, f array<double>").coalesce(1).select("k", G.power("f").alias("p")).orderBy("k").collect()
    for r, f in zip(out, frames):
        if f:
            p = np.abs(np.fft.rfft(f)) ** 2
            p[1:-1] *= 2
            assert np.allclose(r.p, p)
    assert out[3].p is None and out[4].p == []


def test_embedding_of_short_recordings(spark):
    df = spark.createDataFrame([(0, [[1.0, 2.0]] * 3), (1, [[1.0, 2.0], [3.0, 9.0], [0.0, 1.0], [2.0, 2.0]]), (2, [])], "k long, f array<array<double>>")
    out = {r.k: r.p for r in df.select("k", G.confirm_patch(F.col("f"), 4).alias("p")).collect()}
    assert out[0] is None and out[2] is None and len(out[1]) == 8 and np.linalg.norm(out[1]) == pytest.approx(1)


def test_loading_totals_and_refused_patches(spark):
    samples = spark.createDataFrame([("i", "a.wav", "recall"), ("i", "b.wav", "recall"), ("gone", "c.wav", None)], "item_id string, file string, source string")
    items, blobs = spark.createDataFrame([("i",), ("empty",)], "item_id string"), spark.createDataFrame([("i", "a.wav"), ("i", "z.wav"), ("gone", "d.wav")], "item_id string, file string")
    out = {r.file: (r.state, r.source, r.warning) for r in L.loaded(samples, items, blobs).collect()}
    assert out["a.wav"] == ("kept", "recall", None) and out["b.wav"][0] == "missing" and out["z.wav"][:2] == ("recovered", "recovered")
    assert {out[f][0] for f in ("c.wav", "d.wav")} == {"no_item"} and all(w and w.endswith(f) for f, (s, _, w) in out.items() if s != "kept")
    assert tuple(L.totals(items, spark.createDataFrame([("i", 1.5), ("i", 2.0), ("gone", 9.0)], "item_id string, seconds double")).first()) == (2, 2, 3.5)
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id long, name string, updated_at int")
    patches = spark.createDataFrame([(1, "　 "), (2, "new"), (3, None), (4, "x")], "id long, name string")
    assert {(r.id, r.reason) for r in L.refused(patches, table, "id", "name").collect()} == {(1, "name is required"), (4, "not found")}
    assert sorted(map(tuple, L.patched(table, patches, "id", "name", F.lit(1)).select("id", "name", "updated_at").collect())) == [(1, "a", 0), (2, "new", 1), (3, "c", 1)]
