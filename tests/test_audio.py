"""Audio jobs on small synthetic recordings."""

import struct

import numpy as np

from chirplake.operators.search import best_per_item, search
from chirplake.sources.recordings import SPAN, anchor_templates, decoded, features, read_recordings, recording_windows, sniffed
from chirplake.streaming.features import Analyser


def tone(hz, seconds, rate=48000, level=0.6):
    t = np.arange(int(seconds * rate)) / rate
    fade = np.minimum(1, np.minimum(t, t[::-1]) / 0.01)
    return level * fade * np.sin(2 * np.pi * hz * t)


def wav(x, rate=48000, channels=1):
    data = (np.repeat(np.clip(x, -1, 1), channels) * 32767).astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVEfmt " + struct.pack("<I", 16) + form + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def burst(seed, seconds=0.3):
    n = int(seconds * 48000)
    return 0.5 * np.sin(np.pi * np.arange(n) / n) * np.random.default_rng(seed).uniform(-1, 1, n)


def riff(form, data, *before, cut=0):
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in (*before, (b"fmt ", form), (b"data", data)))
    return (b"RIFF" + struct.pack("<I", len(body)) + body)[: len(body) + 8 - cut]


def head(tag, bits, channels=1, rate=48000):
    width = (bits + 7) // 8
    return struct.pack("<HHIIHH", tag, channels, rate, rate * channels * width, channels * width, bits)


def extended(sub, bits):
    return head(0xFFFE, bits) + struct.pack("<HHIH", 22, bits, 0, sub) + b"\0" * 14


#: name, bytes, samples or a part of the reason why there are none
FILES = [
    ("u8", riff(head(1, 8), bytes([0, 128, 255, 64])), [-1, 0, 127 / 128, -0.5]),
    ("i16", riff(head(1, 16), struct.pack("<3h", -32768, 32767, 1) + b"x"), [-1, 32767 / 32768, 1 / 32768]),
    ("i12", riff(head(1, 12), struct.pack("<h", 16384)), [0.5]),
    ("i24", riff(head(1, 24), b"\0\0\x80\xff\xff\x7f\x01\0\0"), [-1, 8388607 / 8388608, 1 / 8388608]),
    ("i32", riff(head(1, 32), struct.pack("<2i", -(2**31), 2**30)), [-1, 0.5]),
    ("f32", riff(head(3, 32), struct.pack("<2f", 0.25, -3)), [0.25, -3]),
    ("f64", riff(head(3, 64), struct.pack("<d", 0.1)), [0.1]),
    ("ext16", riff(extended(1, 16), struct.pack("<h", 16384)), [0.5]),
    ("extf", riff(extended(3, 32), struct.pack("<f", 0.5), (b"LIST", b"abc")), [0.5]),
    ("stereo", riff(head(1, 16, 2), struct.pack("<5h", 16384, 0, -16384, -16384, 7)), [0.25, -0.5]),
    ("nodata", riff(head(1, 16), b""), []),
    ("short-ext", riff(head(0xFFFE, 16), b"ab"), "under 40"),
    ("short-fmt", riff(b"abcd", b"ab"), "under 16"),
    ("f16", riff(head(3, 16), b"ab"), "floats of 16"),
    ("i4", riff(head(1, 4), b"ab"), "integers of 4"),
    ("none", riff(head(1, 16, 0), b"ab"), "no channels"),
    ("rate", riff(head(1, 16, 1, 0), b"ab"), "no channels"),
    ("cut", riff(head(1, 16), b"abcdef", cut=2), "ends behind"),
    ("junk", b"RIFF\4\0\0\0WAVEjunk\xff\0\0\0a", "ends behind"),
    ("noformat", b"RIFF\4\0\0\0WAVE", "no format"),
    ("empty", b"", "empty"),
    ("riff", b"RIFFxxxxAVI ", "no RIFF/WAVE"),
]


def test_formats_and_rejects(spark):
    files = spark.createDataFrame([(f"{n}.wav", "wav", bytearray(b), "kept") for n, b, _ in FILES] + [("null.wav", "wav", None, "kept"), ("x.mp3", "mp3", bytearray(b"ID3"), "kept")], "path string, format string, content binary, extra string")
    got = {r.path: r for r in decoded(files).collect()}
    assert len(got) == len(FILES) + 2 and all(r.extra == "kept" for r in got.values())
    for name, content, expected in FILES:
        r = got[f"{name}.wav"]
        if isinstance(expected, str):
            assert r.pcm is None and r.origin is None and expected in r.reject, name
        else:
            assert r.reject is None and np.allclose(r.pcm, expected, rtol=0, atol=1e-15) and r.origin.bytes == len(content) and r.origin.frames == len(expected), name
    assert got["stereo.wav"].origin.downmixed and not got["u8.wav"].origin.downmixed
    assert got["f32.wav"].origin.peak_db == 0 and got["nodata.wav"].origin.peak_db is None
    assert got["x.mp3"].reject == "format mp3" and got["null.wav"].reject == "empty file"
    assert decoded(files.limit(0)).collect() == []


def test_names_and_first_bytes_tell_formats(spark):
    rows = [("a.WAVE", b"", "wav"), ("b", b"RIFF0000WAVE", "wav"), ("c.wav", b"ID3x", "mp3"), ("d.flac", b"RIFF0000AVI ", "flac"), ("e", b"xx", "unknown")]
    got = sniffed(spark.createDataFrame([(p, bytearray(b)) for p, b, _ in rows], "path string, content binary")).collect()
    assert {r.path: r.format for r in got} == {p: f for p, _, f in rows}


def test_frames_over_several_spans_equal_one_pass_and_a_stream_in_pieces(spark):
    x = burst(4, 1.6)
    n = (len(x) - 1024) // 256 + 1
    assert n > SPAN
    r = spark.createDataFrame([("s", x.tolist()), ("short", [0.1] * 1023), ("null", None), ("empty", [])], "path string, pcm array<double>")
    plain = features(r, None).toPandas().sort_values("frame")
    assert plain["path"].unique().tolist() == ["s"] and plain["frame"].tolist() == list(range(n))
    blocks = np.stack([x[256 * k : 256 * k + 1024] for k in range(n)])
    power = np.abs(np.fft.rfft((blocks - blocks.mean(1, keepdims=True)) * np.hanning(1025)[:-1])) ** 2
    power[:, 1:-1] *= 2
    mel = 2595 * np.log10(1 + np.array([40, 16000]) / 700)
    edges = 700 * (10 ** (np.linspace(*mel, 66) / 2595) - 1)
    bank = np.stack([np.interp(np.arange(513) * 46.875, edges[k : k + 3], [0, 2 / (edges[k + 2] - edges[k]), 0], left=0, right=0) for k in range(64)])
    assert np.allclose(np.stack(plain["mel"].to_numpy()), 10 * np.log10(np.maximum(power @ bank.T, 1e-12)), atol=1e-8)
    assert np.allclose(plain["energy"], (blocks**2).mean(1))
    clean = features(r).toPandas().sort_values("frame")
    a, at, parts = Analyser(), 0, []
    for size in (1, 1000, 23, 1, 2, 4000, 700, len(x)):
        parts.append(a.push(x[at : at + size]))
        at += size
    assert np.allclose(np.stack(clean["mel"].to_numpy()), np.concatenate([m for m, _ in parts]), atol=1e-8)
    assert np.allclose(clean["energy"], plain["energy"]) and not np.allclose(np.stack(clean["mel"].to_numpy()), np.stack(plain["mel"].to_numpy()), atol=0.1)


def test_the_anchor_is_the_loudest_part_and_flat_or_silent_recordings_are_rejected(spark):
    late = np.concatenate([np.random.default_rng(2).uniform(-1e-4, 1e-4, 48000), burst(1, 0.2), np.random.default_rng(3).uniform(-1e-4, 1e-4, 12000)])
    rows = [("late", late.tolist(), None), ("silent", [0.0] * 9600, None), ("short", [0.5] * 8959, None), ("flat", (0.3 * np.sin(np.arange(48000) * (1 + np.arange(48000) / 1e5))).tolist(), None), ("bad", None, "why"), ("none", None, None)]
    got = {r.path: r for r in anchor_templates(spark.createDataFrame(rows, "path string, pcm array<double>, reject string")).collect()}
    assert {k: r.reject for k, r in got.items()} == {"late": None, "silent": "silent", "short": "too short: 8959 samples, 8960 at least", "flat": None, "bad": "why", "none": "no samples"}
    centre = (got["late"].frame - 16) * 256 + 512
    assert abs(centre / 48000 - 1.1) < 0.06 and abs(np.linalg.norm(got["late"].v) - 1) < 1e-9 and got["bad"].v is None


def test_windows_are_the_patches_of_their_frames(spark):
    r = spark.createDataFrame([("s", burst(6, 0.3).tolist(), None), ("r", burst(6, 0.3).tolist(), "no")], "path string, pcm array<double>, reject string").cache()
    mel = np.stack(features(r.where("path = 's'")).toPandas().sort_values("frame")["mel"].to_numpy())
    w = recording_windows(r).toPandas().sort_values("frame")
    assert w["path"].unique().tolist() == ["s"] and w["frame"].tolist() == list(range(31, len(mel)))
    for frame, v in zip(w["frame"], w["v"]):
        p = mel[frame - 31 : frame + 1].ravel()
        p = np.maximum(p, p.max() - 20)
        assert np.allclose(v, (p - p.mean()) / np.linalg.norm(p - p.mean()))


def test_recordings_are_identified(spark, tmp_path):
    sounds = {"a880": tone(880, 0.5), "b1500": tone(1500, 0.5), "c-burst": burst(0), "d-offset": np.concatenate([np.zeros(33600), tone(880, 0.5)]), "e-short": tone(880, 0.02), "f-stereo": tone(880, 0.5, 44100)}
    for name, x in sounds.items():
        (tmp_path / f"{name}.wav").write_bytes(wav(x, 44100, 2) if name == "f-stereo" else wav(x))
    (tmp_path / "g.mp3").write_bytes(b"ID3xxxx")
    (tmp_path / "h.wav").write_bytes(b"RIFFxxxxWAVE")
    recordings = read_recordings(spark, str(tmp_path)).cache()
    rejects = {r.path.rsplit("/", 1)[1]: r.reject for r in anchor_templates(recordings).where("reject is not null").collect()}
    assert set(rejects) == {"e-short.wav", "g.mp3", "h.wav"} and rejects["e-short.wav"].startswith("too short: 960 samples")
    from pyspark.sql import functions as F

    from chirplake.functions.vectors import quantise, scale_of

    items = {"a880.wav": 1, "b1500.wav": 2, "c-burst.wav": 3}
    number = F.create_map(*[F.lit(v) for kv in items.items() for v in kv])
    t = anchor_templates(recordings).withColumn("item", number[F.element_at(F.split("path", "/"), -1)]).where("item is not null")
    t = t.select(F.col("item").cast("long").alias("template_id"), F.col("item").cast("long").alias("item"), quantise(F.col("v"), scale_of(F.col("v"))).cast("array<tinyint>").alias("q"), scale_of(F.col("v")).alias("scale"))
    w = recording_windows(recordings).withColumn("file", F.element_at(F.split("path", "/"), -1)).where("frame % 4 = 3").withColumn("window_id", F.xxhash64("path", "frame")).cache()
    hits = best_per_item(search(w.select("window_id", "v"), t)).join(w.select("window_id", "file"), "window_id")
    best = {}
    for r in hits.groupBy("file", "item").agg(F.max("score").alias("score")).collect():
        best[r.file] = max(best.get(r.file, (-1, 0)), (r.score, r.item))
    assert best["a880.wav"][1] == 1 and best["b1500.wav"][1] == 2 and best["c-burst.wav"][1] == 3
    assert best["d-offset.wav"][1] == 1 and best["f-stereo.wav"][1] == 1 and best["d-offset.wav"][0] > 0.9


def test_anchors_of_energies_that_are_equal_to_twelve_places(spark):
    """The first frame counts, whatever the last bits of the sums are."""
    x = np.tile(np.random.default_rng(5).uniform(-0.5, 0.5, 256), 60)
    x[9000] += np.sign(x[9000]) * 1e-11
    r = spark.createDataFrame([("a", x.tolist(), None)], "path string, pcm array<double>, reject string")
    (row,) = anchor_templates(r, settings=None).collect()
    assert (row.frame, row.reject) == (31, None)
