"""The high-pass against its recurrence, and the noise pass at its edges."""

import math

import numpy as np
from pyspark.sql import functions as F

from chirplake.functions import signal as G
from chirplake.operators.denoise import FIRST, MOST_HOPS, Settings, denoised, high_passed, long_enough


def test_high_pass_equals_its_recurrence(spark):
    random = np.random.default_rng(0)
    rows = [(k, random.standard_normal(n).tolist()) for k, n in enumerate((0, 1, 2, 63, 64, 65, 200, 200))] + [(9, None)]
    out = spark.createDataFrame(rows, "k long, v array<double>").coalesce(1).select("k", high_passed(48_000.0, 500.0)("v").alias("y"), high_passed(48_000.0, 24_000.0)("v").alias("same")).collect()
    w = 2 * math.pi * 500 / 48_000
    alpha, c = math.sin(w) / (2 * math.sqrt(2)), math.cos(w)
    for (_, v), r in zip(rows, sorted(out, key=lambda r: r.k)):
        assert r.same == v
        if v is None:
            assert r.y is None
            continue
        expected, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
        for x in v:
            y = ((1 + c) / 2 * (x + x2) - (1 + c) * x1 + 2 * c * y1 - (1 - alpha) * y2) / (1 + alpha)
            x1, x2, y1, y2 = x, x1, y, y1
            expected.append(y)
        assert np.allclose(r.y, expected, atol=1e-12)


def frames(spark, powers, energies):
    rows = [("s", k, k, [float(p)] * 8, float(e)) for k, (p, e) in enumerate(zip(powers, energies))]
    return spark.createDataFrame(rows, "stream string, t long, id long, power array<double>, energy double").repartition(3)


def test_a_new_scene_is_learnt_after_its_time(spark):
    s = Settings(hop_s=0.05)
    out = denoised(frames(spark, [1] * 10 + [100] * 30, [1] * 40), s).orderBy("t").collect()
    assert [r.ready for r in out] == [False] * (FIRST - 1) + [True] * (41 - FIRST)
    rise = [k for k, r in enumerate(out) if r.scene]
    assert rise[0] == 10 + s.scene_hops - 1 and out[rise[0] - 1].noise[0] < 2 and out[-1].noise[0] > 20
    assert all(r.cut_db == 0 for r in out[: FIRST - 1]) and out[8].cut_db > 0


def test_short_transients_stay_and_long_rises_do_not(spark):
    out = denoised(frames(spark, [1] * 30, [1.0] * 10 + [50.0] * 12 + [1.0] * 8)).orderBy("t").collect()
    assert [k for k, r in enumerate(out) if r.protected] == list(range(10, 10 + MOST_HOPS))
    assert all(r.clean == r.power and r.cut_db == 0 for r in out if r.protected) and out[20].cut_db > 0


def test_the_gain_has_a_floor_and_a_mix(spark):
    df = frames(spark, [1] * 40, [1] * 40)
    last = lambda s: denoised(df, s).orderBy(F.desc("t")).first().clean[0]
    assert abs(last(Settings(over=1000.0)) - 10 ** (-8 / 20)) < 1e-4 and last(Settings(mix=0.0)) == 1.0
    assert denoised(df.where("t < 0")).count() == 0


def test_formats_of_rows(spark):
    v = [float(k) for k in range(12)]
    df = spark.createDataFrame([(1, 48_000, v), (2, 48_000, v), (5, 24_000, v), (20, 48_000, v)], "channels int, rate int, v array<double>")
    out = [r.c for r in df.select("channels", G.canonical(F.col("v"), F.col("channels"), F.col("rate")).alias("c")).orderBy("channels").collect()]
    assert out[0] == v and out[1] == [x + 0.5 for x in v[::2]] and out[2] == [2.0, 4.5, 7.0, 7.0] and out[3] == []
    assert [r.reject is None for r in long_enough(spark.createDataFrame([([1.0] * 8960,), ([1.0] * 8959,), (None,)], "pcm array<double>")).collect()] == [True, False, True]


def test_what_tasks_make_of_long_rows_leaves_them_in_parts():
    """A batch of recordings or frames isn't copied whole, and its parts give what the rows by themselves give."""
    import pandas as pd

    from chirplake.functions import signal as G
    from chirplake.operators.denoise import AT_ONCE, HighPass, high_passed

    random = np.random.default_rng(8)
    frames = pd.Series(list(random.standard_normal((600, G.FRAME))))
    made = list(G.spectra.func(iter([frames, frames[:3]])))
    assert [len(p) for p in made] == [256, 256, 88, 3]
    assert np.allclose(np.stack(pd.concat(made)["power"].to_list()), G.spectra_of(np.stack(frames.to_list() + frames[:3].to_list()))[0])
    assert [len(p) for p in G.log_mel.func(p["power"] for p in [pd.concat(made)])] == [256, 256, 91]
    sizes = [AT_ONCE // 3, AT_ONCE // 3, AT_ONCE * 2, None, AT_ONCE // 2, 5, 5]
    pcm = pd.Series([None if n is None else random.standard_normal(n) for n in sizes])
    parts = list(high_passed(48_000.0).func(iter([pcm])))
    assert [len(p) for p in parts] == [2, 1, 4]
    for x, y in zip(pcm, pd.concat(parts), strict=True):
        assert y is None if x is None else np.allclose(HighPass(48_000.0).push(x[None])[0], y)
