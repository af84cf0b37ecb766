"""The spectral scan: tones on one channel, slices, rows without a scan."""

import math

import pytest

from chirplake.operators.scan import channel_levels, scan

RATE = 8000
SCHEMA = "id int, pcm array<double>, channels int, rate int, hz double, from_s double, length_s double"


def tone(hz, n, amplitude=0.5):
    return [amplitude * math.sin(2 * math.pi * hz * k / RATE) for k in range(n)]


def both(left, right):
    return [x for pair in zip(left, right, strict=True) for x in pair]


@pytest.fixture(scope="module")
def df(spark):
    quiet = [0.0] * 4000
    rows = [
        (0, tone(883.0, 400), 1, RATE, 880.0, 0.0, 0.0),
        (1, both(tone(440.0, 4000, 0.1), tone(1500.0, 4000)), 2, RATE, 1500.0, 0.0, 0.0),
        (2, both(tone(700.0, 4000), [-x for x in tone(700.0, 4000)]), 2, RATE, 700.0, 0.0, 0.0),
        (3, quiet + tone(880.0, 4000), 1, RATE, 880.0, 0.5, 0.25),
        (4, tone(880.0, 4000), 1, RATE, 2000.0, 0.0, 0.0),
        (5, quiet, 1, RATE, 880.0, 0.0, 0.0),
        (6, None, 1, RATE, 880.0, 0.0, 0.0),
        (7, [], 2, RATE, 880.0, 0.0, 0.0),
        (8, tone(880.0, 20), 1, RATE, 880.0, 0.001, 0.0),
        (9, tone(880.0, 100), 1, 30, 10.0, 0.0, 0.0),
        (10, tone(880.0, 100), 0, RATE, 880.0, 0.0, 0.0),
        (11, [float("nan")] * 64, 1, RATE, 880.0, 0.0, 0.0),
        (12, tone(880.0, 100), 1, None, 880.0, 0.0, 0.0),
        (13, tone(880.0, 100), 1, RATE, 880.0, 9.0, 0.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_verdicts(df):
    out = {r.id: r for r in scan(df, ["id"]).collect()}
    assert [out[k].verdict for k in range(14)] == ["found"] * 4 + ["not found"] + ["silent"] * 3 + ["too short", "unusable", "unusable", "not found", "unusable", "too short"]
    assert out[0].dominant == pytest.approx(883, abs=1) and out[0].dominant_db == pytest.approx(20 * math.log10(0.5), abs=0.5) and out[0].nearest
    assert out[1].channel == 1 and out[1].dominant == pytest.approx(1500, abs=0.5) and out[1].share == pytest.approx(1, abs=1e-6)
    assert out[2].channel == 0 and out[2].nearest
    assert out[3].samples == 2000 and out[3].tone_db == pytest.approx(20 * math.log10(0.5), abs=1e-3)
    assert not out[4].nearest and out[4].share < 1e-6
    assert all(out[k].dominant is None and out[k].tone_db is None for k in (5, 6, 7, 8, 9, 10, 12, 13))


def test_blocks_of_long_recordings_add_up(spark):
    """A tone over many blocks against the same sum over all samples."""
    x = tone(1234.5, 5000)
    row = scan(spark.createDataFrame([(0, x, 1, RATE, 1230.0, 0.0, 0.0)], SCHEMA), ["id"]).first()
    n = len(x)
    w = [v * (0.5 - 0.5 * math.cos(2 * math.pi * k / n)) for k, v in enumerate(x)]
    re, im = (sum(v * f(2 * math.pi * 1230.0 / RATE * k) for k, v in enumerate(w)) for f in (math.cos, math.sin))
    assert row.tone_db == pytest.approx(20 * math.log10(4 * math.hypot(re, im) / n), abs=1e-9)


def test_channel_levels(df, spark):
    out = {(r.id, r.channel): r for r in channel_levels(df, ["id"]).collect()}
    assert out[1, 0].peak == pytest.approx(0.1, abs=0.01) and out[1, 1].rms_db == pytest.approx(20 * math.log10(0.5 / math.sqrt(2)), abs=1e-3)
    assert out[5, 0].silent and out[5, 0].zeros == 1 and out[5, 0].peak_db is None and out[7, 1].silent
    assert not any(k[0] in (6, 10) for k in out)
    assert channel_levels(df.limit(0), ["id"]).count() == 0 and scan(df.limit(0), ["id"]).count() == 0
