"""Exact search by pivots against the blocks and against all pairs; evidence against plain loops."""

import numpy as np
import pandas as pd
import pytest

from chirplake.operators.confirm import Variants, confirmed_by_search, with_evidence
from chirplake.operators.search import Pivots, pruned_search, search


def tables(spark, clustered, n=600, dim=16, seed=0):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((6, dim))
    items = random.integers(0, 6, n)
    vectors = centres[items] * 5 * clustered + random.standard_normal((n, dim))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    scale = np.abs(vectors).max(1) / 127
    codes = np.round(vectors / scale[:, None]).astype(int)
    codes[5:8], items[5:8] = codes[5], items[5]  # equal templates: the smallest id counts
    codes[9], scale[9] = 0, 0.0
    templates = spark.createDataFrame([(int(k), int(i), c.tolist(), float(s)) for k, (i, c, s) in enumerate(zip(items, codes, scale))], "template_id long, item long, q array<tinyint>, scale double")
    v = np.concatenate([vectors[:40], random.standard_normal((20, dim)) * 3, np.zeros((1, dim))])
    windows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "window_id long, v array<double>").repartition(3)
    expected = []
    score = np.round(np.clip((v @ codes.T.astype(float)) * scale, -1, 1), 9)
    for w in range(len(v)):
        for i in np.unique(items):
            mine = np.flatnonzero(items == i)
            k = mine[score[w, mine].argmax()]
            expected.append((w, int(i), int(k), float(score[w, k])))
    return windows, templates, expected


def rows(df):
    return sorted((r.window_id, r.item, r.template_id, r.score) for r in df.collect())


@pytest.mark.parametrize("clustered", [0, 1])
def test_pivots_blocks_and_all_pairs_agree(spark, clustered):
    windows, templates, expected = tables(spark, clustered)
    found, blocks = rows(search(windows, templates)), rows(search(windows, templates, most_bytes=0))
    assert [f[:3] for f in found] == [e[:3] for e in expected] == [b[:3] for b in blocks]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=2e-9)


def test_whole_groups_are_left_out(spark):
    """Of clustered templates most are never compared; of random ones none need be left out."""
    random = np.random.default_rng(1)
    centres = random.standard_normal((40, 24)) * 8
    vectors = centres.repeat(100, 0) + random.standard_normal((4000, 24)) * 0.3
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    codes, ids = np.round(vectors * 127), np.arange(4000)
    pivots = Pivots(codes, np.full(4000, 1 / 127), np.zeros(4000, int), ids)
    top, at, compared = pivots.best(vectors[::50])
    assert np.allclose(top[:, 0], np.round((vectors[::50] @ codes.T / 127).max(1).clip(-1, 1), 9), atol=2e-9)
    assert compared.mean() < 0.2 * 4000
    assert pivots.best(random.standard_normal((5, 24)))[2].max() <= 4000


def test_no_templates_and_no_windows(spark):
    windows, templates, _ = tables(spark, 0, n=20)
    assert search(windows, templates.where("item = 99")).count() == 0 and search(windows.where("window_id = -1"), templates).count() == 0
    assert pruned_search(windows, templates.toPandas()).columns == ["window_id", "item", "template_id", "score", "compared"]


def evidence(spark, n=80, dim=8):
    random = np.random.default_rng(3)
    variants = [(k, int(random.integers(0, 4)), random.standard_normal(dim)) for k in range(24)]
    variants = [(k, i, u / np.linalg.norm(u)) for k, i, u in variants]
    live = []
    for k in range(n):
        v = variants[k % 24][2] + random.standard_normal(dim) * 0.3
        live.append((k, int(variants[k % 24][1]) if k % 5 else 9, v / np.linalg.norm(v)))
    told = {}
    for k, item, v in live:
        own = max([float(v @ u) for _, i, u in variants if i == item], default=-1.0)
        other = max(float(v @ u) for _, i, u in variants if i != item)
        told[k] = own >= 0.6 and not other > own - 0.06
    return variants, live, told


def test_evidence_and_the_search_agree(spark):
    variants, live, told = evidence(spark)
    assert 5 < sum(told.values()) < 75
    table = spark.createDataFrame([(k, i, u.tolist()) for k, i, u in variants], "variant_id long, item long, u array<double>")
    windows = spark.createDataFrame([(k, i, v.tolist()) for k, i, v in live], "window_id long, item long, v array<double>")
    assert {r.window_id: r.accept for r in confirmed_by_search(windows, table).collect()} == told
    rows = windows.selectExpr("window_id", "1 as rk", "-20d as level", "item", "0.9d as score", "v", "cast(null as array<double>) as energies")
    found = {r.window_id: (r.accept, r.onset) for r in with_evidence(rows, Variants(table)).collect()}
    assert found == {k: (a, None) for k, a in told.items()}
    with pytest.raises(ValueError):
        Variants(table, most_bytes=100)


def test_evidence_of_odd_rows(spark):
    variants, _, _ = evidence(spark)
    table = spark.createDataFrame([(i, u.tolist()) for _, i, u in variants], "item long, u array<double>")
    u = variants[0][2].tolist()
    odd = pd.DataFrame([(1, -20.0, "0", 0.9, None), (1, -20.0, "0", 0.9, []), (1, -70.0, "0", 0.9, u), (2, -20.0, "0", 0.9, u), (1, -20.0, None, None, None), (1, -20.0, "77", 0.9, u)], columns=["rk", "level", "item", "score", "v"])
    rows = spark.createDataFrame(odd.astype(object).where(odd.notna(), None), "rk int, level double, item string, score double, v array<double>").selectExpr("*", "array(0d, 1d) as energies")
    assert [(r.accept, r.onset) for r in with_evidence(rows, Variants(table)).collect()] == [(False, True), (False, True), (None, True), (None, None), (None, True), (False, True)]
    none = with_evidence(rows, Variants(table.where("item = 77")))
    assert [r.accept for r in none.collect()] == [False, False, None, None, None, False]


def test_snr_of_steps_that_rounding_would_change(spark, tmp_path):
    """The ratio is that of the step as it is, not of the step to nine places that is shown."""
    import duckdb

    from chirplake.plans.search_queries import ORACLES, QUERIES

    random = np.random.default_rng(3)
    e = pd.DataFrame({"vec_id": range(20), "label": 0, "embedding": [(random.standard_normal(64) * 1e-5).astype("float32") for _ in range(20)]})
    e.to_parquet(tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    wanted = {r[0]: r[1:] for r in db.sql(ORACLES["quantise_roundtrip_snr"]).fetchall()}
    got = {r["vec_id"]: (r["scale"], r["snr_db"]) for r in QUERIES["quantise_roundtrip_snr"](spark, str(tmp_path)).collect()}
    assert got == wanted
