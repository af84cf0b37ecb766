"""Near copies against the exact Jaccard of five-word shingles."""

import itertools

import numpy as np
import pytest

from chirplake.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def pairs(low, high, n, seed):
    """Pairs of 300-word texts, the second with some words changed, whose Jaccard is in the range."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        a = [f"w{k}" for k in rng.integers(0, 50_000, 300)]
        b = list(a)
        for k in rng.choice(300, rng.integers(3, 22), replace=False):
            b[k] = f"x{rng.integers(0, 50_000)}"
        if low <= jaccard(" ".join(a), " ".join(b)) < high:
            out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("low, high, copies", [(0.8, 0.85, True), (0.85, 0.9, True), (0.7, 0.79, False)])
def test_recall_and_precision_by_jaccard(spark, low, high, copies):
    made = pairs(low, high, 200, 1)
    rows = [(2 * k + j, t) for k, p in enumerate(made) for j, t in enumerate(p)]
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    removed = sum(2 * k + 1 not in left for k in range(200))
    assert all(2 * k in left for k in range(200))
    assert removed >= 197 if copies else removed == 0


def test_similar_links_span_the_exact_components():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40):
        base = rng.integers(0, 1 << 60, (3, 60)).astype(np.uint64)
        sets = []
        for _ in range(n):
            x = base[rng.integers(3)].copy()
            x[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 60)
            sets.append(np.unique(x))
        label = list(range(n))
        got = list(range(n))

        def join(labels, a, b):
            return [labels[a] if x == labels[b] else x for x in labels]

        for a, b in itertools.combinations(range(n), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                label = join(label, a, b)
        for a, b in simhash.similar_links(sets, 0.8):
            got = join(got, a, b)
        same = lambda x: [[x[a] == x[b] for b in range(n)] for a in range(n)]
        assert same(label) == same(got)


def test_known_groups_are_not_compared_again():
    x = np.arange(100, dtype=np.uint64)
    sets = [x, x + 5, x + 1000, x + 1004, x + 12]  # 0-1 and 2-3 and 1-4 are similar
    labels = np.array([0, 1, 2, 2, 0])
    assert list(simhash.similar_links(sets, 0.8, np.array([0, 0, 2, 2, 4]))) == [(1, 4)]
    assert {tuple(sorted(p)) for p in simhash.similar_links(sets, 0.8, labels)} <= {(0, 1), (1, 4)}


def test_stars_and_groups_split_over_blocks_give_the_exact_components(spark, monkeypatch):
    """Chains whose ends aren't similar, hot pivots, tiny stars and blocks: the rows left are those of brute force."""
    from chirplake.llm import store

    monkeypatch.setattr(simhash, "STAR", 3)
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(store, "HOT_ROWS", 4)
    rng = np.random.default_rng(4)
    rows = []
    for family in range(6):
        words = [f"f{family}w{k}" for k in range(120)]
        for step in range(14):
            if step % 5 == 4:
                words[rng.integers(120)] = f"f{family}s{step}"
            edited = list(words)
            edited[step * 7 % 120] = f"f{family}e{step}"
            rows.append((len(rows), " ".join(edited)))
    rows += [(500 + k, f"short text {k} of its own") for k in range(10)] + [(600, None), (601, ""), (602, "  ")]
    label = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        p, q = rows[a][1], rows[b][1]
        if p and q and len(p.split()) > 5 and len(q.split()) > 5 and jaccard(p, q) >= 0.8:
            label = [label[a] if x == label[b] else x for x in label]
    words = [k for k, r in enumerate(rows) if r[1] and r[1].strip()]
    wanted = {min(rows[k][0] for k in words if label[k] == g) for g in {label[k] for k in words}} | {600}
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in left} == wanted


def test_blocks_of_a_large_component_link_what_one_cell_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 800)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*words[:199], f"end{k}"])) for k in range(30)]
    left = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in left] == [0]


def test_rows_are_kept_by_bits(spark):
    """Ids at the edges of bitmaps and of partitions; rows aren't shuffled."""
    from chirplake.llm.store import kept_by_bits

    ids = [0, 1, 2, 7, 8, 9, 32768, 32769, 32770, 65536, 65537, 1 << 33, (1 << 33) + 1, (1 << 33) + 32768, (5 << 33) + 77]
    df = spark.createDataFrame([(k, "x" * 9) for k in ids], "_row long, text string")
    wanted = ids[::2] + [(9 << 33) + 5, 32771]
    kept = kept_by_bits(df, spark.createDataFrame([(k,) for k in wanted], "r long"), "_row")
    assert sorted(r["_row"] for r in kept.collect()) == ids[::2] and kept.columns == df.columns
    none = kept_by_bits(df, spark.createDataFrame([], "r long"), "_row")
    assert none.count() == 0
