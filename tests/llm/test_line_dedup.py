"""Line deduplication against a plain count, with filters too small and too many lines to broadcast, and its edge cases."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chirplake.llm.line_dedup import dedup_lines, digest, keys, twice_filter

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, least_docs, least_chars=1, first=False):
    """(n_lines, n_dropped, sum, left) of rows (id, text)."""
    own = [[lower(line.strip(BLANK)) for line in (t or "").split("\n")] for _, t in rows]
    docs = Counter(k for ks in own for k in set(ks) if len(k) >= least_chars)
    order = lambda i: (1 << 63) - 1 if i is None else i
    firsts = {k: min(order(i) for (i, _), ks in zip(rows, own) if k in ks) for k in docs}
    out = []
    for (i, text), ks in zip(rows, own):
        kept, had = [], set()
        for line, k in zip((text or "").split("\n"), ks):
            if docs[k] < least_docs or first and firsts[k] == order(i) and k not in had:
                kept.append(line)
            had.add(k)
        left = "\n".join(kept)
        out.append((i, len(ks), len(ks) - len(kept), hashlib.sha256(left.encode()).hexdigest(), None if text is None else left))
    return sorted(out, key=repr)


def rows_of(n=120):
    random = np.random.default_rng(0)
    lines = [f"  Line {k} of the COMMON kind\t" for k in range(30)] + ["x", "", " \r", "É", "é"]
    made = [(k, "\n".join([*random.choice(lines, random.integers(0, 9)).tolist(), *(f"own {k} {j}" for j in range(3))])) for k in range(n)]
    return made + [(None, None), (n, ""), (3, made[3][1]), (3, made[3][1]), (None, "own 5 1\n\nline 1 of the common kind"), (n + 1, "é\nX\n" * 2 + "w " * 200_000)]


@pytest.mark.parametrize("least_docs, least_chars, first", [(10, 1, False), (2, 3, False), (2, 1, True)])
@pytest.mark.parametrize("small", [{}, {"filter_bytes": 64}, {"most_broadcast": 0}])
def test_equals_plain_count(spark, least_docs, least_chars, first, small):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, text string").withColumn("N_Lines", F.lit("mine")).withColumn("digest", F.lit("mine")).repartition(5)
    out = dedup_lines(df, carry=["id", "digest", "N_Lines"], least_docs=least_docs, least_chars=least_chars, first_by="id" if first else None, left="left", **small)
    assert out.columns == ["id", "digest", "n_lines", "n_dropped", "kept_sha256", "left"]
    assert sorted(((r.id, r.n_lines, r.n_dropped, r.kept_sha256, r.left) for r in out.collect()), key=repr) == plain(rows, least_docs, least_chars, first)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert dedup_lines(df, carry=["id"]).count() == 0 and dedup_lines(df, carry=["id"], most_broadcast=-1).count() == 0
    alone = spark.createDataFrame([(1, None)] * 12, "id long, text string")
    assert {tuple(r) for r in dedup_lines(alone, carry=["id"]).collect()} == {(1, 1, 0, hashlib.sha256(b"").hexdigest())}


def test_the_filter_knows_all_repeats_and_few_others(spark):
    rows = rows_of(2000)
    own = [set(keys((t or "").encode())) for _, t in rows]
    docs = Counter(k for ks in own for k in ks if k)
    df = spark.createDataFrame(rows, "id long, _text string").repartition(7)
    known = twice_filter(df, 1, 1 << 20)
    assert all(k in known for k, n in docs.items() if n > 1)
    once = [k for k, n in docs.items() if n == 1]
    assert sum(k in known for k in once) < 0.05 * len(once)
    assert all(known.known(np.array([xxhash.xxh3_64_intdigest(k)], np.uint64))[0] == (k in known) for k in once[:50])
    assert digest(b"a") != digest(b"b")
