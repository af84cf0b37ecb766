"""Scores where training and held-out texts are in different chunks."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chirplake.llm import ngram_lm


def test_context_without_known_successors_in_its_chunk(spark):
    trained = [(1, "rareword follows here"), (2, "rareword goes there")]
    held = [(3, "rareword unseen")]
    schema = "id long, text string"
    both = spark.createDataFrame(spark.sparkContext.parallelize([*trained, *held], 3), schema)  # each text in a chunk of its own
    out = {r.id: r for r in ngram_lm.score_texts(both, id="id", text="text", train=F.col("id") < 3).collect()}
    one = {r.id: r for r in ngram_lm.score_texts(both.coalesce(1), id="id", text="text", train=F.col("id") < 3).collect()}
    n, v, d = 8, 6, ngram_lm.DISCOUNT
    base = lambda c: (c + 0.5) / (n + 0.5 * (v + 1))
    # start -> rareword (2 of 2), rareword -> unseen (2 successors of 2 mentions), unseen -> end (no context)
    p = [(2 - d) / 2 + d / 2 * base(2), d * 2 / 2 * base(0), base(2)]
    assert out[3].score == pytest.approx(sum(map(math.log10, p)), rel=1e-3)
    assert {i: r.score for i, r in out.items()} == pytest.approx({i: r.score for i, r in one.items()})


def test_bigrams_of_several_chunks_are_searched_once(monkeypatch):
    rng = np.random.default_rng(1)
    keys = np.sort(rng.choice(1 << 30, 200, replace=False))
    sizes, totals = np.full(200, 50), np.full(200, 100_000)
    words = np.concatenate([np.sort(rng.choice(np.arange(5_000), 50, replace=False)) for _ in keys])
    counts = rng.integers(0, 4, len(words))
    asked = pd.DataFrame([(0, k, *map(ngram_lm.pack, (keys, totals, sizes, words, counts))) for k in range(4)], columns=["shard", "chunk", "keys", "totals", "sizes", "words", "counts"])
    looked = []
    get = ngram_lm.EliasFano.get
    monkeypatch.setattr(ngram_lm.EliasFano, "get", lambda self, i: looked.append(len(i)) or get(self, i))
    got = ngram_lm._answer_bigrams((0,), asked)
    # Three values a context, and one a bigram that may be there; four chunks ask for them.
    assert sum(looked) <= 3 * len(keys) + len(words)
    p = np.maximum(4 * counts - ngram_lm.DISCOUNT, 0) / 100_000
    for r in got.itertuples():
        assert (ngram_lm.unpack(r.a) == np.where(counts > 0, ngram_lm.encode_log(np.maximum(p, 1e-9)), 0)).all()
        assert (ngram_lm.unpack(r.b) == (counts > 0).reshape(200, 50).sum(axis=1)).all()
    assert got["chunk"].tolist() == [0, 1, 2, 3]
