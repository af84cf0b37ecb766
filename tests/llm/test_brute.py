"""The registered queries against brute force, the sentencepiece library, held-out accuracy or DuckDB, on the smallest tables."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import sentencepiece

from chirplake.llm import ngram_lm, phrases, pieces, simhash
from chirplake.llm.queries import ORACLES, PIECE_MODEL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet'").fetchall()


def components(n, linked):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(n), 2):
        if linked(a, b):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(k) for k in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, wanted = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    plain = lambda df: sorted(str([None if pd.isna(v) else float(v) if isinstance(v, (int, float, np.number)) else v for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert plain(got) == plain(wanted)


def test_sharding_digests(spark, docs):
    out = {r.doc_id: r for r in QUERIES["op1_sharding"](spark, SF).collect()}
    for i, t, *_ in docs:
        assert out[i].size == len(t.encode()) + 8 and out[i].text_crc32 == zlib.crc32(t.encode())
    counts = Counter(r.shard for r in out.values())
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1


def test_communication_matrix_has_the_hypergeometric_mean(spark):
    from chirplake.llm.sharding import communication_matrix

    sizes = spark.createDataFrame([(k, 1000 * (k + 1)) for k in range(9)], "id long, m long")
    total, runs = np.zeros((9, 4)), 12
    for seed in range(runs):
        rows = {r.id: r.counts for r in communication_matrix(sizes, 4, seed).collect()}
        m = np.array([rows[k] for k in range(9)])
        assert (m.sum(axis=1) == [1000 * (k + 1) for k in range(9)]).all() and (m.sum(axis=0) == 11250).all()
        total += m
    expected = np.array([250.0 * (k + 1) for k in range(9)])[:, None]
    assert (np.abs(total / runs - expected) < 6 * np.sqrt(expected / runs)).all() and np.std(total[8]) > 0


def test_language_accuracy(spark, docs):
    langs = {d[0]: d[2] for d in docs}
    out = [r for r in QUERIES["op2_lang_id"](spark, SF).collect() if r.held_out]
    assert {r.doc_id for r in out} == {i for i in langs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([langs[r.doc_id] == r.lang_pred for r in out]) > 0.95


def test_simhash_components(spark, docs):
    ids = sorted(d[0] for d in docs)
    text = {d[0]: d[1] for d in docs}
    prints = [simhash.fingerprint(text[i]) for i in ids]
    wanted = components(len(ids), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    for r in QUERIES["op3_simhash"](spark, SF).collect():
        k = ids.index(r.doc_id)
        assert r.fingerprint == f"{prints[k]:016x}" and r.component_id == ids[wanted[k]]


@pytest.mark.parametrize("n", [1, 2, 60, 500])
def test_gray_index(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 2**63, max(n // 5, 1), dtype=np.uint64)[rng.integers(0, max(n // 5, 1), n)]
    for _ in range(5):
        x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    cells, rest = rng.integers(0, 3, n), rng.integers(0, 4, n).astype(np.uint64)
    for most, second, both in ((4, None, 0), (6, rest, 7)):
        a, b = simhash.spanning_links(cells, x, most, second, both)
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        got = [root.get(k, k) for k in range(n)]

        def near(i, j, second=second, most=most, both=both):
            d = int(x[i] ^ x[j]).bit_count()
            return cells[i] == cells[j] and d <= most and (second is None or d + int(rest[i] ^ rest[j]).bit_count() <= both)

        wanted = components(n, near)
        assert {tuple(sorted(k for k in range(n) if got[k] == g)) for g in set(got)} == {tuple(sorted(k for k in range(n) if wanted[k] == w)) for w in set(wanted)}


def test_wide_fingerprints_drop_near_copies(spark, docs):
    base = [(i, t) for i, t, *_ in docs if len(t.split()) > 150][:20]
    edited = [(1000 + i, " ".join([*t.split()[:-1], "changed"])) for i, t in base]
    left = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame([*base, *edited], "doc_id long, text string")).collect()}
    assert not left & {i for i, _ in edited}


def test_pieces_equal_the_library(docs):
    model = Path(PIECE_MODEL).read_bytes()
    v, sp = pieces.Vocabulary(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [d[1] for d in docs] + ["", " ", "  a  b \n\n c", "\n\nx ", "▁", "a▁b", "\U0001f600\t\0 <s> <0x0A>", "a" * 900, "ab" * 500, " " * 70 + "x", "日本語"]
    wanted = sp.encode(texts)
    assert pieces.encode_all(v, pa.array(texts)).to_pylist() == wanted
    for t, ids in zip(texts[-40:], wanted[-40:], strict=True):
        encoder, got = pieces.StreamingEncoder(v), []
        blank = pieces.BLANK + t.replace(" ", pieces.BLANK) if t else ""
        for k in range(0, len(blank), 7):
            got += encoder.feed(blank[k : k + 7])
            assert len(encoder.chars) < 3 * pieces.COMMIT_EVERY
        assert got + encoder.finish() == ids and pieces.decode_ids(v, ids) == t.replace(pieces.BLANK, " ")


def test_phrases(spark, docs):
    order = sorted(docs, reverse=True)
    out = {r.doc_id: r for r in QUERIES["op6_phrases"](spark, SF).collect()}
    for (i, t, *_), (_, following, *_) in zip(order, [*order[1:], order[0]], strict=True):
        e = phrases.edited(t, following)
        a, b, c = (phrases.signatures([x])[0] for x in (t, e, following))
        r = out[i]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.fingerprint == a.astype(">u4").tobytes().hex()
        assert r.near_edited == phrases.likeness(a, b) and r.near_next == phrases.likeness(a, c)
    long = max((d[1] for d in docs), key=len)
    a, b = phrases.signatures([long, "shifted" + long])
    assert phrases.likeness(a, b) > 0.9


def test_scores(spark, docs):
    tokens = {i: t.encode().lower().split() + [b""] for i, t, *_ in docs}
    train = [w for i, w in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for ws in train for w in ws)
    pairs = Counter(p for ws in train for p in zip([None, *ws[:-1]], ws, strict=True))
    context, follow = Counter(), Counter(h for h, _ in pairs)
    for (h, _), n in pairs.items():
        context[h] += n
    n, v, d = sum(c.values()), len(c), ngram_lm.DISCOUNT
    for r in QUERIES["op8_lm_scoring"](spark, SF).collect():
        ws = tokens[r.doc_id]
        base = [(c[w] + 0.5) / (n + 0.5 * (v + 1)) for w in ws]
        p = [max(pairs[h, w] - d, 0) / context[h] + d * follow[h] / context[h] * u if context[h] else u for h, w, u in zip([None, *ws[:-1]], ws, base, strict=True)]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(map(math.log10, base))) and r.score == pytest.approx(sum(map(math.log10, p)), rel=1e-3)


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (1, 1 << 50), (1000, 50), (5000, 1 << 40)):
        values = np.sort(rng.integers(0, top, n))
        ef = ngram_lm.EliasFano.of(values)
        assert (ef.get(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top + 5, 50)])
        assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
        begin = rng.integers(0, n + 1, len(asked))
        end = np.minimum(begin + rng.integers(0, 30, len(asked)), n)
        wanted = [a + int(np.searchsorted(values[a:b], x)) for a, b, x in zip(begin, end, asked, strict=True)]
        assert ef.successor(asked, begin, end).tolist() == wanted


def test_surrogates(spark, docs):
    out = {r.doc_id: r for r in QUERIES["op9_surrogates"](spark, SF).collect()}
    private = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d+\) \d+-\d+|\b\d{16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|AKIA\w{16}|(?<=password=)\w+|(?<=token = \")\w+")
    given: dict[str, str] = {}
    for i, t, *_ in docs:
        old, new = private.findall(t), private.findall(out[i].text)
        assert private.sub("#", t) == private.sub("#", out[i].text) and len(old) == len(new)
        for a, b in zip(old, new, strict=True):
            assert a != b and given.setdefault(a, b) == b
    assert given and len(set(given.values())) == len(given) and not set(given) & set(given.values())


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.frozen(stage(spark, kept, SF), f"test-{name}")
        counts[name] = kept
        if name != "encoding":
            assert sorted(kept.columns) == sorted(docs.columns)
    assert counts["language"].count() == docs.count()
    rows = counts["language"].select("doc_id", "text").collect()
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()) for r in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    wanted = components(len(rows), alike)
    smallest = {}
    for r, w in zip(rows, wanted, strict=True):
        smallest[w] = min(smallest.get(w, r.doc_id), r.doc_id)
    assert {r.doc_id for r in counts["near_copies"].collect()} == set(smallest.values())
    assert all(r.round_trip for r in counts["encoding"].collect()) and counts["encoding"].count() == counts["mixture"].count()
