"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import base64
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chirplake.llm import lang_id, pieces
from chirplake.llm.line_rules import line_quality
from chirplake.llm.mixing import mix_sources, symbol_quality, word_count
from chirplake.llm.ngram_lm import score_texts
from chirplake.llm.phrases import compare_with_next, edited
from chirplake.llm.queries import PIECE_MODEL
from chirplake.llm.sharding import uniform_shards
from chirplake.llm.simhash import drop_near_copies, fingerprint, fingerprinted, near_components
from chirplake.llm.surrogates import replace_pii
from chirplake.llm.warc import read_warc, write_warc

LONG = " ".join(f"word{k}" for k in range(60_000))
ROWS = [
    (1, "the cat sat on the mat and the dog ran to the old house by the sea", "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (None, "der hund lief durch den wald und die katze schlief auf dem dach", "de", "b"),
    (4, LONG, "en", "a"),
    (5, "  \n\n\t ", None, "a"),
    (6, "the cat sat on the mat and the dog ran to the old house by the sea", "en", None),
    (6, "the cat sat on the mat and the dog ran to the old house by the sea", "en", None),
    (7, "mail a.b@x.org now\nnaïve 日本 \U0001f600", "en", "c"),
    (None, None, None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("shard", "slot", "size", "taken", "fp", "fp0", "score", "kept", "ids", "n_tokens", "n_entities", "row", "key", "content", "bucket"):
        df = df.withColumn(c, F.lit("mine"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id = -1")


def test_sharding(docs, none):
    out = uniform_shards(docs, 4).collect()
    assert len(out) == 10 and sorted(Counter(r.shard for r in out).values()) == [2, 2, 3, 3]
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out))) for s in range(4))
    assert Counter(r.text for r in out) == Counter(t for _, t, _, _ in ROWS) and all(r.size == "mine" for r in out)
    assert uniform_shards(none, 4).count() == 0


def test_language(docs, none):
    model = lang_id.fit(docs, id="doc_id", text="text", lang="lang")
    out = lang_id.identify(docs, model, carry=["doc_id", "text", "score"]).collect()
    assert len(out) == 10
    for r in out:
        assert (r.lang_pred == "und") == (r.text is None or not lang_id.LETTER.search(r.text)) and 0 <= r.score <= 1
        assert r.lang_pred in ("en", "de", "und")
    assert {r.lang_pred for r in out if r.text and r.text.startswith("der hund")} == {"de"}
    empty = lang_id.fit(none, id="doc_id", text="text", lang="lang")
    assert {r.lang_pred for r in lang_id.identify(docs, empty, carry=[]).collect()} == {"und"}
    assert lang_id.identify(none, model, carry=["doc_id"]).count() == 0


def test_simhash(docs, none):
    prints = fingerprinted(docs, carry=["doc_id", "text"])
    out = near_components(prints.withColumn("component_id", F.lit("mine")), "doc_id").collect()
    assert len(out) == 10 and all(r.fp % (1 << 64) == fingerprint(r.text) for r in out)
    assert {r.component_id for r in out if r.doc_id in (2, 3, 5)} == {2} and {r.component_id for r in out if r.doc_id in (1, 6)} == {1}
    assert near_components(fingerprinted(none), "doc_id").count() == 0
    left = drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in left) == [(0, "der"), (1, "the"), (2, ""), (4, "wor"), (7, "mai")]
    assert set(left[0].asDict()) == set(docs.columns) and drop_near_copies(none).count() == 0


def test_pieces(docs, none):
    import pathlib

    model = pathlib.Path(PIECE_MODEL).read_bytes()
    out = pieces.encode(docs, model, carry=["doc_id", "text", "row", "ids"])
    for r in out.collect():
        assert (r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) and r.round_trip in (None, True)
    texts = pieces.decode(out, model, carry=["row"])
    assert Counter(r.text for r in texts.collect()) == Counter(t for _, t, _, _ in ROWS)
    assert pieces.encode(none, model, carry=[]).count() == 0


def mixed(df, **more):
    return mix_sources(df, source="source", size=word_count(F.col("text")), quality=symbol_quality(F.col("text")), identity=["doc_id"], carry=["doc_id", "source", "taken"], **more)


def test_mixing(docs, none):
    out = mixed(docs).collect()
    assert len(out) == 10 and sorted(map(str, out)) == sorted(map(str, mixed(docs).collect()))
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        assert {r.source_size for r in mine} == {sum(r.size for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 1
    assert sum({r.source: r.target for r in out}.values()) == pytest.approx(1.5 * sum(r.size for r in out))
    assert mixed(none).count() == 0


def test_phrases(docs, none):
    out = {r.edited_sha256: r for r in compare_with_next(docs, rows_per_bucket=2).collect()}
    rows = compare_with_next(docs, rows_per_bucket=2).collect()
    assert len(rows) == 10
    ids = sorted({r.doc_id for r in rows if r.doc_id}, reverse=True)
    assert ids == [7, 6, 5, 4, 3, 2, 1]
    by_id = {i: t or "" for i, t, _, _ in ROWS if i}
    for a, b in zip(ids, ids[1:], strict=False):
        if a != 6:
            assert hashlib.sha256(edited(by_id[a], by_id[b]).encode()).hexdigest() in out
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(prints[len(ROWS[0][1])]) == 1
    alone = compare_with_next(docs.where("doc_id = 1")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1 and compare_with_next(none).count() == 0


def test_line_rules(docs, none):
    out = line_quality(docs, carry=["doc_id", "row"]).collect()
    assert len(out) == 10 and all(r.base_failed or r.n_words >= 50 for r in out)
    assert {r.n_words for r in out if r.doc_id == 4} == {60_000} and sum(r.kept for r in out) == 1
    assert line_quality(none, carry=["doc_id"]).count() == 0


def test_lm(docs, none):
    out = score_texts(docs, id="doc_id", text="text", train=F.col("doc_id") != 7).collect()
    assert len(out) == 10 and all(r.base_score < 0 and r.score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 5)} == {1} and {r.held_out for r in out if r.doc_id in (7, None)} == {True}
    untrained = score_texts(docs, id="doc_id", text="text", train=F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) for r in untrained)
    assert score_texts(none, id="doc_id", text="text", train=F.lit(True)).count() == 0


def test_surrogates(docs, none):
    out = replace_pii(docs, key="k", carry=["doc_id", "row", "content", "n_entities"]).collect()
    assert len(out) == 10 and sum(r.n_entities for r in out) == 1
    changed = [r.text for r in out if r.n_entities]
    assert changed[0].startswith("mail ") and "a.b@x.org" not in changed[0] and changed[0].endswith("now\nnaïve 日本 \U0001f600")
    assert Counter(r.text for r in out if not r.n_entities) == Counter(t for i, t, _, _ in ROWS if i != 7)
    assert replace_pii(none, key="k", carry=["doc_id"]).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>same</p>", "x"), (9, None, "<p>same</p>", "x"), (2, "u", None, "x"), (3, "u", "", "x"), (None, "u", "other", "x"), (4, "u", "z" * 300_000 + "\x1f\x08", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    write_warc(pages, str(tmp_path / "w"))
    for split in (37, 1000, 1 << 25):
        got = {r.record_id.removeprefix("urn:page:"): r for r in read_warc(spark, str(tmp_path / "w"), split).where("warc_type <> 'warcinfo'").collect()}
        assert set(got) == {"1", "9", "2", "3", "", "4"} and all(r.fault is None for r in got.values())
        assert got["1"].warc_type == "revisit" and got["1"].refers_to == "urn:page:9" and got["2"].refers_to == "urn:page:3"
        assert bytes(got["4"].payload) == rows[5][2].encode() and got["1"].payload_bytes == 11
        assert got["1"].payload_digest == base64.b32encode(hashlib.sha1(b"<p>same</p>").digest()).decode()
    write_warc(pages.where("page_id = -1"), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
