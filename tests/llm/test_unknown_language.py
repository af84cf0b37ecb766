"""An unknown language is rejected although labelled rows hold nulls and texts without a letter."""

import numpy as np

from chirplake.llm import lang_id


def made(letters, n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list(letters), rng.integers(3, 8))) for _ in range(300)]
    return [" ".join(rng.choice(words, 80)) for _ in range(n)]


def test_letterless_labelled_rows_do_not_lower_the_limit(spark):
    blank = [None, "", "  ", "123 456", "\U0001f600 !"]
    rows = [(k, t, "en") for k, t in enumerate(made("abcdefgh", 60, 1) + blank)] + [(100 + k, t, "xx") for k, t in enumerate(made("ijklmnop", 60, 2) + blank)]
    rows += [(200 + k, t, "zz") for k, t in enumerate(blank)]  # a language without any text
    model = lang_id.fit(spark.createDataFrame(rows, "id long, text string, lang string"), id="id", text="text", lang="lang")
    assert set(model.langs) == {"en", "xx"} and (model.limits > 0.05).all() and (np.linalg.norm(model.cents, axis=1) > 0.99).all()
    texts = [(0, t) for t in made("abcdefgh", 5, 1)] + [(1, t) for t in made("qrstuvwxyz", 20, 3)]
    out = lang_id.identify(spark.createDataFrame(texts, "unknown int, text string"), model, carry=["unknown"]).collect()
    assert [r.rejected for r in out] == [bool(r.unknown) for r in out]


def test_what_has_no_letter_is_undetermined(spark):
    train = spark.createDataFrame([(k, t, l) for k, (t, l) in enumerate([("the cat sat on the mat", "en"), ("der hund lief durch den wald", "de")] * 10)], "doc_id long, text string, lang string")
    model = lang_id.fit(train, id="doc_id", text="text", lang="lang")
    texts = ["½ ²³", "①②", "Ⅷ", "٣ 4", "🙂 !?", "", None, "ª", "ñ"]
    out = lang_id.identify(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), model, carry=["doc_id"]).collect()
    assert sorted(r.doc_id for r in out if r.lang_pred == "und") == [0, 1, 2, 3, 4, 5, 6]
