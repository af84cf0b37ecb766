"""Language identification by nearest centroid over TF-IDF vectors of letter n-grams.

Texts are lower-cased, all but letters become blanks, and byte trigrams are hashed into DIM
features: log counts times inverse document frequencies, at unit length. Document frequencies
are counted over all training rows. Each language gets a few centroids by spherical k-means,
fitted on at most `sample` training rows a language. A text takes the language of the centroid
with the greatest cosine, and is rejected where that cosine is under the centroid's own limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.llm.batches import map_texts, pieces

DIM = 1 << 11
#: Of all centroids together.
MODEL_BYTES = 256 << 20
#: Text of one piece while it is turned into vectors.
VECTOR_BYTES = 1 << 20
#: A text of fewer different features has less in common with any centroid; its limit falls with their square root.
SHORT = 64
#: What a text must have to be in a language, in the fit and in predictions: a letter, so no numeral of whatever form.
LETTERS = r"\p{L}"
LETTER = regex.compile(LETTERS)
#: Bytes of letters stay (and all of non-ASCII letters and marks), the rest become blanks.
TO_LETTERS = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def counts(texts: pa.Array) -> np.ndarray:
    """Rows of hashed trigram counts, one for each text; runs of blanks count as one, and each text has a blank at both ends."""
    lower = pc.utf8_lower(pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), " ", ""))
    lower = lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower
    n = len(lower)
    sizes = pc.binary_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in lower), np.uint8)
    b = TO_LETTERS[raw]
    row = np.repeat(np.arange(n), sizes)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep].astype(np.uint32), row[keep]
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1)
    inside = row[:-2] == row[2:]
    return np.bincount(row[:-2][inside] * DIM + h[inside], minlength=n * DIM).reshape(n, DIM)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    tf = np.log1p(counts(texts).astype(np.float32)) * idf
    return tf / np.maximum(np.linalg.norm(tf, axis=1, keepdims=True), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of `text` and, for each feature, in how many of them it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(DIM, np.int64)
        for piece in pieces(batches, "text", VECTOR_BYTES):
            total += piece.num_rows
            found += (counts(piece.column("text")) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate(([total], found)))], ["feature", "n"])

    rows = texts.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIM + 1, np.int64)
    for r in rows:
        out[r["feature"] + 1] = r["n"]
    return int(out[0]), out[1:]


def centroids(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centroids and the cosine of each row with its own. Starts are spread by farthest first."""
    starts = [0]
    for _ in range(min(k, len(x)) - 1):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    c = x[starts]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).max(axis=1)


class LanguageModel:
    def __init__(self, langs: list[str], owner: np.ndarray, cents: np.ndarray, limits: np.ndarray, idf: np.ndarray):
        self.langs, self.owner, self.cents, self.limits, self.idf = langs, owner, cents.astype(np.float32), limits, idf.astype(np.float32)

    def predict(self, texts: pa.Array) -> dict:
        letters = np.array([t is not None and LETTER.search(t) is not None for t in texts.to_pylist()], bool)
        if not self.langs:
            return {"lang_pred": pa.array(["und"] * len(texts)), "score": pa.array(np.zeros(len(texts))), "rejected": pa.array([True] * len(texts))}
        x = vectors(texts, self.idf)
        cos = x @ self.cents.T
        best = cos.argmax(axis=1)
        score = np.where(letters, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
        short = np.sqrt(np.minimum(1.0, (x > 0).sum(axis=1) / SHORT))
        names = [self.langs[self.owner[b]] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score), "rejected": pa.array(~letters | (score < self.limits[best] * short))}


def _fitted(per_lang: int, sample: int, slack: float):
    """Over the sampled vectors of one language: its centroids and the limit that they share."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mine = sorted(zip(rows["u"], rows["x"], strict=True))[:sample]
        c, cos = centroids(np.stack([np.frombuffer(v, np.float16) for _, v in mine]).astype(np.float32), per_lang)
        return pd.DataFrame({"lang": key[0], "limit": slack * float(np.percentile(cos, 1)), "cents": [c.astype(np.float32).tobytes()]})

    return run


def fit(train: DataFrame, *, id: str, text: str, lang: str, sample: int = 500, per_lang: int = 3, slack: float = 0.5) -> LanguageModel:
    """From the rows of train with a language. `sample`: rows a language at most on which centroids are fitted.

    A centroid's limit is slack times the first percentile of its language's own cosines. Null texts
    and those without a letter tell nothing of a language and are left out, so that a language may have no centroid; repeated rows count each.
    Tasks fit a language each; what comes to the driver, and goes to all tasks, is the centroids of all
    languages, per_lang * DIM numbers each. Over MODEL_BYTES of them are refused.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).rlike(LETTERS)).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(1 << 30)).alias("u"))
    most = MODEL_BYTES // (4 * DIM * per_lang)
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()
    if len(by_lang) > most:
        raise ValueError(f"over {most} languages: their centroids take over {MODEL_BYTES} bytes")
    total, found = document_frequencies(rows)
    idf = np.log((1 + total) / (1 + found)) + 1.0
    if not by_lang:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, DIM)), np.zeros(0), idf)
    share = F.create_map(*[F.lit(v) for r in by_lang for v in (r["lang"], int(min(1.0, 1.2 * sample / r["n"]) * (1 << 30)))])
    chosen = rows.where(F.col("u") < share[F.col("lang")])

    def run(texts: pa.Array) -> dict:
        return {"x": pa.array([v.tobytes() for v in vectors(texts, idf).astype(np.float16)], pa.binary())}

    drawn = map_texts(chosen, "text", ["lang", "u"], "x binary", run, VECTOR_BYTES)
    fitted = sorted(drawn.groupBy("lang").applyInPandas(_fitted(per_lang, sample, slack), "lang string, limit double, cents binary").collect())
    cents = [np.frombuffer(r["cents"], np.float32).reshape(-1, DIM) for r in fitted]
    owner = np.repeat(np.arange(len(fitted)), [len(c) for c in cents])
    return LanguageModel([r["lang"] for r in fitted], owner, np.concatenate(cents), np.array([r["limit"] for r in fitted])[owner], idf)


def identify(df: DataFrame, model: LanguageModel, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The carry columns with lang_pred (`und` for null texts and those without a letter), score (0 to 1) and rejected.

    The prediction is made from the text alone. Equal texts get equal results; long texts are
    taken whole. Without any training language everything is `und` and rejected. Columns of df with
    one of the three names can't be carried.
    """
    return map_texts(df, text, [c for c in carry if c.lower() not in ("lang_pred", "score", "rejected")], "lang_pred string, score double, rejected boolean", model.predict, VECTOR_BYTES)


def held_out(id: Column) -> Column:
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
