"""Quality rules: counts on each document, and lines that too many documents of a host share.

Lines are normalised and hashed; for each host and hash the documents that hold the line are
counted, each once. Lines above the limit are removed, and a document that keeps too few of its
words is rejected. Copies of a document are documents: to keep one of them, drop near copies first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.batches import map_texts
from chirplake.llm.store import frozen, joined

SYMBOLS = b"#*$%&|<>"
#: Upper-case A-Z to lower case and every digit to 0.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of `width` words that are found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    windows = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        windows = (windows ^ ids[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        windows ^= windows >> np.uint64(29)
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    found = np.zeros(len(windows), bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= found
    return int(covered.sum())


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of each line: the hash and the words, 0 and 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text or "") - (len(raw) - sum(map(len, words)))
    split = [(line, line.split()) for line in raw.split(b"\n")]
    lines = [(xxhash.xxh64_intdigest(b" ".join(parts).translate(FOLD)) - (1 << 63) if parts else 0, len(parts)) for line, parts in split]
    with_words = [line for line, parts in split if parts]
    return len(words), word_chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(with_words) - len(set(with_words)), repeated_words(words), lines


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(df: DataFrame, text: str, carry: list[str]) -> DataFrame:
    def work(texts: pa.Array) -> dict:
        found = [measure(t) for t in texts.to_pylist()]
        out = {n: pa.array([f[k] for f in found], pa.int64()) for k, n in enumerate(COUNTS)}
        out["_hashes"] = pa.array([[h for h, _ in f[5]] for f in found], pa.list_(pa.int64()))
        out["_sizes"] = pa.array([[n for _, n in f[5]] for f in found], pa.list_(pa.int32()))
        return out

    return map_texts(df, text, carry, ", ".join(f"{n} long" for n in COUNTS) + ", _hashes array<long>, _sizes array<int>", work)


def line_quality(df: DataFrame, *, text: str = "text", host: str = "source", carry: list[str], max_docs: int = 20, least_left: float = 0.5, left: str | None = None) -> DataFrame:
    """The carry columns with the counts, base_failed, removed_words and kept; with `left`, also the text without the removed lines, under that name.

    A line is removed in the documents of a host where more than max_docs documents of that
    host have it; a document that keeps under least_left of its words is depleted. Null and empty
    texts have no words and fail the base rule (what is left of null is null); null and empty hosts are one host; equal rows
    are documents of their own with equal results. Columns of df with a name that is added here are replaced. An empty table gives an empty one.
    """
    added = {*COUNTS, "removed_words", "base_failed", "kept", *([left.lower()] if left else [])}
    kept = [c for c in carry if c.lower() not in added]
    whole = [F.col(text).alias("_whole")] if left else []
    rows = df.select(F.struct(*kept).alias("_carried"), F.col(text).alias("_text"), *whole, F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host"))
    work = frozen(measured(rows, "_text", ["_carried", "_host", *(["_whole"] if left else [])]).withColumn("_row", F.monotonically_increasing_id()), "lines")
    once = F.array_distinct(F.filter(F.arrays_zip(F.col("_hashes").alias("h"), F.col("_sizes").alias("n")), lambda x: x["n"] > 0)["h"])
    counts = work.select("_host", F.explode(once).alias("h")).groupBy("_host", "h").agg(F.count("*").alias("docs"))
    common = frozen(counts.where(F.col("docs") > max_docs), "common-lines")
    lines = work.select("_row", "_host", F.posexplode(F.arrays_zip(F.col("_hashes").alias("h"), F.col("_sizes").alias("n"))).alias("nth", "line"))
    lines = lines.where("line.n > 0").select("_row", "_host", "nth", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    # Common lines have `docs` rows at least: what is hot is among them.
    found = joined(lines, common, ["_host", "h"], "docs", work.agg(F.sum(F.size("_hashes"))).first()[0] or 0)
    removed = found.groupBy("_row").agg(F.sum("n").alias("removed_words"), *([F.collect_set("nth").alias("_gone")] if left else []))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = (
        work.join(removed, "_row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")))
    )
    if left:
        lines_left = F.array_join(F.filter(F.split("_whole", "\n", -1), lambda _, k: ~F.array_contains("_gone", k)), "\n")
        out = out.withColumn("_left", F.when(F.col("_gone").isNull(), F.col("_whole")).otherwise(lines_left))
    return out.select(*[F.col("_carried")[c].alias(c) for c in kept], *COUNTS, "removed_words", "base_failed", "kept", *([F.col("_left").alias(left)] if left else []))
