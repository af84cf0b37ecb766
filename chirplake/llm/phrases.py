"""Document fingerprints by locally consistent parsing.

A text's symbols are cut into phrases at places that only their neighbours decide: runs of one
symbol are folded, deterministic coin tossing reduces the symbols to labels below 6 that differ
from their neighbours, and the label's local maxima begin phrases. A phrase is named by a hash of
its symbols, and the names are parsed again, level by level, until one is left. Equal substrings
thus share the names of all phrases in their interior, wherever they stand. A fingerprint keeps
the K smallest of the hashed names of the levels from LEAST_LEVEL up; two fingerprints estimate
the Jaccard likeness of the texts' phrases. The work grows with the text's length, whatever it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 64
LEAST_LEVEL = 2
#: Rounds of coin tossing that take 64-bit names to labels below 6.
ROUNDS = 4
#: Code points that are parsed together; a longer text is parsed alone.
PARSE_CHARS = 1 << 20


def _tosses() -> np.ndarray:
    """For labels a and b below 128 at a * 128 + b: twice the lowest bit in which they differ, plus a's bit there."""
    a, b = np.arange(128)[:, None], np.arange(128)[None, :]
    lowest = np.argmax(((a ^ b)[..., None] >> np.arange(8)) & 1, axis=-1)
    return (2 * lowest + ((a >> lowest) & 1)).astype(np.uint8).ravel()


TOSS = _tosses()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _next_level(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the phrases of each document's symbols, and the phrases' documents."""
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    heads = np.flatnonzero(first | np.concatenate(([True], x[1:] != x[:-1])))
    runs = np.diff(np.concatenate((heads, [len(x)]))).astype(np.uint64)
    x, doc, first = x[heads], doc[heads], first[heads]
    x = np.where(runs > 1, _mix(x + runs * np.uint64(0xD6E8FEB86659FD93)), x)
    before = np.concatenate((x[:1], x[:-1]))
    before[first] = ~x[first]
    apart = x ^ before
    lowest = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1))
    lowest = np.minimum(lowest, np.uint8(63))  # equal names of different symbols: one in 2^64
    label = 2 * lowest + ((x >> lowest) & np.uint64(1)).astype(np.uint8)
    for _ in range(ROUNDS - 1):
        before = np.concatenate((label[:1], label[:-1]))
        before[first] = label[first] ^ 1
        label = TOSS[label.astype(np.uint16) << 7 | before]
    label = label.astype(np.int8)
    last = np.concatenate((first[1:], [True]))
    left, right = np.concatenate((label[:1], label[:-1])), np.concatenate((label[1:], label[-1:]))
    left[first], right[last] = 99, -1
    # None begins right behind a text's first one, so that every text with several symbols gets shorter.
    second = np.concatenate(([False], first[:-1]))
    begins = np.flatnonzero(first | ((label > left) & (label > right) & ~second))
    sizes = np.diff(np.concatenate((begins, [len(x)])))
    place = (np.arange(len(x)) - np.repeat(begins, sizes)).astype(np.uint64)
    names = np.add.reduceat(_mix(x + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), begins)
    names = np.where(sizes > 1, _mix(names + sizes.astype(np.uint64)), x[begins])
    return names, doc[begins]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """For each text the K smallest 32-bit hashes of its phrase names, ascending; none for an empty text."""
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    x = _mix(np.frombuffer(raw, np.uint32).astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    names, docs = [], []
    level = 0
    while len(x):
        x, doc = _next_level(x, doc)
        level += 1
        done = np.ones(len(x), bool)
        done[1:] &= doc[1:] != doc[:-1]
        done[:-1] &= doc[1:] != doc[:-1]
        use = done | (level >= LEAST_LEVEL)
        names.append(x[use])
        docs.append(doc[use])
        x, doc = x[~done], doc[~done]
    if not names:
        return [np.zeros(0, np.uint32)] * len(texts)
    small = (_mix(np.concatenate(names) ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint64)
    both = np.sort(np.concatenate(docs).astype(np.uint64) << np.uint64(32) | small)  # np.unique would hash them one by one
    both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    owner = (both >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [both[a : min(b, a + K)].astype(np.uint32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the K smallest hashes of both that both have; 1 for two empty ones."""
    union = np.union1d(a, b)[:K]
    return 1.0 if not len(union) else float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def _hex(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many of the following text's first code points, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(batches: Iterator[pa.RecordBatch], id: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(id, pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    held: list[tuple] = []
    chars = 0

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [k for k in range(len(rows) - 1) if rows[k][0] == rows[k + 1][0] and not rows[k][1]]  # a bucket's ghost is its last row
        if not pairs:
            return
        texts = [r[3] for r in rows]
        changed = [edited(texts[k], texts[k + 1]) for k in pairs]
        found = signatures(texts + changed)
        own, other = found[: len(rows)], found[len(rows) :]
        cells = [
            (rows[k][2], len(texts[k]), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), _hex(own[k]), _hex(o), likeness(own[k], o), likeness(own[k], own[k + 1]))
            for k, e, o in zip(pairs, changed, other, strict=True)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cells, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        for row in zip(batch.column("bucket").to_pylist(), batch.column("ghost").to_pylist(), batch.column("id").to_pylist(), (t.as_py() or "" for t in batch.column("text")), strict=True):
            held.append(row)
            chars += len(row[3])
            if chars >= PARSE_CHARS and len(held) > 1:
                yield from flush(held)
                held, chars = held[-1:], len(row[3])
    yield from flush(held)


def compare_with_next(df: DataFrame, *, id: str = "doc_id", text: str = "text", rows_per_bucket: int = 2_000) -> DataFrame:
    """For each row: the fingerprints of its text and of the text edited with the next row's, in descending id, and their likenesses.

    After the last row comes the first; a row alone is its own next. Null ids come after all others,
    equal ids in the order of a hash of their texts; null texts are empty. Equal rows follow each other and
    have a result each. Rows move once, to buckets of neighbouring ids (null ids: of neighbouring hashes), of which each also gets one
    copy, the ghost, of the row that follows its last one. A task streams its buckets, so that these may have any size; there are 8 for each
    shuffle partition at most. Other columns of df are ignored, whatever their names. An empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    n, absent = rows.agg(F.count("*"), F.count_if(F.col("id").isNull())).first()
    some = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts, absent_cuts = (max(1, min(x // rows_per_bucket, some)) for x in (n - absent, absent))
    bounds = sorted(set(rows.where("id is not null").approxQuantile("id", [k / cuts for k in range(1, cuts)], 0.1 / cuts))) if cuts > 1 else []
    h = F.xxhash64("text")
    by_id = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("id"))) if bounds else F.lit(0)
    by_hash = -1 - F.least(F.lit(absent_cuts - 1), F.floor((h / float(1 << 64) + 0.5) * absent_cuts))
    rows = rows.withColumn("bucket", F.when(F.col("id").isNull(), by_hash).otherwise(by_id).cast("int")).withColumn("down", -F.col("id")).withColumn("h", h)
    order = F.struct(F.col("down").isNull().alias("absent"), "down", "h")
    # As many as there are buckets. Buckets follow each other in descending order, each one's head the last row of the one before.
    heads = sorted((r["bucket"], r["head"]) for r in rows.groupBy("bucket").agg(F.min(order).alias("head")).collect())
    rows = rows.withColumn("ghost", F.lit(False))
    if heads:
        before = F.create_map(*[F.lit(x) for k, (b, _) in enumerate(heads) for x in (b, heads[(k + 1) % len(heads)][0])])
        head = lambda r: F.struct(F.lit(r["absent"]).alias("absent"), F.lit(r["down"]).cast("long").alias("down"), F.lit(r["h"]).cast("long").alias("h"))
        head_of = F.create_map(*[x for b, r in heads for x in (F.lit(b), head(r))])
        ghosts = rows.where(order.eqNullSafe(head_of[F.col("bucket")])).dropDuplicates(["bucket"])  # equal rows have equal texts
        rows = rows.unionByName(ghosts.withColumn("bucket", before[F.col("bucket")]).withColumn("ghost", F.lit(True)))
    ordered = rows.repartition(max(len(heads), 1), "bucket").sortWithinPartitions("bucket", "ghost", F.col("down").asc_nulls_last(), "h")
    schema = f"`{id}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("bucket", "ghost", "id", "text").mapInArrow(lambda batches: _compare(batches, id), schema)
