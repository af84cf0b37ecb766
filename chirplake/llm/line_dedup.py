"""Line deduplication across documents with two Bloom filters, once seen and twice seen.

Tasks hash the lines of their documents; the hashes, packed, meet by segments of their range, where a
line that the filter of once-seen ones knows enters the filter of twice-seen ones. That filter, of a
bounded size, goes to all tasks, and only lines that it knows (all repeated ones, and few others) are
shuffled, by digest, to be counted exactly. A filter that its bound leaves too small knows more lines,
so that more are counted; results stay the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.llm.batches import pieces
from chirplake.llm.store import discard, frozen, joined

#: ASCII white space that a key loses at its ends.
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Text of one segment of the hash range, on average; bits a line of the filters; hashes a task holds before it gives them on.
SEGMENT_BYTES, ONCE_BITS, TWICE_BITS, HELD = 32 << 20, 10, 12, 1 << 20
PROBES = 4
#: Bound of the filter that all tasks get, and of the lines to drop that they get as a table.
FILTER_BYTES, MOST_BROADCAST = 64 << 20, 400_000


def keys(raw: bytes) -> list[bytes]:
    """The key of each line: A-Z in lower case, without white space at its ends."""
    return [line.strip(BLANK) for line in raw.lower().split(b"\n")]


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def spots(hashes: np.ndarray, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The places of hashes in filters of so many bits."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    a, b = mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    for k in range(PROBES):
        yield (a + np.uint64(k) * b) % np.asarray(bits, np.uint64)


class Filter:
    """A Bloom filter of the sizes given by segment, in one array of bytes."""

    def __init__(self, bits: list[int], data: np.ndarray):
        self.bits = np.array(bits, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum((self.bits + np.uint64(7)) // np.uint64(8))]).astype(np.uint64)
        self.data = data
        self.shift = np.uint64(64 - (len(bits).bit_length() - 1))

    def __contains__(self, key: bytes) -> bool:
        return bool(self.known(np.array([xxhash.xxh3_64_intdigest(key)], np.uint64))[0])

    def known(self, hashes: np.ndarray) -> np.ndarray:
        # A shift by 64 bits isn't defined: one segment takes all.
        segment = (hashes >> self.shift).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(hashes), np.int64)
        start, out = self.starts[segment], np.ones(len(hashes), bool)
        for at in spots(hashes, self.bits[segment]):
            out &= (self.data[(start + (at >> np.uint64(3))).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def seen_twice(table: pa.Table, limit: int) -> tuple[int, bytes]:
    """Bits and bytes of the filter of what is seen twice among the packed hashes of one segment; `limit` bits at most."""
    once = [np.frombuffer(x, np.uint64) for x in table.column("once").to_pylist()]
    twice = [np.frombuffer(x, np.uint64) for x in table.column("again").to_pylist()]
    bits = max(64, ONCE_BITS * sum(map(len, once)))
    first = np.zeros(bits, bool)
    for hashes in once:
        places = list(spots(hashes, bits))
        known = np.logical_and.reduce([first[p] for p in places])
        twice.append(hashes[known])
        for p in places:
            first[p] = True
    found = np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
    bits = max(64, min(limit, TWICE_BITS * len(found)))
    second = np.zeros(bits, bool)
    for p in spots(found, bits):
        second[p] = True
    return bits, np.packbits(second, bitorder="little").tobytes()


def _lines(batches: Iterator[pa.RecordBatch], least_chars: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[dict[bytes, int]]]]:
    """Pieces of batches with each text's keys by line, and the hash of each different key that counts."""
    for piece in pieces(batches, "_text"):
        by_line = [keys(x or b"") for x in piece.column("_text").cast(pa.binary()).to_pylist()]
        yield piece, by_line, [{k: xxhash.xxh3_64_intdigest(k) for k in set(x) if long_enough(k, least_chars)} for x in by_line]


def _known(twice: Filter, found: list[dict[bytes, int]]) -> list[list[bytes]]:
    """Of each text's keys those that the filter knows."""
    hit = iter(twice.known(np.array([h for x in found for h in x.values()], np.uint64)).tolist())
    return [[k for k in x if next(hit)] for x in found]


def twice_filter(df: DataFrame, least_chars: int, filter_bytes: int) -> Filter:
    """The filter of lines of `_text` in two documents at least; lines of one only are known by chance."""
    total = df.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    power = max(4, (total // SEGMENT_BYTES).bit_length())
    n = 1 << power
    edges = np.arange(1, n, dtype=np.uint64) << np.uint64(64 - power)

    def packed(held: list[int]) -> pa.RecordBatch:
        once, counts = np.unique(np.array(held, np.uint64), return_counts=True)
        again = once[counts > 1]
        parts, more = np.split(once, np.searchsorted(once, edges)), np.split(again, np.searchsorted(again, edges))
        at = [k for k in range(n) if len(parts[k])]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([parts[k].tobytes() for k in at], pa.binary()), pa.array([more[k].tobytes() for k in at], pa.binary())], ["segment", "once", "again"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for _, _, found in _lines(batches, least_chars):
            for x in found:
                held.extend(x.values())
            if len(held) >= HELD:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    limit = 8 * filter_bytes // n

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        bits, data = seen_twice(table, limit)
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.int64()), "filter": pa.array([data], pa.binary())})

    met = df.select("_text").mapInArrow(hashed, "segment int, once binary, again binary")
    rows = {r.segment: r for r in met.groupBy("segment").applyInArrow(merged, "segment int, bits long, filter binary").collect()}
    # A segment without lines knows none.
    bits = [rows[k].bits if k in rows else 8 for k in range(n)]
    return Filter(bits, np.frombuffer(b"".join(bytes(rows[k].filter) if k in rows else b"\0" for k in range(n)), np.uint8))


def dedup_lines(
    df: DataFrame, *, text: str = "text", carry: list[str], least_docs: int = 10, least_chars: int = 1, first_by: str | None = None, left: str | None = None,
    filter_bytes: int = FILTER_BYTES, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """The carry columns with n_lines, n_dropped and kept_sha256; with `left`, also the remaining text under that name.

    Lines are split at newlines. A key is a line without ASCII white space at its ends, A-Z in lower case; keys of
    least_chars code points or more in least_docs documents or more lose their lines in all documents, or, with
    first_by (an integer column), in all but the first line of the document of the smallest value (rows that
    share it keep theirs all; null counts as the largest). A null or empty text is one empty line; what is left of null is null.
    Equal rows are documents of their own. Columns of df with a name that is added here are replaced. An empty table gives an empty one.
    """
    added = ["n_lines", "n_dropped", "kept_sha256", *([left] if left else [])]
    carry = [c for c in carry if c.lower() not in [a.lower() for a in added]]
    order = F.coalesce(F.col(first_by).cast("long"), F.lit((1 << 63) - 1)) if first_by else F.lit(0).cast("long")
    docs = df.select(F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_none")).alias("_carried"), F.col(text).alias("_text"), order.alias("_order"))
    context = df.sparkSession.sparkContext
    twice = context.broadcast(twice_filter(docs, least_chars, filter_bytes))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def given() -> pa.RecordBatch:
            n, first = zip(*held.values())
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(n, pa.int64()), pa.array(first, pa.int64())], ["digest", "n", "first"])

        for piece, _, found in _lines(batches, least_chars):
            for order, known in zip(piece.column("_order").to_pylist(), _known(twice.value, found)):
                for key in known:
                    x = held.setdefault(digest(key), [0, order])
                    x[0], x[1] = x[0] + 1, min(x[1], order)
            if len(held) >= HELD // 4:
                yield given()
                held = {}
        if held:
            yield given()

    counts = docs.select("_text", "_order").mapInArrow(suspects, "digest binary, n long, first long").groupBy("digest").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    repeated = frozen(counts.where(F.col("n") >= least_docs), "repeated-lines")
    rows = repeated.agg(F.count("*").alias("lines"), F.sum("n").alias("marks")).first()
    if rows.lines <= most_broadcast:
        found = repeated.select("digest", "first").toArrow()
        table = context.broadcast(dict(zip(found["digest"].to_pylist(), found["first"].to_pylist())))
        discard(repeated)
        work = docs
    else:
        table = None
        work = _with_lines(docs, repeated, rows.marks or 0, twice, least_chars)

    schema = T.StructType([docs.schema["_carried"], *T.StructType.fromDDL("n_lines long, n_dropped long, kept_sha256 string, left string").fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, by_line, found in _lines(batches, least_chars):
            texts, orders = piece.column("_text").cast(pa.binary()).to_pylist(), piece.column("_order").to_pylist()
            own = [table.value] * len(texts) if table else [{r["digest"]: r["first"] for r in x or ()} for x in piece.column("_lines").to_pylist()]
            dropped, sums, kept = [], [], []
            for raw, order, ks, known, drop in zip(texts, orders, by_line, _known(twice.value, found), own):
                gone = {k: drop[d] for k in known if (d := digest(k)) in drop}
                rest, whole = raw or b"", len(ks)
                if gone:
                    stay = {k for k, first in gone.items() if first_by and first == order}
                    lines = []
                    for line, k in zip(rest.split(b"\n"), ks):
                        if k not in gone or k in stay:
                            lines.append(line)
                            stay.discard(k)
                    rest, whole = b"\n".join(lines), len(lines)
                dropped.append(len(ks) - whole)
                sums.append(hashlib.sha256(rest).hexdigest())
                kept.append(None if raw is None or not left else rest.decode())
            yield pa.RecordBatch.from_arrays([piece.column("_carried"), pa.array(map(len, by_line), pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums), pa.array(kept, pa.string())], [f.name for f in schema])

    out = work.mapInArrow(cut, schema)
    return out.select(*[F.col("_carried")[c].alias(c) for c in carry], "n_lines", "n_dropped", "kept_sha256", *([F.col("left").alias(left)] if left else []))


def _with_lines(docs: DataFrame, repeated: DataFrame, marks: int, twice, least_chars: int) -> DataFrame:
    """docs with `_lines`, digests and firsts of the repeated lines that each text has, met by text: for more lines than tasks should hold."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, _, found in _lines(batches, least_chars):
            names = [hashlib.sha256(x or b"").digest() for x in piece.column("_text").cast(pa.binary()).to_pylist()]
            pairs = [(name, digest(k)) for name, known in zip(names, _known(twice.value, found)) for k in known]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["_name", "digest"])

    lines = joined(docs.select("_text").mapInArrow(marked, "_name binary, digest binary"), repeated, ["digest"], "n", marks)
    # Each copy of a text brings each of its lines once.
    lines = lines.groupBy("_name", "digest", "first").agg(F.count("*").alias("n"))
    lists = lines.groupBy("_name").agg(F.collect_list(F.struct("digest", "first")).alias("_lines"), F.max("n").alias("n"))
    named = docs.withColumn("_name", F.unhex(F.sha2(F.coalesce("_text", F.lit("")).cast("binary"), 256)))
    return joined(named, frozen(lists, "lines-of-texts"), ["_name"], "n", docs.count(), "left").drop("_name")
