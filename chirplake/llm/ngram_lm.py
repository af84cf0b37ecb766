"""LM scoring with a bigram trie in Elias-Fano levels, spread over the cluster by context.

Texts are cut into chunks of some MB, each a row with its dictionary and its token codes, and
frozen. A chunk asks for each of its distinct words once, and for each of its distinct bigrams
once, so that what is shuffled is pre-aggregated and no word or context is hot:

1. words go to shards by hash; a shard sums their training counts and answers with count and id;
2. bigrams of known words go to shards by context (a frequent context is cut into several parts
   by the following word); a shard builds the trie of its training bigrams and answers with
   quantised probabilities and with each context's number of different successors;
3. each chunk adds up its documents' scores.

A level of the trie holds, for its sorted contexts, monotone pointers to the range of their
successors, the successors (made monotone by the sums of the ranges before) and 16-bit codes
of discounted probabilities, all in one memory-mapped file. A successor is found in the bucket of its high
bits, there by bisection of the packed low bits. A shard looks for each distinct bigram once, whatever the
number of chunks that ask for it, in the order of the trie; only what is looked at is decoded.

The model is absolute discounting over the additively smoothed unigrams:
P(w | h) = max(c(hw) - D, 0) / c(h) + D * N1+(h) / c(h) * P(w), P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),
where unknown contexts give P(w). A text starts in a context of its own, and ends with a token.
"""

from __future__ import annotations

import math
import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.llm.batches import pieces
from chirplake.llm.store import frozen

DISCOUNT = 0.75
END = xxhash.xxh64_intdigest(b"") - (1 << 63)
#: Context of a text's first token; ids are not negative.
START = -2
#: Entries that one shard answers, about.
SHARD_ENTRIES = 1 << 20
#: A context with so many training tokens has two parts, and one more for every so many.
PART_TOKENS = 1 << 20
#: log10 probabilities from -16 to 0 in 16 bits; 0 is kept for bigrams that were not seen.
STEPS = 65534


def pack(values: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, compressed."""
    wide = np.ascontiguousarray(values, np.int64)
    return zstandard.ZstdCompressor(level=1).compress(wide.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()


def spread(values: np.ndarray, shards: int, salt: np.ndarray | int = 0) -> np.ndarray:
    x = (values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(salt).astype(np.uint64) + np.uint64(1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _select_table() -> np.ndarray:
    """For rank r and byte b at r * 256 + b: the place of the set bit that has r set ones below it."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ranks = np.where(bits == 1, np.cumsum(bits, axis=1) - 1, 8)
    return np.stack([np.argmax(ranks == r, axis=1) for r in range(8)]).astype(np.uint8).ravel()


SELECT = _select_table()
LOWS, HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _select(bits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the set bit of each 64-bit word that has so many set ones below it; bytes side by side."""
    sums = bits - ((bits >> np.uint64(1)) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * LOWS  # of each byte and those below
    rank = rank.astype(np.uint64)
    shift = np.bitwise_count((((rank * LOWS) | HIGHS) - sums) & HIGHS).astype(np.uint64) << np.uint64(3)
    rank -= ((sums << np.uint64(8)) >> shift) & np.uint64(255)
    return shift.astype(np.int64) + SELECT[rank << np.uint64(8) | (bits >> shift) & np.uint64(255)]


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with a rank directory. Parts are arrays that can be mapped."""

    def __init__(self, parts: dict[str, np.ndarray], n: int, width: int):
        self.parts, self.n, self.width = parts, n, width

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = np.zeros((n * width + 63) // 64 + 2, np.uint64)
        if width:
            bit = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
            part = v & np.uint64((1 << width) - 1)
            np.bitwise_or.at(low, word, part << off)
            over = off + np.uint64(width) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - off[over]))
        at = (v >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(at[-1] >> np.uint64(6)) + 1 if n else 1, np.uint64)
        np.bitwise_or.at(high, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(high).astype(np.int64))))[:-1]
        return cls({"low": low, "high": high, "before": before.astype(np.uint64)}, n, width)

    def _low(self, i: np.ndarray) -> np.ndarray:
        """The low bits of the values at places i."""
        if not self.width:
            return np.zeros(len(i), np.int64)
        low = self.parts["low"]
        bit = i.astype(np.uint64) * np.uint64(self.width)
        w, off = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        part = low[w] >> off
        over = np.flatnonzero(off > np.uint64(64 - self.width))
        part[over] |= low[w[over] + 1] << (np.uint64(64) - off[over])
        return (part & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high, before = self.parts["high"], self.parts["before"]
        word = np.searchsorted(before, i.astype(np.uint64), side="right") - 1
        return (word * 64 + _select(high[word], i - before[word].astype(np.int64)) - i) << self.width | self._low(i)

    def _ends(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have high bits up to each bucket, whose zero in the unary high bits ends it; 0 for bucket -1."""
        high, before = self.parts["high"], self.parts["before"]
        zeros = np.arange(0, 64 * len(high), 64) - before.astype(np.int64)
        last = 64 * (len(high) - 1) + int(high[-1]).bit_length() - self.n  # bucket of the last value
        out = np.where(bucket < 0, 0, self.n)
        some = np.flatnonzero((bucket >= 0) & (bucket < last))
        b = bucket[some]
        word = np.searchsorted(zeros, b, side="right") - 1
        out[some] = word * 64 + _select(~high[word], b - zeros[word]) - b
        return out

    def successor(self, values: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of the first that is not smaller than each value, from each begin on and before each end (end: none is).

        Values whose high bits are equal lie together; in these the low bits are bisected, packed as they are.
        """
        bucket, lows = values >> self.width, values & ((1 << self.width) - 1)
        low, high = self._ends(bucket - 1), self._ends(bucket)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self._low(mid) < lows[open_]
            low[open_[less]], high[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[low[open_] < high[open_]]
        return np.clip(low, begin, self.n if end is None else end)


class BigramTrie:
    """Contexts (sorted keys), their successors and codes; the levels are in one unlinked, memory-mapped file."""

    def __init__(self, keys: np.ndarray, pointers: np.ndarray, successors: np.ndarray, codes: np.ndarray):
        """pointers: begins of the contexts' ranges and the end; successors ascend within a range."""
        last = np.where(np.diff(pointers) > 0, successors[np.maximum(pointers[1:] - 1, 0)] if len(successors) else 0, 0)
        bases = np.concatenate(([0], np.cumsum(last + 1)))  # ranges don't meet
        self.keys, self.pointers, self.bases = EliasFano.of(keys), EliasFano.of(pointers), EliasFano.of(bases)
        self.successors = EliasFano.of(successors + np.repeat(bases[:-1], np.diff(pointers)))
        parts = [(ef.parts, name) for ef in (self.keys, self.pointers, self.bases, self.successors) for name in ef.parts]
        held = {"codes": codes.astype(np.uint16)}
        parts.append((held, "codes"))
        with tempfile.TemporaryFile() as file:
            places = []
            for level, name in parts:
                places.append((file.tell(), level[name].dtype, len(level[name])))
                file.write(level[name].tobytes().ljust(-(-level[name].nbytes // 8) * 8 or 8, b"\0"))
            file.flush()
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        for (level, name), (at, kind, n) in zip(parts, places, strict=True):
            level[name] = np.frombuffer(self._map, kind, n, at)
        self.codes = held["codes"]

    def lookup(self, keys: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The code of each bigram, 0 where it is not in the trie. keys: contexts, each followed by so many of the words.

        The successor of a word, moved by its context's base, is the word itself if the context has it.
        """
        context = self.keys.successor(keys)
        base = np.repeat(self.bases.get(context), sizes)
        begin, end = np.repeat(self.pointers.get(context), sizes), np.repeat(self.pointers.get(context + 1), sizes)
        at = self.successors.successor(words + base, begin, end)
        out = np.zeros(len(words), np.int64)
        inside = np.flatnonzero(at < end)
        here = inside[self.successors.get(at[inside]) == (words + base)[inside]]
        out[here] = self.codes[at[here]]
        return out


def encode_log(p: np.ndarray) -> np.ndarray:
    return 1 + np.rint((np.clip(np.log10(p), -16, 0) + 16) / 16 * STEPS).astype(np.int64)


def decode_log(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((codes - 1) / STEPS * 16 - 16), 0.0)


# -- chunks ----------------------------------------------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text (its end counted), the hashes of the distinct tokens, and all tokens as places in these."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    words, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    words, parents = words.filter(real), parents.filter(real)
    lengths = np.bincount(parents.to_numpy(), minlength=len(texts)) + 1
    coded = words.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w.as_buffer()) - (1 << 63) for w in coded.dictionary] + [END], np.int64)
    codes = np.full(int(lengths.sum()), len(hashes) - 1, np.int64)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - 1] = False
    codes[inner] = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(codes, minlength=len(hashes)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return lengths, hashes[order], place[codes]


CHUNK = "chunk long, ids array<long>, train array<boolean>, lengths binary, words binary, codes binary, n_words long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nth = 0
    part = TaskContext.get().partitionId()

    def made(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal nth
        whole = pa.Table.from_batches(rows).combine_chunks()
        lengths, words, codes = tokens(whole.column("text").combine_chunks())
        nth += 1
        cells = [(part << 32) + nth - 1, whole.column("id").to_pylist(), whole.column("train").to_pylist(), pack(lengths), pack(words), pack(codes), len(words)]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], ["chunk", "ids", "train", "lengths", "words", "codes", "n_words"])

    held: list[pa.RecordBatch] = []
    size = 0
    for piece in pieces(batches, "text"):
        n = piece.column("text").nbytes
        if held and size + n > 8 << 20:
            yield made(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield made(held)


def _counts(lengths: np.ndarray, train: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(codes[np.repeat(train, lengths)], minlength=n)


# -- level 1: words --------------------------------------------------------------------------


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, words, codes = unpack(row["lengths"]), unpack(row["words"]), unpack(row["codes"])
                counts = _counts(lengths, np.array(row["train"], bool), codes, len(words))
                to = spread(words, shards)
                out = [{"shard": int(s), "chunk": row["chunk"], "words": pack(words[to == s]), "counts": pack(counts[to == s])} for s in np.unique(to)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())]))

    return run


ANSWER = "chunk long, level int, shard long, a binary, b binary, n_tokens long, n_types long"
ANSWERS = ["chunk", "level", "shard", "a", "b", "n_tokens", "n_types"]


def _answer_words(shards: int):
    def run(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        words = [unpack(x) for x in asked["words"]]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([unpack(x) for x in asked["counts"]]), minlength=len(distinct)).astype(np.int64)
        order = np.lexsort((distinct, -counts))
        ids = np.empty(len(order), np.int64)
        ids[order] = np.arange(len(order)) * shards + shard
        ids[counts == 0] = -1
        rows = []
        for chunk, at in zip(asked["chunk"], np.split(place, np.cumsum([len(w) for w in words])[:-1]), strict=True):
            rows.append((chunk, 1, shard, pack(counts[at]), pack(ids[at]), 0, 0))
        rows.append((-1, 1, shard, b"", b"", int(counts.sum()), int((counts > 0).sum())))
        return pd.DataFrame(rows, columns=ANSWERS)

    return run


# -- level 2: bigrams ------------------------------------------------------------------------


class _Chunk:
    """A chunk with the answers on its words."""

    def __init__(self, row, answers: pd.DataFrame, word_shards: int, texts: int):
        self.ids, self.train = row["ids"], np.array(row["train"], bool)
        self.lengths, words, self.codes = unpack(row["lengths"]), unpack(row["words"]), unpack(row["codes"])
        self.n = len(words)
        self.counts, self.word_ids = np.zeros(self.n + 1, np.int64), np.full(self.n + 1, START)
        to = spread(words, word_shards)
        for shard, a, b in zip(answers["shard"], answers["a"], answers["b"], strict=True):
            self.counts[: self.n][to == shard], self.word_ids[: self.n][to == shard] = unpack(a), unpack(b)
        self.counts[self.n] = texts  # the start of a text, as a context
        before = np.concatenate(([self.n], self.codes[:-1]))
        before[np.concatenate(([0], np.cumsum(self.lengths)[:-1]))] = self.n
        self.before = before
        self.known = (self.counts[before] > 0) & (self.counts[self.codes] > 0)

    def bigrams(self, shards: int) -> dict[str, np.ndarray]:
        """The distinct bigrams, their contexts' parts and where these go; place: of each known token's bigram.

        Every trained context is asked for, also one that no known word follows here, as its other successors weigh the base.
        """
        keys, place = np.unique(self.before[self.known] * (self.n + 1) + self.codes[self.known], return_inverse=True)
        train = np.repeat(self.train, self.lengths)[self.known]
        counts = np.bincount(place[train], minlength=len(keys))
        context, word = keys // (self.n + 1), keys % (self.n + 1)
        contexts = np.unique(self.before[self.counts[self.before] > 0])
        at = np.searchsorted(contexts, context)
        parts = 1 + self.counts[contexts] // PART_TOKENS
        first = np.concatenate(([0], np.cumsum(parts)))[:-1]
        entry_context = np.repeat(contexts, parts)
        entry_part = np.arange(len(entry_context)) - np.repeat(first, parts)
        entry = first[at] + spread(self.word_ids[word], 1 << 30) % parts[at]
        entry_key = (self.word_ids[entry_context] + 2) << 16 | entry_part
        to = spread(entry_key, shards, 1)
        order = np.lexsort((self.word_ids[word], entry, to[entry]))
        return {"place": place, "order": order, "entry": entry, "context": entry_context, "key": entry_key, "to": to, "word": self.word_ids[word], "counts": counts}


ASK = "shard long, chunk long, keys binary, totals binary, sizes binary, words binary, counts binary"


def _ask_bigrams(word_shards: int, shards: int, texts: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            chunk = _Chunk(row, answers, word_shards, texts)
            b = chunk.bigrams(shards)
            sizes = np.bincount(b["entry"], minlength=len(b["key"]))
            order, home = b["order"], b["to"][b["entry"][b["order"]]]
            for s in np.unique(b["to"]):
                mine, own = b["to"] == s, order[home == s]
                out.append((int(s), row["chunk"], pack(b["key"][mine]), pack(chunk.counts[b["context"][mine]]), pack(sizes[mine]), pack(b["word"][own]), pack(b["counts"][own])))
        return pd.DataFrame(out, columns=["shard", "chunk", "keys", "totals", "sizes", "words", "counts"])

    return run


def _answer_bigrams(key: tuple, asked: pd.DataFrame) -> pd.DataFrame:
    shard = int(key[0])
    cols = {c: [unpack(x) for x in asked[c]] for c in ("keys", "totals", "sizes", "words", "counts")}
    flat = {c: np.concatenate(v) for c, v in cols.items()}
    contexts, at, owner = np.unique(flat["keys"], return_index=True, return_inverse=True)
    totals = flat["totals"][at]
    o = np.repeat(owner, flat["sizes"])
    order = np.lexsort((flat["words"], o))
    o, w, c = o[order], flat["words"][order], flat["counts"][order]
    # Each bigram once, in the order of the trie: chunks ask for the same ones.
    first = np.concatenate((np.ones(min(len(o), 1), bool), (o[1:] != o[:-1]) | (w[1:] != w[:-1])))
    new = np.flatnonzero(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    c = np.add.reduceat(c, new) if len(new) else c
    o, w = o[new], w[new]
    seen = c > 0
    successors = np.bincount(o[seen], minlength=len(contexts))
    p = np.maximum(c[seen] - DISCOUNT, 0) / totals[o[seen]]
    trie = BigramTrie(contexts, np.concatenate(([0], np.cumsum(successors))), w[seen], encode_log(p))
    codes = trie.lookup(contexts, np.bincount(o, minlength=len(contexts)), w)[place]
    followers = successors[owner]
    rows = []
    begin = first_key = 0
    for chunk, keys, words in zip(asked["chunk"], cols["keys"], cols["words"], strict=True):
        rows.append((chunk, 2, shard, pack(codes[begin : begin + len(words)]), pack(followers[first_key : first_key + len(keys)]), 0, 0))
        begin, first_key = begin + len(words), first_key + len(keys)
    return pd.DataFrame(rows, columns=ANSWERS)


# -- scores ----------------------------------------------------------------------------------


def _score(word_shards: int, shards: int, texts: int, n_tokens: int, n_types: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            chunk = _Chunk(row, answers[answers["level"] == 1], word_shards, texts)
            b = chunk.bigrams(shards)
            probabilities, followers = np.zeros(len(b["word"])), np.zeros(chunk.n + 1)
            home = b["to"][b["entry"][b["order"]]]
            of_level = answers[answers["level"] == 2]
            for s, codes, n in zip(of_level["shard"], of_level["a"], of_level["b"], strict=True):
                probabilities[b["order"][home == s]] = decode_log(unpack(codes))
                np.add.at(followers, b["context"][b["to"] == s], unpack(n))
            unigram = (chunk.counts + 0.5) / (n_tokens + 0.5 * (n_types + 1))
            base = unigram[chunk.codes]
            p = base.copy()
            total = chunk.counts[chunk.before]
            backed = np.where(total > 0, DISCOUNT * followers[chunk.before] / np.maximum(total, 1), 1.0)
            p *= np.where(followers[chunk.before] > 0, backed, 1.0)
            p[chunk.known] += probabilities[b["place"]]
            starts = np.concatenate(([0], np.cumsum(chunk.lengths)[:-1])).astype(np.int64)
            sums = {
                "n_known": np.add.reduceat((chunk.counts[chunk.codes] > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(np.log10(base), starts),
                "score": np.add.reduceat(np.log10(p), starts),
            }
            out.append(pd.DataFrame({"id": pd.array(list(row["ids"]), "Int64"), "held_out": ~chunk.train, "n_tokens": chunk.lengths, **sums}))
        done = pd.concat(out) if out else pd.DataFrame({c: [] for c in ("id", "held_out", "n_tokens", "n_known", "base_score", "score")})
        done["train_tokens"] = n_tokens
        return done[["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return run


def score_texts(df: DataFrame, *, id: str, text: str, train: Column) -> DataFrame:
    """For every row of df: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the whole text's probability).

    The model learns from the rows where `train` is true. A null or empty text is its end alone;
    null ids and equal rows are rows like any other; a null `train` is false. Without training rows every token
    has the same small probability. An empty table gives an empty one.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    chunks = frozen(rows.mapInArrow(_chunks, CHUNK), "lm-chunks")
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    word_shards = max(tasks, math.ceil(words / SHARD_ENTRIES))
    asked = chunks.select("chunk", "train", "lengths", "words", "codes").mapInArrow(_ask_words(word_shards), "shard long, chunk long, words binary, counts binary")
    level1 = frozen(asked.groupBy("shard").applyInPandas(_answer_words(word_shards), ANSWER), "lm-words")
    facts = level1.where("chunk = -1").agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    texts = chunks.select(F.sum(F.size(F.filter("train", lambda x: x)))).first()[0] or 0
    answers = level1.where("chunk >= 0")
    shards = max(tasks, math.ceil(4 * words / SHARD_ENTRIES))
    # A chunk is one row and a task holds one at a time.
    asked = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_ask_bigrams(word_shards, shards, texts), ASK)
    level2 = asked.groupBy("shard").applyInPandas(_answer_bigrams, ANSWER)
    scored = chunks.groupBy("chunk").cogroup(answers.unionByName(level2).groupBy("chunk"))
    return scored.applyInPandas(
        _score(word_shards, shards, texts, facts["n"] or 0, facts["v"] or 0),
        "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    ).withColumnRenamed("id", id)
