"""SimHash fingerprints, their exact near pairs by a Gray-order hierarchical index, and components.

Fingerprints that differ in at most `most` bits agree in at least one of most + 1 bit bands, so
the distinct fingerprints are dealt out by (band, value). Within a task they are sorted by
their rank in the Gray sequence, whose neighbours differ in few bits, and built into a
hierarchy: a node holds the bits that all below it share (a mask and its pattern). Pairs of
nodes are followed from the root down; the differences in the bits that both share bound those
of every pair below, so that whole groups of pairs are pruned, or linked at once where even
all open bits can't exceed the limit. A task gives a spanning forest of what it links, never
the pairs of a group.

The near-copy stage asks for a similarity (Jaccard of five-word shingles), of which SimHash bits tell
too little near 0.8. There, links of SimHash words and of MinHash bands are only candidates, and the
similarity is counted exactly: first of each candidate with one pivot of its bucket, then, in the buckets whose members that
doesn't put into one group, of all pairs across groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chirplake.llm.batches import map_texts
from chirplake.llm.store import discard, frozen, joined, kept_by_bits

BITS = 64
#: Children of a node of the hierarchy.
FAN = 8
#: Pairs of nodes that are held at once.
FRONTIER = 1 << 18
#: Rows of whole cells that are indexed together.
SLAB = 1 << 18
#: A (band, value) with more fingerprints is split into blocks, of which each pair is a cell of its own.
CELL = 1 << 17
#: Fingerprints of one bucket on average, at most: more shared blocks are asked for beyond.
BUCKET = 512
#: MinHash bands of the near-copy stage and the minima in each: at a similarity of 0.8, 1 - (1 - 0.8^6)^20 = 99.8 % of pairs share a band.
BANDS, BAND_ROWS = 20, 6
#: What the minima's hashes are made with: an odd factor and a word that is flipped, of each.
_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * BAND_ROWS), dtype=np.uint64).astype(np.uint32)
ODD, FLIP = _DRAWN[0] | np.uint32(1), _DRAWN[1]
#: Odd factors of the chain of shingle hashes and of their second words.
CHAIN = np.random.default_rng(7).integers(1 << 62, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
#: Candidates that one task compares with a pivot.
STAR = 1 << 12
#: Shingles of a bucket's block. A bucket of more is split into blocks by text, of which each pair is a cell of its own.
BLOCK_SHINGLES = 1 << 20


def _shingles(text: str | None, width: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = (starts[: 1 - width], ends[width - 1 :]) if len(words) > width else (starts[:1], ends[-1:])
    return [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """For each column of 64-bit hashes the word whose bits are set in over half of them."""
    ones = np.zeros(hashes.shape[1] * BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(np.ascontiguousarray(hashes[k : k + (1 << 15)]).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's word shingles: a bit is set if it is in over half of their XXH64 hashes. 0 without words."""
    found = _shingles(text, width)
    if not found:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in found), np.uint64, len(found))
    return int(_majority(hashes[:, None])[0])


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Rows of two 64-bit hashes, one row a shingle of the text: chained over the hashes of its words, each of which is hashed once, and the second made of the first.

    With fewer words than `width` the whole sequence is the only shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    width = min(width, len(words))
    if not width:
        return np.zeros((0, 2), np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h ^= hashed[k : k + n]
        h *= CHAIN[0]
        h ^= h >> np.uint64(32)
    other = h * CHAIN[1]
    other ^= other >> np.uint64(29)
    other *= CHAIN[0]
    return np.stack([h, other ^ (other >> np.uint64(32))], axis=1)


def fingerprinted(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carry columns (all by default) with `fp` long, the fingerprint's bits. A null text is an empty one; a column fp of df is replaced."""
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() != "fp"]

    def work(texts: pa.Array) -> dict:
        return {"fp": pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))}

    return map_texts(df, text, carry, "fp long", work)


def _min_bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each of the BANDS bands of minima; the hashes are not empty."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(ODD), ~np.uint32(0))
    for k in range(0, len(low), 1024):
        np.minimum(least, ((low[k : k + 1024, None] ^ FLIP) * ODD).min(axis=0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), nth) for nth, band in enumerate(least.reshape(BANDS, BAND_ROWS))], np.uint64)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct 64-bit hashes of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, width)[:, 0])


def sketched(df: DataFrame, text: str = "text") -> DataFrame:
    """df with set0 and set1 (a digest of the text's set of shingles), fp0 and fp1 (the wide fingerprint) and bands (MinHash keys; none without words)."""

    def work(texts: pa.Array) -> dict:
        sets, prints, bands = [], [], []
        for t in texts.to_pylist():
            both = shingle_hashes(t)
            distinct = np.unique(both[:, 0])
            sets.append(np.frombuffer(xxhash.xxh3_128_digest(distinct.tobytes()), np.int64))
            prints.append(_majority(both) if len(both) else np.zeros(2, np.uint64))
            bands.append(_min_bands(distinct).view(np.int64) if len(both) else np.zeros(0, np.int64))
        s, f = np.array(sets, np.int64).reshape(-1, 2), np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
        return {"_set0": pa.array(s[:, 0]), "_set1": pa.array(s[:, 1]), "_fp0": pa.array(f[:, 0]), "_fp1": pa.array(f[:, 1]), "_bands": pa.array(bands, pa.list_(pa.int64()))}

    return map_texts(df, text, df.columns, "_set0 long, _set1 long, _fp0 long, _fp1 long, _bands array<long>", work)


def _sets(texts: pa.Array) -> dict:
    found = [shingle_set(t) for t in texts.to_pylist()]
    return {"size": pa.array([len(x) for x in found], pa.int32()), "set": pa.array([x.tobytes() for x in found], pa.binary())}


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit pattern in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayHierarchy:
    """Over the fingerprints x of cells; only pairs of one cell count."""

    def __init__(self, cells: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None, most_in_all: int = 0):
        """rest: a second word of each, which then is compared too; both words of a pair differ in most_in_all bits at most."""
        order = np.lexsort((gray_rank(x), cells))
        self.order, self.x, first = order, x[order], cells[order]
        self.rest, self.most_in_all = None if rest is None else rest[order], most_in_all
        level = {"mask": np.full(len(x), ~np.uint64(0)), "pattern": self.x, "low": first, "high": first}
        self.levels = [level]
        while len(level["low"]) > 1:
            at = np.arange(0, len(level["low"]), FAN)
            every, some = np.bitwise_and.reduceat(level["pattern"], at), np.bitwise_or.reduceat(level["pattern"], at)
            mask = np.bitwise_and.reduceat(level["mask"], at) & ~(every ^ some)
            level = {"mask": mask, "pattern": every & mask, "low": np.minimum.reduceat(level["low"], at), "high": np.maximum.reduceat(level["high"], at)}
            self.levels.append(level)

    def links(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of places in self.x; their links span the components of the graph of pairs within `most` bits."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        child = np.arange(FAN)
        while stack:
            depth, a, b = stack.pop()
            if depth == 0:
                if self.rest is not None:
                    same = np.bitwise_count(self.x[a] ^ self.x[b]).astype(np.int64) + np.bitwise_count(self.rest[a] ^ self.rest[b]) <= self.most_in_all
                    a, b = a[same], b[same]
                yield a, b
                continue
            if len(a) > FRONTIER // FAN**2:
                half = len(a) // 2
                stack += [(depth, a[:half], b[:half]), (depth, a[half:], b[half:])]
                continue
            n, below = len(self.levels[depth - 1]["low"]), self.levels[depth - 1]
            a, b = (np.broadcast_to(v, (len(a), FAN, FAN)).ravel() for v in ((a * FAN)[:, None, None] + child[:, None], (b * FAN)[:, None, None] + child))
            near = (a < n) & (b < n) & (a <= b) if depth > 1 else (a < n) & (b < n) & (a < b)
            a, b = a[near], b[near]
            near = (below["low"][a] <= below["high"][b]) & (below["low"][b] <= below["high"][a])
            a, b = a[near], b[near]
            shared = below["mask"][a] & below["mask"][b]
            apart = np.bitwise_count((below["pattern"][a] ^ below["pattern"][b]) & shared).astype(np.int64)
            near = apart <= most
            if depth > 1 and self.rest is None:
                one_cell = (below["low"][a] == below["high"][a]) & (below["low"][b] == below["high"][b])
                whole = near & one_cell & (apart + np.bitwise_count(~shared) <= most)
                if whole.any():
                    yield self._all_of(depth - 1, a[whole], b[whole])
                near &= ~whole
            if near.any():
                stack.append((depth - 1, a[near], b[near]))

    def _all_of(self, depth: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every leaf below the nodes a and b, with the first leaf of its a."""
        span = FAN**depth
        first = a * span
        leaves = np.concatenate([first[:, None] + np.arange(span), (b * span)[:, None] + np.arange(span)], axis=1)
        heads = np.broadcast_to(first[:, None], leaves.shape)
        real = (leaves < len(self.x)) & (leaves != heads)
        return heads[real], leaves[real]


def join_sets(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (a forest that points to smaller places, flat) after the links a-b."""
    while True:
        ra, rb = label[a], label[b]
        differ = ra != rb
        if not differ.any():
            return label
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label = flat


def spanning_links(cells: np.ndarray, x: np.ndarray, most: int, rest: np.ndarray | None = None, most_in_all: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and of the root of each one's component in its cell, roots left out."""
    index = GrayHierarchy(cells, x, rest, most_in_all)
    label = np.arange(len(x))
    for a, b in index.links(most):
        label = join_sets(label, a, b)
    other = label != np.arange(len(x))
    return index.order[other], index.order[label[other]]


def _link_slabs(most: int, most_in_all: int):
    """Over rows sorted by cell: node, fp and rest (a second word, if most_in_all); whole cells are indexed together."""

    def linked(ids: np.ndarray, rows: pa.Table) -> pa.RecordBatch:
        word = lambda c: rows.column(c).to_numpy().view(np.uint64)
        a, b = spanning_links(ids, word("fp"), most, word("rest") if most_in_all else None, most_in_all)
        node = rows.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def whole() -> tuple[np.ndarray, pa.Table]:
            found = pa.Table.from_batches(held).combine_chunks()
            parts = [found.column(n).to_numpy().astype(np.int64) for n in ("bucket", "low", "high")]
            return np.concatenate(([0], np.cumsum(np.any([np.diff(p) != 0 for p in parts], axis=0)))), found

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SLAB:
                ids, found = whole()
                cut = int(np.searchsorted(ids, ids[-1]))  # the last cell may go on in the next batch
                if cut:
                    yield linked(ids[:cut], found.slice(0, cut).combine_chunks())
                    held = found.slice(cut).combine_chunks().to_batches()
                    rows -= cut
        if rows:
            yield linked(*whole())

    return run


def near_links(prints: DataFrame, most: int = 4, shared: int | None = None, most_in_all: int = 0) -> DataFrame:
    """prints: rows of `node` and `fp`, and `rest` if most_in_all. Gives (u, v): links between nodes that span their components.

    The bits are cut into most + shared blocks, of which near fingerprints have `shared` in common at
    least; a row goes to a bucket for each such choice of blocks. More shared blocks make buckets that hold less of all rows;
    by default there are so many that random fingerprints fill a bucket with BUCKET rows at most. The links are the same for any.
    """
    spark, n = prints.sparkSession, prints.count()
    if shared is None:
        shared = next(k for k in range(1, BITS) if n <= BUCKET << (k * -(-BITS // (most + k))) or k == 4)
    width = -(-BITS // (most + shared))
    block = lambda k: F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    choices = list(combinations(range(most + shared), shared))
    keys = []
    for nth, blocks in enumerate(choices):
        key = F.lit(nth).cast("long")
        for k in blocks:
            key = F.shiftleft(key, width).bitwiseOR(block(k))
        keys.append(key)
    columns = ["node", "fp", *(["rest"] if most_in_all else [])]
    dealt = prints.select(*columns, F.explode(F.array(*keys)).alias("bucket"))
    # There are at most len(choices) * 2^(shared * width) buckets, whatever the input: a bounded table.
    full = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CELL).select("bucket", F.ceil(F.col("n") / CELL).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64(F.lit(5), "fp"), blocks).cast("int")
    cells = (
        dealt.join(F.broadcast(full), "bucket", "left")
        .select("bucket", *columns, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select("bucket", *columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * len(choices) // (4 * SLAB)))
    return cells.repartition(tasks, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high").mapInArrow(_link_slabs(most, most_in_all), "u long, v long")


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Edges frozen, with their count and a sum of hashes, which the writing job itself finds."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return frozen(told, "links"), (seen.get["n"], seen.get["sum"])


def components(links: DataFrame) -> DataFrame:
    """links: (u, v). Gives (node, root) for every node but the roots, root the smallest of its component (signed order).

    A large-star and a small-star step each round, written to the shared folder; minima are
    aggregated before they are shuffled, no node's neighbours are gathered, and those of a hot node meet its minimum by broadcast.
    """
    edges, state = _written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while state[0] and state != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).persist()
        large = joined(both.where("v > u"), least, ["u"], "n", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().persist()
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).persist()
        met = joined(large, small, ["u"], "n", state[0])
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        old, before = edges, state
        edges, state = _written(met.select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        for df in (least, large, small):
            df.unpersist()
        discard(old)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_components(prints: DataFrame, id: str, most: int = 4) -> DataFrame:
    """prints: `id` and `fp`. Adds component_id: the smallest id of the component of fingerprints within `most` bits of each other.

    Null ids have a component, but none is the smallest where there are others; equal rows have equal results; an empty table
    gives an empty one. Other columns stay; one named component_id is replaced.
    """
    own = frozen(prints.groupBy("fp").agg(F.min(id).alias("least"), F.count("*").alias("n")), "prints")
    roots = components(near_links(own.select(F.col("fp").alias("node"), "fp"), most))
    rooted = frozen(own.join(roots, own.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    named = frozen(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("prints")), "components")
    ids = frozen(joined(rooted, named, ["root"], "prints", rooted.count()).select("fp", "n", "component_id"), "component-ids")
    discard(own, rooted, named)
    return joined(prints.drop("component_id"), ids, ["fp"], "n", prints.count())


def shared_bands(nodes: DataFrame) -> DataFrame:
    """nodes: `node` and `bands`. Gives (key, node, v): of each band's key that several nodes have, these nodes and the smallest."""
    keys = nodes.select("node", F.explode("bands").alias("key"))
    least = frozen(keys.groupBy("key").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"), "bands")
    found = frozen(joined(keys, least, ["key"], "n", nodes.count() * BANDS), "shared-bands")
    discard(least)
    return found


def _compare_stars(similarity: float):
    """Over rows sorted by (v, block, u), of u and `set`; the first of each block, without a u, is the pivot v, and is held alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot = np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for v, u, raw in zip(batch.column("v").to_pylist(), batch.column("u").to_pylist(), batch.column("set"), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if u is None:
                    pivot = x
                    continue
                if min(len(x), len(pivot)) >= similarity * max(len(x), len(pivot)):
                    both = int(np.isin(x, pivot, assume_unique=True).sum())
                    if both >= similarity * (len(x) + len(pivot) - both):
                        found.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """pairs: distinct (u, v); sets: `node` and `set`. The pairs whose sets have a Jaccard of `similarity` at least.

    A pivot v goes to each block of STAR of its pairs, and a task holds the set of one pivot at a time.
    """
    counts = frozen(pairs.groupBy("v").agg(F.count("*").alias("n"), F.ceil(F.count("*") / STAR).cast("int").alias("blocks")), "pivots")
    dealt = joined(pairs, counts, ["v"], "n", pairs.count()).withColumn("block", F.pmod(F.xxhash64("u"), "blocks").cast("int"))
    others = dealt.join(sets.withColumnRenamed("node", "u"), "u").select("v", "block", "u", "set")
    pivots = counts.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.withColumnRenamed("node", "v"), "v").select("v", "block", F.lit(None).cast("long").alias("u"), "set")
    ordered = others.unionByName(pivots).repartition("v", "block").sortWithinPartitions("v", "block", F.col("u").asc_nulls_first())
    return ordered.select("v", "u", "set").mapInArrow(_compare_stars(similarity), "u long, v long")


def similar_links(sets: list[np.ndarray], similarity: float, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Places in sets: links that, with those of equal labels, span the components of the graph of pairs whose exact Jaccard is `similarity` at least.

    The sets of one label are known to be of one component. Those not reached yet are counted against one reached set at a time.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    mine = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    mark = np.zeros(len(codes), bool)
    label = np.arange(len(sets)) if labels is None else labels
    left, tokens = np.arange(len(sets)), codes
    reached: list[int] = []
    while len(left):
        if reached:
            at = reached.pop()
            mark[mine[at]] = True
            both = np.add.reduceat(mark[tokens].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[left])[:-1])))
            mark[mine[at]] = False
            near = both >= similarity * (sizes[left] + sizes[at] - both)
            if not near.any():
                continue
            yield from ((at, k) for k in left[near].tolist())
            new = np.isin(label[left], label[left[near]])
        else:
            new = label[left] == label[left[0]]
        reached += left[new].tolist()
        tokens, left = tokens[np.repeat(~new, sizes[left])], left[~new]


def _link_similar(similarity: float):
    """Over rows sorted by cell (key, low, high), of node, root and set. A cell is held whole; it has two blocks at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, roots, sets = None, [], [], []

        def linked() -> pa.RecordBatch:
            found = []
            if len(set(roots)) > 1:
                found = [(nodes[a], nodes[b]) for a, b in similar_links(sets, similarity, np.unique(roots, return_inverse=True)[1])]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for *key, node, root, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "node", "root")), batch.column("set"), strict=True):
                if key != cell:
                    yield linked()
                    cell, nodes, roots, sets = key, [], [], []
                nodes.append(node)
                roots.append(root)
                sets.append(np.frombuffer(raw.as_buffer(), np.uint64))
        yield linked()

    return run


def split_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """members: (key, node, root), buckets with the group of each node so far; sets: `node`, `size` and `set`. Gives (u, v): links across groups.

    Of buckets with the same nodes one is taken. All pairs of a bucket across groups are counted.
    """
    digest = F.sum(F.xxhash64("node").cast("decimal(38,0)"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), digest.alias("digest"), F.min("root").alias("a"), F.max("root").alias("b"))
    buckets = frozen(buckets.where("a <> b").groupBy("digest", "n").agg(F.min("key").alias("key")).select("key", "n"), "split-buckets")
    mine = frozen(joined(members, buckets, ["key"], "n", members.count()), "split-members")
    sizes = mine.join(sets.select("node", "size"), "node").groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")
    cells = (
        joined(mine, frozen(sizes, "split-sizes"), ["key"], "n", mine.count())
        .select("key", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "root")
        .join(sets.select("node", "set"), "node")
    )
    return cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_link_similar(similarity), "u long, v long")


def drop_near_copies(df: DataFrame, *, id: str = "doc_id", text: str = "text", most: int = 6, most_in_all: int = 24, similarity: float = 0.8) -> DataFrame:
    """df with one row of each group of near copies: that with the smallest id (null ids last).

    Near copies are texts whose sets of five-word shingles have a Jaccard of `similarity` at least, and a
    group is a component of them. Candidates share a MinHash band, or their 128-bit SimHashes differ in
    most_in_all bits at most and in `most` at most in one of the two 64-bit words; every link is settled by its exact Jaccard. Texts without words
    (null and empty ones too) are copies of each other; of equal rows one stays. Columns of df stay as they are, whatever their names. An empty table gives an empty one.
    """
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(id).alias("id"), F.col(text).alias("text"))
    # The text is in the row already; a second one would be most of the table.
    work = frozen(sketched(rows).drop("text").withColumn("_row", F.monotonically_increasing_id()), "near-copies")
    first = F.min(F.struct(F.col("_row").alias("node"), F.col("_fp0").alias("fp0"), F.col("_fp1").alias("fp1"), F.col("_bands").alias("bands")))
    kept = F.min(F.struct(F.col("id").isNull().alias("absent"), F.col("id").alias("id"), F.col("_row").alias("row")))
    nodes = frozen(work.groupBy("_set0", "_set1").agg(first.alias("n"), kept.alias("kept")).select("n.*", "kept"), "near-nodes")
    worded = nodes.where(F.size("bands") > 0)
    shared = shared_bands(worded)
    links = (
        near_links(worded.select("node", F.col("fp0").alias("fp"), F.col("fp1").alias("rest")), most, most_in_all=most_in_all)
        .unionByName(near_links(worded.select("node", F.col("fp1").alias("fp"), F.col("fp0").alias("rest")), most, most_in_all=most_in_all))
        .unionByName(shared.select(F.col("node").alias("u"), "v"))
    )
    pairs = frozen(links.where("u <> v").distinct(), "near-pairs")
    wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    texts = kept_by_bits(work.select(F.col("_row").alias("node"), F.col("row").getField(text).alias("text")), wanted, "node")
    sets = frozen(map_texts(texts, "text", ["node"], "size int, set binary", _sets), "shingle-sets")
    alike = frozen(similar_pairs(pairs, sets, similarity), "near-links")
    roots = components(alike)
    members = frozen(shared.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "bucket-groups")
    across = frozen(split_links(members, sets, similarity), "split-links")
    if not across.isEmpty():
        roots = components(across.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    discard(shared, pairs, sets, alike, members, across)
    rooted = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("kept")["row"].alias("_row"))
    return kept_by_bits(work, rooted.select("_row"), "_row").select("row.*")
