"""Whitening of vectors by principal components, from a Golub-Kahan-Lanczos bidiagonalisation.

The centred rows X stay in tasks. A step is one job: tasks multiply X with a vector v and the transpose
of X with what comes out, u. Both sides are reorthogonalised in full. A left vector has an entry for
each row, so it is kept as the short w with u = X w, from which tasks make it again; the driver
holds only vectors of the rows' dimension. The SVD of the small bidiagonal matrix gives components and deviations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirplake.llm.store import discard, frozen

#: Whole numbers that stand for the entries: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Bytes of a block of rows; blocks whose partial results the driver gets as they are (a few kB each), above which Spark sums them first.
BLOCK_BYTES, MOST_PARTS = 4 << 20, 4096
#: Up to this dimension the bidiagonalisation runs to its end, which finds repeated eigenvalues too; beyond, it ends when the components have converged.
FULL = 256
EPS = float(np.finfo(float).eps)


@dataclass
class Whitener:
    """What rows are whitened with: their count, the sums by dimension, components as columns, their variances and the sum of all variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        return self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n x - S)^2 of each row; None where it is no 64-bit number."""
        rough = ((self.n * x.astype(float) - np.array(self.sums, float)) ** 2).sum(1)
        small = (rough < 2.0**62) & (self.n * np.abs(x).max(1, initial=0).astype(float) < 2.0**62)
        out: list[int | None] = [None] * len(x)
        for k, v in zip(np.flatnonzero(small), ((self.n * x[small] - np.array(self.sums if small.any() else 0, np.int64)) ** 2).sum(1).tolist()):
            out[k] = v
        for k in np.flatnonzero(~small & (rough < 1.001 * 2.0**63)):
            exact = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[k], self.sums))
            out[k] = exact if exact < 2**63 else None
        return out


def whole(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of vectors the places of those of `dim` finite entries, and these as whole numbers."""
    lengths = np.array(column.value_lengths().fill_null(-1))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    at = np.flatnonzero(lengths == dim)
    values = flat[(starts[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
    fine = np.isfinite(values).all(1)
    return at[fine], np.floor(SCALE * values[fine]).astype(np.int64) + OFFSET


def blocks(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Frozen blocks of the rows' whole numbers: n, sums by dimension, and the numbers in the fewest bytes that hold them."""
    rows = max(1, BLOCK_BYTES // (8 * dim))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x = whole(batch.column(0), dim)
            parts = [x[k : k + rows] for k in range(0, len(x), rows)]
            held = [p.astype(np.int32) if np.abs(p).max() < 2**31 else p for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array(map(len, parts), pa.int64()), pa.array([p.sum(0) for p in parts], pa.list_(pa.int64())), pa.array([p.tobytes() for p in held], pa.binary())], ["n", "sums", "x"])

    return frozen(df.select(vector).mapInArrow(packed, "n long, sums array<long>, x binary"), "whitening-blocks")


class Rows:
    """The centred rows of frozen blocks, for products in tasks."""

    def __init__(self, table: DataFrame, dim: int):
        self.table, self.dim = table, dim
        found = table.agg(F.count("*").alias("parts"), F.sum("n").alias("n")).first()
        self.parts, self.n = found.parts, found.n or 0
        sums = table.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.sums = [int(r.s) for r in sorted(sums, key=lambda r: r.at)]
        self.mean = np.array([s / self.n for s in self.sums])

    def summed(self, work) -> np.ndarray:
        """The sum of work(centred rows) over all blocks."""
        dim, mean = self.dim, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for n, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(raw.as_buffer(), np.int32 if raw.as_buffer().size == 4 * n * dim else np.int64).reshape(n, dim)
                    part = work(x - mean)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["part"])

        parts = self.table.select("n", "x").mapInArrow(run, "part array<double>")
        if self.parts > MOST_PARTS:
            rows = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
            return np.array([r.v for r in sorted(rows, key=lambda r: r.at)])
        return np.array([math.fsum(c) for c in zip(*(r.part for r in parts.collect()))])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """v without its parts along the basis, taken out twice."""
    q = np.array(basis).reshape(-1, len(v))
    for _ in range(2):
        v = v - q.T @ (q @ v)
    return v


def bidiagonal(rows: Rows, components: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the centred rows, as columns, and singular values, by falling value."""
    dim, random = rows.dim, np.random.default_rng(seed)
    right: list[np.ndarray] = []  # v
    short: list[np.ndarray] = []  # w with u = X w
    back: list[np.ndarray] = []  # z = X' u
    alphas, betas, largest = [], [0.0], 0.0
    v = random.standard_normal(dim)
    v /= np.linalg.norm(v)
    while True:
        right.append(v)
        w = v - betas[-1] * short[-1] if short else v
        left = np.column_stack([*short, w])

        def step(x: np.ndarray, left: np.ndarray = left) -> np.ndarray:
            u = x @ left
            return np.concatenate([u.T @ u[:, -1], x.T @ u[:, -1]])

        found = rows.summed(step)
        along, square, z = found[: len(short)], found[len(short)], found[len(short) + 1 :]
        for g, old, old_z in zip(along, short, back):
            w, z, square = w - g * old, z - g * old_z, square - g * g
        alpha = math.sqrt(max(square, 0.0))
        largest = max(largest, alpha)
        if alpha <= dim * EPS * largest:
            alpha, w, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha)
        short.append(w)
        back.append(z)
        k = len(right)
        rest = _orthogonal(z - alpha * v, right)
        beta = float(np.linalg.norm(rest))
        p, values, q = np.linalg.svd(np.diag(alphas) + np.diag(betas[1:], 1))
        done = k == dim or (dim > FULL and k >= components and beta * np.abs(p[-1, :components]).max() <= 4 * EPS * values[0])
        if done:
            vectors = np.array(right).T @ q.T
            return vectors / np.linalg.norm(vectors, axis=0), values
        if beta <= dim * EPS * largest:
            # What has been reached is closed under X'X: go on in the rest.
            beta, rest = 0.0, _orthogonal(random.standard_normal(dim), right)
        v = rest / np.linalg.norm(rest)
        betas.append(beta)


def fit(df: DataFrame, *, vector: str, components: int = 8) -> Whitener | None:
    """The whitener of all vectors of df with as many entries as most have, all finite; None where there are none.

    Components of no variance (under 1e-12 of the largest) are left out; the first large entry of each is positive.
    """
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    most = df.where(finite & (F.size(vector) > 0)).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    rows = Rows(blocks(df, vector, most.dim), most.dim)
    vectors, values = bidiagonal(rows, components)
    variances = values**2 / rows.n
    kept = min(components, int((variances > 1e-12 * max(variances[0], 1e-300)).sum()))
    vectors, variances = vectors[:, :kept], variances[:kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(kept)]) if kept else np.ones(0)
    out = Whitener(rows.n, rows.sums, vectors * signs, variances, 0.0, None)
    scaled = out.scaled

    def spread(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.concatenate([[(x * x).sum()], y.sum(0), (y.T @ y).ravel()])

    found = rows.summed(spread) / rows.n
    means = found[1 : 1 + kept]
    covariance = found[1 + kept :].reshape(kept, kept) - np.outer(means, means)
    out.trace = float(found[0])
    out.identity_error = float(np.abs(covariance - np.eye(kept)).max()) if kept else None
    discard(rows.table)
    return out


ADDED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, model: Whitener | None, *, vector: str, carry: list[str]) -> DataFrame:
    """The carry columns of each fitting row once for each component, with component (from 1), n, deviation, whitened, explained and identity_error.

    Rows whose vector is null, holds null or non-finite entries or hasn't the model's dimension have no rows here; nor has any row where no component has
    variance. Equal rows are rows of their own. deviation is null where it is no 64-bit number. Columns of df with a name that is added are replaced. An empty table gives an empty one.
    """
    names = [f.name for f in T.StructType.fromDDL(ADDED)]
    carry = [c for c in carry if c.lower() not in names]
    docs = df.select(F.struct(*carry).alias("_carried"), F.col(vector).alias("_vector"))
    schema = T.StructType([docs.schema["_carried"], *T.StructType.fromDDL(ADDED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        for batch in batches:
            at, x = whole(batch.column("_vector"), len(model.sums))
            y = (x - model.mean) @ model.scaled
            repeat = np.repeat(np.arange(len(at)), k)
            deviations = pa.array(model.deviations(x), pa.int64()).take(pa.array(repeat))
            n = len(repeat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_carried").take(pa.array(at[repeat])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(n, model.n)), deviations, pa.array(y.ravel()), pa.array(np.tile(model.variances / model.trace, len(at))), pa.array(np.full(n, model.identity_error))],
                [f.name for f in schema],
            )

    if model is None or not len(model.variances):
        docs = docs.limit(0)
    return docs.mapInArrow(run, schema).select(*[F.col("_carried")[c].alias(c) for c in carry], *names)
