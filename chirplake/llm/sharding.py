"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows of each input partition are permuted locally (a sort on a hash, no exchange) and
frozen with their place. How many rows of each partition each shard gets is drawn before any
row moves: a matrix whose rows sum to the partitions' sizes and whose columns sum to the
shards' sizes, with the multivariate hypergeometric law that a uniform permutation of all
rows has. The draws are made in two levels (groups of about sqrt(P) partitions, then the
partitions of each group, in parallel). Rows then move once and are permuted again in their
shard. All of it is DataFrame and SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.store import frozen

#: A matrix or offset table up to this many bytes is broadcast; a larger one is joined by exchange.
BROADCAST_BYTES = 32 << 20


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hypergeometric(pool: str, good: str, drawn: str, u: str) -> str:
    """SQL for an exact draw of how many of `drawn` rows out of `pool` are among `good`, from a uniform u.

    Inversion outwards from the mode: weights follow from one to the next by the ratio of
    neighbouring probabilities, so that no factorial is needed and precision holds at any size.
    The walk ends 12 standard deviations out, beyond which a double holds no mass.
    """
    up = "((h.g - k) * (h.n - k)) / ((k + 1D) * (h.p - h.g - h.n + k + 1D))"
    down = "(k * (h.p - h.g - h.n + k)) / ((h.g - k + 1D) * (h.n - k + 1D))"

    def total(steps: str, ratio: str) -> str:
        return f"aggregate({steps}, named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w * {ratio}), a -> a.s)"

    def walk(steps: str, ratio: str, left: str, to: str) -> str:
        return (
            f"aggregate({steps}, named_struct('w', 1D, 'left', {left}, 'at', h.mid), (a, k) -> if(a.left < 0, a, "
            f"named_struct('w', a.w * {ratio}, 'left', a.left - a.w * {ratio}, 'at', {to})), a -> a.at)"
        )

    ups = "if(h.hi > h.mid, sequence(h.mid, h.hi - 1), cast(array() as array<bigint>))"
    downs = "if(h.lo < h.mid, sequence(h.mid, h.lo + 1, -1L), cast(array() as array<bigint>))"
    picked = _let(
        f"named_struct('up', {total(ups, up)}, 'down', {total(downs, down)})",
        "s",
        _let(
            "h.u * (1D + s.up + s.down) - 1D",
            "t",
            f"case when t < 0 then h.mid when t < s.up then {walk(ups, up, 't', 'k + 1')} else {walk(downs, down, 't - s.up', 'k - 1')} end",
        ),
    )
    spread = f"sqrt(1D * {drawn} * {good} / greatest({pool}, 1) * ({pool} - {good}) / greatest({pool}, 1) * ({pool} - {drawn}) / greatest({pool} - 1, 1))"
    bounds = (
        f"named_struct('p', {pool}, 'g', {good}, 'n', {drawn}, 'u', {u}, 'lo', greatest(0L, {drawn} - ({pool} - {good})), 'hi', least({drawn}, {good}), "
        f"'mid', cast(floor(({drawn} + 1D) * ({good} + 1D) / ({pool} + 2D)) as bigint), 'width', cast(16 + ceil(12 * {spread}) as bigint))"
    )
    centred = "named_struct('p', 1D * b.p, 'g', 1D * b.g, 'n', 1D * b.n, 'u', b.u, 'mid', m, 'lo', greatest(b.lo, m - b.width), 'hi', least(b.hi, m + b.width))"
    return _let(bounds, "b", _let("least(b.hi, greatest(b.lo, b.mid))", "m", _let(centred, "h", picked)))


def _draw_rows(parts: str, caps: str, level: int, seed: int) -> str:
    """SQL: folds over parts (id, m) and gives for each the counts that go to each shard, out of the shards' free places."""
    u = f"(pmod(xxhash64({seed}L, {level}L, p.id, j), 4503599627370496L) + 0.5D) / 4503599627370496D"
    cell = _let(_hypergeometric("c.pool", "cap", "c.left", u), "x", "named_struct('left', c.left - x, 'pool', c.pool - cap, 'out', concat(c.out, array(x)))")
    row = (
        "aggregate(sequence(1, size(acc.caps)), named_struct('left', p.m, 'pool', aggregate(acc.caps, 0L, (s, v) -> s + v), 'out', cast(array() as array<bigint>)), "
        f"(c, j) -> {_let('element_at(acc.caps, j)', 'cap', cell)}, c -> c.out)"
    )
    placed = _let(row, "r", "named_struct('caps', zip_with(acc.caps, r, (v, x) -> v - x), 'rows', concat(acc.rows, array(named_struct('id', p.id, 'counts', r))))")
    return f"aggregate({parts}, named_struct('caps', {caps}, 'rows', cast(array() as array<struct<id:bigint,counts:array<bigint>>>)), (acc, p) -> {placed}, acc -> acc.rows)"


def communication_matrix(sizes: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """sizes: (id long, m long), a row for each partition. Gives (id, counts): counts[j] rows of it go to shard j.

    Shards' sizes differ by at most one. Groups have about sqrt(P) partitions, so that neither
    the top draw nor any group's is long. An empty table gives an empty matrix.
    """
    top = sizes.agg(F.max("id").alias("top")).first()["top"]
    width = max(1, math.isqrt((top or 0) + 1))
    groups = sizes.groupBy(F.expr(f"id div {width}").alias("id")).agg(F.sum("m").alias("m"), F.sort_array(F.collect_list(F.struct("id", "m"))).alias("parts"))
    caps = f"transform(sequence(0L, {n_shards - 1}L), j -> (n div {n_shards}) + if(j < n % {n_shards}, 1L, 0L))"
    drawn = (
        groups.agg(F.sum("m").alias("n"), F.sort_array(F.collect_list(F.struct("id", "m"))).alias("nodes"))
        .where("n is not null")
        .select(F.explode(F.expr(_draw_rows("nodes", caps, 1, seed))).alias("d"))
        .select("d.id", "d.counts")
    )
    return groups.join(drawn, "id").select(F.explode(F.expr(_draw_rows("parts", "counts", 2, seed))).alias("d")).select("d.id", "d.counts")


def _small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def uniform_shards(df: DataFrame, n_shards: int, seed: int = 11, rows_per_task: int = 50_000) -> DataFrame:
    """df with `shard` int (0 to n_shards - 1) and `slot` long (gapless from 0 in each shard).

    Every permutation of the rows is equally likely up to the hash; shards' sizes differ by at
    most one. Nulls in any column, equal rows and empty texts are rows like any other: a row's
    place depends on its partition and position, never on what it holds, so that no value
    is hot and copies of a row spread over the shards as any rows do. Columns of df named shard or slot are replaced. An empty table gives an empty one.
    """
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    work = frozen(
        # The place is hashed, not the row: equal rows are as far apart as any others.
        df.select(F.struct(*kept).alias("row"), F.monotonically_increasing_id().alias("place"))
        .sortWithinPartitions(F.xxhash64(F.lit(seed), "place"))
        .select(F.monotonically_increasing_id().alias("at"), "row")
        .select(F.shiftright("at", 33).alias("id"), F.expr("at & 8589934591L").alias("pos"), "row"),
        "shard-input",
    )
    sizes = work.groupBy("id").agg(F.count("*").alias("m"))
    matrix = frozen(communication_matrix(sizes, n_shards, seed).select("id", F.expr("transform(sequence(1, size(counts)), j -> aggregate(slice(counts, 1, j), 0L, (s, v) -> s + v))").alias("upto")), "shard-matrix")
    facts = matrix.agg(F.count("*").alias("parts"), F.sum(F.element_at("upto", -1)).alias("n")).first()
    subs = max(1, math.ceil((facts["n"] or 0) / n_shards / rows_per_task))

    def placed(rows: DataFrame) -> DataFrame:
        key: Column = F.xxhash64(F.lit(seed + 1), "id", "pos")
        return (
            rows.join(_small(matrix, facts["parts"], 8 * n_shards + 64), "id")
            .withColumn("shard", F.expr("size(filter(upto, c -> c <= pos))"))
            .drop("upto")
            .withColumn("key", key)
            .withColumn("sub", F.pmod("key", F.lit(subs)).cast("int"))
        )

    counts = placed(work.select("id", "pos")).groupBy("shard", "sub").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "sub", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "sub").orderBy("key", "id", "pos")
    moved = placed(work).withColumn("nth", F.row_number().over(within))
    return moved.join(_small(offsets, n_shards * subs, 64), ["shard", "sub"]).select("row.*", "shard", (F.col("offset") + F.col("nth") - 1).alias("slot"))
