"""Merkle manifest of a table: a hash tree over the rows of each group, one over the groups' roots, and each row's proof.

Every row keeps its place. At each level the nodes stand in the rows of their first leaves; lag and
lead by the level's fixed offset, masked by the slot and by the length of the run, show a node its
sibling, and the row of a first child hashes the parent. LEVELS levels share one window over blocks
of 2^LEVELS neighbours; the blocks' tops are the leaves of the next round. So no task holds a
group, and a table of 10^12 rows takes four rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.store import frozen, joined

#: Levels of one round; a window partition has 2 to this power rows at most.
LEVELS = 10
SIDE = "struct<left: boolean, node: string>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as text behind its UTF-8 byte count and a colon; `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return sha256(*map(field, values))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf gives with its proof; a lone node of a level has an empty sibling."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.when(s["left"], F.concat(s["node"], at)).otherwise(F.concat(at, s["node"])), 256))


def proof_nodes(proof: Column) -> Column:
    """The siblings of a proof as one text, from the leaf's to the root's."""
    return F.array_join(F.transform(proof, lambda s: s["node"]), "")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with _group) with their place in the group, _pos from 0, and its _count: sorted by range, counted by range and group."""
    keys = ["_group", *order, "_row"]
    rows = frozen(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-leaves")
    # Ids of a sorted partition rise by one from the partition's number times 2^33.
    ranged = frozen(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_row"), "merkle-order")
    ranged = ranged.withColumn("_part", F.shiftrightunsigned("_at", 33))
    parts = ranged.groupBy("_group", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_group", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_count"))
    return ranged.join(starts, ["_group", "_part"]).withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def climbed(rows: DataFrame) -> DataFrame:
    """rows (_group, _pos, _count, _node) with _block, _top (in the first row of a block) and _path, the siblings up to the block's top."""
    rows = rows.withColumns({"_block": F.shiftright("_pos", LEVELS), "_top": F.col("_node")})
    block = Window.partitionBy("_group", "_block").orderBy("_pos")
    node = F.col("_top")
    for level in range(LEVELS):
        step = 1 << level
        slot, run = F.col("_pos").bitwiseAND(2 * step - 1), F.col("_count") > step
        right = F.coalesce(F.lead(node, step).over(block), F.lit(""))
        first, second = F.struct(F.lit(False).alias("left"), right.alias("node")), F.struct(F.lit(True).alias("left"), F.lag(node, step).over(block).alias("node"))
        sibling = F.when(run & (slot == 0), first).when(run & (slot == step), second).cast(SIDE)
        rows = rows.withColumns({f"_side{level}": sibling, "_top": F.when(slot == 0, F.when(run, sha256(node, right)).otherwise(node))})
    # The last row so far with a sibling of some level stands for the row's ancestor of that level.
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [f"_side{k}" for k in range(LEVELS)]
    rows = rows.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in sides})
    return rows.withColumn("_path", F.array_compact(F.array(*sides))).drop(*sides)


def grown(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (_group, _pos, _count, _node and others) with _path up to _root, and a row for each group: _group and _root."""
    up = climbed(rows)
    size = 1 << LEVELS
    tops = up.where(F.col("_pos").bitwiseAND(size - 1) == 0)
    tops = frozen(tops.select("_group", F.col("_block").alias("_pos"), F.ceil(F.col("_count") / size).cast("long").alias("_count"), F.col("_top").alias("_node")), "merkle-tops")
    if (tops.agg(F.max("_count")).first()[0] or 0) > 1:
        above, roots = grown(tops)
        above = above.select("_group", F.col("_pos").alias("_block"), F.col("_path").alias("_above"), "_root")
    else:
        above = tops.select("_group", F.col("_pos").alias("_block"), F.array().cast(f"array<{SIDE}>").alias("_above"), F.col("_node").alias("_root"))
        roots = tops.select("_group", F.col("_node").alias("_root"))
    return up.join(above, ["_group", "_block"]).withColumn("_path", F.concat("_path", "_above")).drop("_top", "_block", "_above"), roots


def manifest(df: DataFrame, *, group: str, order: list[str], leaf: Column, carry: list[str]) -> DataFrame:
    """The carry columns with leaf, subroot, root and proof (siblings from the leaf's up to the root's).

    The rows of a group ascend by `order` (nulls first; ties by leaf, so that equal rows are
    interchangeable); pairs of nodes give the next level, a node without a neighbour is hashed alone,
    and a single leaf is its group's root. Groups ascend by their value as text, UTF-8 bytewise, null
    first, and their roots give the root likewise. `leaf` must not be null; carry columns with a name
    that is added here are replaced. An empty table gives an empty one.
    """
    carry = [c for c in carry if c.lower() not in ("leaf", "subroot", "root", "proof")]
    # A sign before the text keeps the null group and the empty one apart, and the null group first.
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    sort = [f"_o{k}" for k in range(len(order))]
    rows = df.select(F.struct(*carry).alias("_carried"), key.alias("_group"), leaf.alias("_node"), *[F.col(c).alias(s) for c, s in zip(order, sort)])
    rows = numbered(rows, [*sort, "_node"]).drop(*sort)
    sizes = rows.where("_pos = 0").select("_group", F.col("_count").alias("_size"))
    rows, roots = grown(rows)
    groups = roots.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("_root").alias("_node"))
    groups, _ = grown(numbered(groups, ["_name"]))
    groups = groups.select(F.col("_name").alias("_group"), F.col("_path").alias("_over"), F.col("_root").alias("root")).join(sizes, "_group")
    total = df.count()
    done = joined(rows.withColumnsRenamed({"_node": "leaf", "_root": "subroot"}), groups, ["_group"], "_size", total)
    return done.select(*[F.col("_carried")[c].alias(c) for c in carry], "leaf", "subroot", "root", F.concat("_path", "_over").alias("proof"))
