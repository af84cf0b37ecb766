"""Mixing sources to target weights by Efraimidis-Spirakis sampling, on DataFrame expressions only.

Each document gets the key -ln(u) / quality, u a uniform number from a digest of its identity:
in ascending order of these keys every prefix of a source is a weighted sample without
replacement. A source's token target is met by whole epochs first, then by the prefix that
the rest of the budget pays for. Order and prefix sums are built in two steps: ranges
of the key are summed and accumulated for each source, and rows are only sorted within one
range. The ranges are cut at percentiles of each source's own keys, so that a source with a third of
all rows is spread over as many ranges as its rows need, whatever its qualities are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.llm.store import WORD, frozen, joined


#: Ranges of a source by percentiles of its keys.
BANDS = 32
#: Up to so many sources, their cut points (some hundred bytes each) are broadcast.
MOST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def symbol_quality(text: Column) -> Column:
    """From 0.1 (a tenth or more of the characters are mark-up symbols) to 1; null and empty texts have 1."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1.0 - 9.0 * symbols / F.greatest(F.length(text), F.lit(1))), F.lit(1.0))


def uniform(*identity: Column) -> Column:
    """In (0, 1), from the first 52 bits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in identity])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sums: DataFrame, pattern: Sequence[int], share: float, most: float) -> DataFrame:
    """sums: (src, source_size). Adds target: the sources' weights share `share` of all sizes, none above `most` times its own.

    The excess of capped sources is shared again by weight until none is above, which is filling
    to one level: sources are capped in order of size / weight up to the first whose level fits.
    """
    every = Window.orderBy("src")
    order = Window.orderBy(F.col("ratio"), "src")
    all_rows = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap, weight = F.col("cap"), F.col("weight")
    return (
        sums.withColumn("nth", F.row_number().over(every) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in pattern]), (F.col("nth") % len(pattern) + 1).cast("int")))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", cap / weight)
        .withColumn("free", F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("level", F.col("free") / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(all_rows)["level"])
        .select("src", "source_size", F.least(cap, weight * F.coalesce("level", F.lit(0.0))).alias("target"))
    )


def mix_sources(
    df: DataFrame,
    *,
    source: str,
    size: Column,
    quality: Column,
    identity: Sequence[str],
    carry: Sequence[str],
    pattern: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    rows_per_range: int = 5_000,
) -> DataFrame:
    """The `carry` columns of every row, with size, source_size, target and taken, the units of its size that the mix takes.

    taken is whole epochs times size, plus size for the rows that the prefix holds; the one row
    on which a source's budget ends gives the units that are left, so that sources meet their
    targets to the unit.

    Null sources form one source, placed last. Rows of size 0 (null or empty texts) take 0. Equal
    identities get equal keys and are ordered by size; reruns agree. Columns of df with one of
    the four names are replaced. An empty table gives an empty one.
    """
    src = F.struct(F.col(source).isNull().alias("absent"), F.coalesce(source, F.lit("")).alias("name"))
    key = -F.log(uniform(F.lit(seed), *[F.col(c) for c in identity])) / quality
    work = frozen(df.select(F.struct(*carry).alias("row"), src.alias("src"), size.cast("long").alias("size"), key.alias("key"), F.struct(*identity).alias("who")), "mix-input")
    # Of each source its rows, its greatest key and BANDS - 1 cut points: a row of fixed size.
    shape = work.groupBy("src").agg(F.count("*").alias("rows"), F.max("key").alias("last"), F.percentile_approx("key", [k / BANDS for k in range(1, BANDS)], 1000).alias("cuts"))
    shape = frozen(shape, "mix-sources")
    sources = shape.count()
    subs = F.ceil(F.col("rows") / (BANDS * rows_per_range))  # a band of the greatest sources is cut evenly once more
    band = F.when(F.col("rows") > rows_per_range, F.size(F.filter("cuts", lambda c: c < F.col("key")))).otherwise(0)
    low, high = F.when(F.col("band") > 0, F.get("cuts", F.col("band") - 1)).otherwise(0.0), F.coalesce(F.get("cuts", F.col("band")), F.col("last"))
    sub = F.when((F.col("subs") > 1) & (high > low), F.least(F.col("subs") - 1, F.floor((F.col("key") - low) / (high - low) * F.col("subs")))).otherwise(0)
    placed = work.join(F.broadcast(shape), "src") if sources <= MOST_SOURCES else joined(work, shape.withColumn("n", F.col("rows")), ["src"], "n", work.count())
    placed = placed.withColumn("band", band).withColumn("subs", subs)
    work = placed.withColumn("range", (F.col("band") * F.col("subs") + sub).cast("int")).select("row", "src", "size", "key", "who", "range")

    parts = frozen(work.groupBy("src", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    targets = source_targets(parts.groupBy("src").agg(F.sum("words").alias("source_size")), pattern, share, most)
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    plan = (
        parts.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .join(targets, "src")
        .select("src", "range", "offset", "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("rest"))
    )
    upto = Window.partitionBy("src", "range").orderBy("key", "who", "size").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("offset") + F.sum("size").over(upto)
    names = [c for c in carry if c.lower() not in ("size", "source_size", "target", "taken")]
    return (
        work.join(plan, ["src", "range"])
        .withColumn("begin", end - F.col("size"))
        .withColumn("part", F.greatest(F.lit(0), F.least("size", F.floor("rest") - F.col("begin"))))
        .withColumn("taken", F.least(F.lit(int(most)) * F.col("size"), F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
        .select(*[F.col("row")[c].alias(c) for c in names], "size", "source_size", "target", "taken")
    )
