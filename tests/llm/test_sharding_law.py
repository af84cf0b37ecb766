"""The shuffle as a law: copies of a row spread as any rows do, and every arrangement of a few rows is as likely as any other."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from chirplake.llm.sharding import uniform_shards


def test_copies_spread_over_all_shards(spark):
    """Half of 2,400 rows are equal: over 6 seeds each of 24 shards has 50 of them on average, by chance alone."""
    df = spark.range(2400, numPartitions=4).select(F.when(F.col("id") % 2 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("v"))
    squares, runs = 0.0, 6
    for seed in range(runs):
        found = {r.shard: r.n for r in uniform_shards(df, 24, seed=seed).where("v = 'copy'").groupBy("shard").agg(F.count("*").alias("n")).collect()}
        assert sum(found.values()) == 1200
        squares += sum((found.get(s, 0) - 50) ** 2 for s in range(24))
    # Of 100 rows a shard half are copies: variance 100 / 4 * (1 - 1 / 24); 144 shards give it within a third.
    expected = 25 * (1 - 100 / 2400)
    assert 0.67 * expected < squares / (24 * runs) < 1.4 * expected


def test_all_splits_of_a_few_rows_are_as_likely(spark):
    """Four rows in two partitions and two shards: each of the six ways to choose a shard's two rows."""
    df = spark.range(4, numPartitions=2)
    runs, ways = 24, list(combinations(range(4), 2))
    seen = Counter(tuple(sorted(r.id for r in uniform_shards(df, 2, seed=seed).where("shard = 0").collect())) for seed in range(runs))
    assert set(seen) <= set(ways)
    assert sum((seen[w] - runs / 6) ** 2 / (runs / 6) for w in ways) < 20.5  # 5 degrees of freedom, one in a thousand
