"""The library as a whole: loading it with warnings, its totals, and patches that may be refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.operators.catalogue import upserted


def loaded(samples: DataFrame, items: DataFrame, blobs: DataFrame) -> DataFrame:
    """samples: (item_id, file, source); items: (item_id); blobs: (item_id, file). Every sample and blob with `state` and `warning`.

    kept: both are there. missing: a sample without its blob is dropped. recovered: a blob that no sample names is taken in, with that as its source.
    no_item: what belongs to an item that isn't there is dropped. All but kept have a warning.
    """
    known = items.select("item_id").distinct().withColumn("_known", F.lit(True))
    both = samples.withColumn("_s", F.lit(True)).join(blobs.select("item_id", "file").distinct().withColumn("_b", F.lit(True)), ["item_id", "file"], "full_outer").join(known, "item_id", "left")
    state = F.when(F.col("_known").isNull(), "no_item").when(F.col("_s") & F.col("_b"), "kept").when(F.col("_s"), "missing").otherwise("recovered")
    said = {"no_item": "item without metadata: ", "missing": "sample file is missing: ", "recovered": "recovered a sample that no metadata names: "}
    out = both.withColumn("state", state)
    warning = F.concat(F.coalesce(*[F.when(F.col("state") == k, v) for k, v in said.items()]), F.col("file"))
    return out.withColumn("source", F.when(F.col("state") == "recovered", "recovered").otherwise(F.col("source"))).withColumn("warning", warning).drop("_s", "_b", "_known")


def totals(items: DataFrame, samples: DataFrame) -> DataFrame:
    """items: (item_id); samples: (item_id, seconds). One row: how many items, with or without samples, how many samples, and their length in seconds."""
    counted = samples.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("seconds").alias("s"))
    met = items.select("item_id").distinct().join(counted, "item_id", "left")
    return met.agg(F.count("*").alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"))


def refused(patches: DataFrame, items: DataFrame, key: str, required: str) -> DataFrame:
    """The patches that can't be made, and why: their item isn't there, or they leave the required field blank."""
    blank = F.col(required).isNotNull() & (F.regexp_replace(required, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "") == "")
    known = items.select(key).distinct().withColumn("_known", F.lit(True))
    why = F.when(F.col("_known").isNull(), "not found").when(blank, f"{required} is required")
    return patches.join(known, key, "left").withColumn("reason", why).where("reason is not null").drop("_known")


def patched(items: DataFrame, patches: DataFrame, key: str, required: str, at) -> DataFrame:
    """items with the patches that can be made; a refused one changes nothing, updated_at included."""
    good = patches.join(refused(patches, items, key, required).select(key).distinct(), key, "left_anti")
    return upserted(items, good, key, at)
