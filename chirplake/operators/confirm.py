"""Second opinion on a window's first item before the detector commits it: confirm score, rival veto, onset.

Whether a window would be confirmed depends on the window alone, not on what the detector did before. So
the evidence is told for every candidate first, without state, in batches as in streams; the detector
holds it with the candidate and refuses before its timers move. Nothing has to come back to it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chirplake.functions import vectors as V
from chirplake.operators.search import search
from chirplake.operators.series import onset

#: Bound of the variants that every task holds; above it `confirmed_by_search` serves batches.
MOST_BYTES = 64 << 20
LEAST, RIVAL = 0.6, 0.06


def candidates(windows: DataFrame, least_score: float, gate_db: float) -> Column:
    """Rows that the detector could hold: first of their window, loud enough, with a score that some threshold lets pass."""
    return (F.col("rk") == 1) & F.col("item").isNotNull() & (F.col("level") >= gate_db) & (F.col("score") >= least_score)


class Variants:
    """The confirm vectors of all items, sorted by item, on the driver; of a checked size."""

    def __init__(self, variants: DataFrame, most_bytes: int = MOST_BYTES):
        size = variants.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("u")), F.lit(0)).alias("dim")).first()
        if size.n * size.dim * 8 > most_bytes:
            raise ValueError(f"{size.n} variants of {size.dim} values are over {most_bytes} bytes: use confirmed_by_search")
        found = variants.select(F.col("item").cast("string").alias("item"), "u").toPandas().sort_values("item", kind="stable")
        self.items, self.starts = np.unique(found["item"].to_numpy(str), return_index=True)
        self.matrix = np.stack(found["u"].to_numpy()).astype(float) if len(found) else np.zeros((0, 0))

    def accept(self, items: list[str], v: np.ndarray, least: float, rival: float) -> np.ndarray:
        """Whether each vector is near enough to its item's variants, and not nearly as near to another item's."""
        if not len(self.items):
            return np.zeros(len(items), bool)
        best = np.maximum.reduceat(np.round(np.clip(v @ self.matrix.T, -1, 1), 9), self.starts, axis=1)
        at = np.searchsorted(self.items, items)
        known = (at < len(self.items)) & (self.items[np.minimum(at, len(self.items) - 1)] == items)
        rows = np.arange(len(items))
        win = np.where(known, best[rows, np.minimum(at, len(self.items) - 1)], -1.0)
        best[rows[known], at[known]] = -np.inf
        return (win >= least) & ~(best.max(axis=1) > np.round(win - rival, 9))


def with_evidence(windows: DataFrame, variants: Variants, least: float = LEAST, rival: float = RIVAL, rise_db: float = 2.5, least_score: float = 0.0, gate_db: float = -60.0) -> DataFrame:
    """windows: a table or a stream of (rk, level, item, score, v, energies). Adds accept and onset; v and energies are dropped.

    accept is told for candidates (null for others): an empty or null v is refused, as is an item without variants. onset is told
    for each window's first row from the energies of its last frames, null where there are none.
    """
    context = windows.sparkSession.sparkContext
    shared = context.broadcast(variants)

    @F.pandas_udf("boolean")
    def accepted(item: pd.Series, v: pd.Series) -> pd.Series:
        dim = shared.value.matrix.shape[1]
        fine = np.array([x is not None and len(x) == dim and dim > 0 for x in v], bool)
        out = np.zeros(len(item), bool)
        if fine.any():
            out[fine] = shared.value.accept([str(i) for i in item[fine]], np.stack(v[fine].to_numpy()).astype(float), least, rival)
        return pd.Series(out)

    told = F.when(candidates(windows, least_score, gate_db), accepted(F.col("item").cast("string"), F.col("v")))
    set_in = F.when(F.col("rk") == 1, F.when(F.col("energies").isNotNull(), onset(F.col("energies"), rise_db)))
    return windows.withColumn("accept", told).withColumn("onset", set_in).drop("v", "energies")


def confirmed_by_search(windows: DataFrame, variants: DataFrame, least: float = LEAST, rival: float = RIVAL) -> DataFrame:
    """windows: (window_id, item, v); variants: (variant_id, item, u), of any number. confirm, the best cosine with the own item's variants (-1 without
    any), rival, the best with another item's, and accept, by the product in tiles of the template search."""
    table = variants.select(F.col("variant_id").cast("long").alias("template_id"), F.col("item").cast("long").alias("item"), V.doubles(F.col("u")).alias("q"), F.lit(1.0).alias("scale"))
    hits = search(windows.select("window_id", "v"), table).withColumnRenamed("item", "other")
    met = windows.select("window_id", F.col("item").cast("long").alias("item")).join(hits, "window_id", "left")
    own = F.col("other") == F.col("item")
    best = met.groupBy("window_id", "item").agg(F.coalesce(F.max(F.when(own, F.col("score"))), F.lit(-1.0)).alias("confirm"), F.max(F.when(~own, F.col("score"))).alias("rival"))
    return best.withColumn("accept", (F.col("confirm") >= least) & ~F.coalesce(F.col("rival") > F.round(F.col("confirm") - rival, 9), F.lit(False)))
