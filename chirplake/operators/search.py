"""Exact template search and what follows from its scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.functions import vectors as V

#: Templates that one task compares with a block of windows.
TEMPLATES = 32_768
WINDOWS = 8_192
#: Windows and templates of which a task holds all scores at once: 16 MB.
TILE = (512, 4_096)
HITS = "window_id long, item long, template_id long, score double"


def template_table(samples: DataFrame, *, id: str, item: str, vector: str) -> DataFrame:
    """(template_id, item, q, scale) with int8 codes."""
    v = samples.select(F.col(id).alias("template_id"), F.col(item).cast("long").alias("item"), V.doubles(F.col(vector)).alias("v"))
    v = v.withColumn("scale", V.scale_of(F.col("v")))
    return v.select("template_id", "item", V.quantise(F.col("v"), F.col("scale")).cast("array<tinyint>").alias("q"), "scale")


def _best_in_block(windows: pd.DataFrame, templates: pd.DataFrame) -> pd.DataFrame:
    """The best template of each item for each window; the smallest id on ties. Scores are held for one tile at a time."""
    if windows.empty or templates.empty:
        return pd.DataFrame({"window_id": [], "item": [], "template_id": [], "score": []})
    templates = templates.sort_values(["item", "template_id"])
    q, scale = np.stack(templates["q"].to_numpy()), templates["scale"].to_numpy()
    items, ids = templates["item"].to_numpy(), templates["template_id"].to_numpy()
    names, owner = np.unique(items, return_inverse=True)
    parts = []
    for w in range(0, len(windows), TILE[0]):
        v = np.stack(windows["v"].iloc[w : w + TILE[0]].to_numpy()).astype(np.float64)
        best, at = np.full((len(v), len(names)), -np.inf), np.zeros((len(v), len(names)), np.int64)
        for t in range(0, len(ids), TILE[1]):
            score = np.round(np.clip((v @ q[t : t + TILE[1]].astype(np.float64).T) * scale[t : t + TILE[1]], -1, 1), 9)
            mine = owner[t : t + TILE[1]]
            starts = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            for a, b in zip(starts, [*starts[1:], len(mine)], strict=True):
                k = score[:, a:b].argmax(axis=1)
                top = score[np.arange(len(v)), a + k]
                higher = top > best[:, mine[a]]
                best[higher, mine[a]], at[higher, mine[a]] = top[higher], t + a + k[higher]
        parts.append(pd.DataFrame({"window_id": np.repeat(windows["window_id"].to_numpy()[w : w + TILE[0]], len(names)), "item": np.tile(names, len(v)), "template_id": ids[at.ravel()], "score": best.ravel()}))
    return pd.concat(parts)


#: Bound of the templates that every task holds; above it windows and templates meet in blocks.
MOST_BYTES = 32 << 20
#: Templates of one pivot, on average, and rounds that settle the pivots.
PER_PIVOT, ROUNDS = 64, 4
#: What rounding may add to a score.
SLACK = 2e-9


class Pivots:
    """Templates of a checked size in groups around pivots, each of one item. By the triangle inequality of angles a window's score with a
    group's members is at most that at the angle to the pivot less the group's radius, so that whole groups can be left out; results stay exact."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, items: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, items))
        q, scale, items, ids = q[order].astype(np.float64), scale[order], items[order], ids[order]
        parts = [rows[part] for rows in np.split(np.arange(len(items)), np.flatnonzero(np.diff(items)) + 1) if len(rows) for part in self._grouped(q[rows])]
        self.items = np.unique(items)
        self.owner = np.searchsorted(self.items, items[[p[0] for p in parts]]) if parts else np.zeros(0, int)
        self.groups = [(q[p], scale[p], ids[p]) for p in parts]
        dim = q.shape[1] if q.ndim == 2 else 0
        self.centres, self.radii, self.least, self.most = np.zeros((len(parts), dim)), np.zeros(len(parts)), np.zeros(len(parts)), np.zeros(len(parts))
        for k, (codes, steps, _) in enumerate(self.groups):
            t = codes * steps[:, None]
            norms = np.linalg.norm(t, axis=1)
            unit = t / np.maximum(norms, 1e-300)[:, None]
            centre = unit.sum(0)
            self.centres[k] = centre / max(np.linalg.norm(centre), 1e-300)
            # A zero template scores 0 with all: its group is never left out.
            self.radii[k] = np.pi if (norms == 0).any() else np.arccos(np.clip(unit @ self.centres[k], -1, 1)).max() + 1e-7
            self.least[k], self.most[k] = norms.min(), norms.max()

    @staticmethod
    def _grouped(q: np.ndarray) -> list[np.ndarray]:
        """Places of one item's templates in groups of near ones: a few rounds of means from evenly spaced starts; places ascend within a group."""
        n = -(-len(q) // PER_PIVOT)
        unit = q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
        centres = unit[np.linspace(0, len(q) - 1, n).astype(int)]
        for _ in range(ROUNDS):
            at = (unit @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, unit)
            norms = np.linalg.norm(sums, axis=1)
            centres = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centres)
        at = (unit @ centres.T).argmax(1)
        return [np.flatnonzero(at == k) for k in range(n) if (at == k).any()]

    def best(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window and item the best score and its template, the smallest id on ties; and how many templates each window was compared with."""
        norms = np.linalg.norm(v, axis=1)
        angle = np.arccos(np.clip((v / np.maximum(norms, 1e-300)[:, None]) @ self.centres.T, -1, 1)) - self.radii
        near = np.cos(np.maximum(angle, 0))
        bound = np.round(np.clip(norms[:, None] * near * np.where(near >= 0, self.most, self.least), -1, 1), 9) + SLACK
        top, at, compared = np.full((len(v), len(self.items)), -np.inf), np.zeros((len(v), len(self.items)), np.int64), np.zeros(len(v), np.int64)
        for k in np.argsort(-bound.mean(0)):
            item = self.owner[k]
            rows = np.flatnonzero(bound[:, k] >= top[:, item])
            if not len(rows):
                continue
            codes, steps, ids = self.groups[k]
            score = np.round(np.clip((v[rows] @ codes.T) * steps, -1, 1), 9)
            compared[rows] += len(ids)
            place = score.argmax(1)
            found, own = score[np.arange(len(rows)), place], ids[place]
            better = (found > top[rows, item]) | (found == top[rows, item]) & (own < at[rows, item])
            top[rows[better], item], at[rows[better], item] = found[better], own[better]
        return top, at, compared


COMPARED = HITS + ", compared long"


def _held(templates: DataFrame, most_bytes: int) -> pd.DataFrame | None:
    """The templates on the driver, or None if they are over the bound."""
    size = templates.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("q")), F.lit(1)).alias("dim")).first()
    return templates.toPandas() if 8 * size.n * size.dim <= most_bytes else None


def pruned_search(windows: DataFrame, templates: pd.DataFrame) -> DataFrame:
    """As `search`, with `compared`, the number of templates that the window was compared with; each task holds the pivots and takes windows in batches."""
    pivots = windows.sparkSession.sparkContext.broadcast(Pivots(np.stack(templates["q"].to_numpy()), templates["scale"].to_numpy(), templates["item"].to_numpy(), templates["template_id"].to_numpy()))

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), TILE[0]):
                part = batch.iloc[k : k + TILE[0]]
                top, at, compared = pivots.value.best(np.stack(part["v"].to_numpy()).astype(np.float64))
                items = pivots.value.items
                yield pd.DataFrame({"window_id": np.repeat(part["window_id"].to_numpy(), len(items)), "item": np.tile(items, len(part)), "template_id": at.ravel(), "score": top.ravel(), "compared": np.repeat(compared, len(items))})

    return windows.select("window_id", "v").mapInPandas(run, COMPARED)


def search(windows: DataFrame, templates: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """windows: (window_id, v). The best template of each item for each window, over all templates.

    Up to most_bytes of templates are held by every task around pivots. More of them meet the windows in blocks, each pair of blocks in one task as a
    matrix product that leaves a row for each window and item; neither side is broadcast or held whole then. Both give the same rows.
    """
    held = _held(templates, most_bytes)
    if held is not None:
        return pruned_search(windows, held).select("window_id", "item", "template_id", "score") if len(held) else windows.sparkSession.createDataFrame([], HITS)
    spark = windows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_t = max(1, -(-templates.count() // TEMPLATES))
    n_w = max(1, -(-windows.count() // WINDOWS), min(tasks, 8))
    w = windows.select(F.pmod(F.xxhash64("window_id"), F.lit(n_w)).alias("wb"), F.explode(F.sequence(F.lit(0), F.lit(n_t - 1))).alias("tb"), "window_id", "v")
    t = templates.select(F.explode(F.sequence(F.lit(0), F.lit(n_w - 1)).cast("array<bigint>")).alias("wb"), F.pmod(F.xxhash64("template_id"), F.lit(n_t)).cast("int").alias("tb"), "template_id", "item", "q", "scale")
    found = w.groupBy("wb", "tb").cogroup(t.groupBy("wb", "tb")).applyInPandas(_best_in_block, HITS)
    return best_per_item(found) if n_t > 1 else found


def best_per_item(hits: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", (-F.col("template_id")).alias("down")))
    return hits.groupBy("window_id", "item").agg(best.alias("b")).select("window_id", "item", (-F.col("b.down")).alias("template_id"), "b.score")


def with_provenance(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """samples: (template_id, ...), a row for each template. The hits with what their winning template was made of; a hit whose template has no sample is none."""
    return hits.join(samples, "template_id")


def ranked(hits: DataFrame, by: str, n: int = 0) -> DataFrame:
    """rk from 1 for each `by`, score descending, then item; the first n (0: all)."""
    out = hits.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item")))
    return out.where(F.col("rk") <= n) if n > 0 else out


def with_margin(hits: DataFrame, by: str, n: int = 5) -> DataFrame:
    """The best of each top-n list with its margin over the runner-up, null where there is none."""
    order = Window.partitionBy(by).orderBy("rk")
    return ranked(hits, by, n).withColumn("margin", F.col("score") - F.lead("score").over(order)).where("rk = 1").drop("rk")


def identified(hits: DataFrame, recording: Column) -> DataFrame:
    """For each recording and item the best window; the first one on ties."""
    best = F.max(F.struct("score", (-F.col("window_id")).alias("down")))
    out = hits.groupBy(recording.alias("recording"), "item").agg(best.alias("b"))
    return out.select("recording", "item", F.col("b.score").alias("score"), (-F.col("b.down")).alias("window_id"))


def verdicts(found: DataFrame, least: float = 0.75) -> DataFrame:
    top = ranked(found, "recording", 1)
    return top.select("recording", F.when(F.col("score") >= least, F.col("item")).alias("item"), "score", F.when(F.col("score") >= least, "match").otherwise("no reliable hit").alias("verdict"))


def matrix(found: DataFrame, items: list[int]) -> DataFrame:
    out = found.groupBy("recording").pivot("item", items).agg(F.max("score"))
    return out.select("recording", *[F.col(str(i)).alias(f"item_{i}") for i in items])


def overlay_thresholds(hits: DataFrame, live: DataFrame, default: float) -> DataFrame:
    """live: (item, threshold); a missing or zero threshold is the default."""
    own = live.select("item", F.when(F.col("threshold") > 0, F.col("threshold")).alias("threshold"))
    return hits.join(own, "item", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default)))


def unrivalled(hits: DataFrame, by: str, margin: float = 0.06) -> DataFrame:
    """The best hit of each list, without those of which another item's score is over the best minus margin."""
    best = ranked(hits, by, 2).groupBy(by).agg(F.max(F.when(F.col("rk") == 1, F.struct("item", "score"))).alias("b"), F.max(F.when(F.col("rk") == 2, F.col("score"))).alias("rival"))
    return best.where(F.col("rival").isNull() | (F.col("rival") <= F.col("b.score") - margin)).select(by, "b.item", "b.score", "rival")


def build_report(templates: DataFrame, dim: int) -> DataFrame:
    """Templates and bytes for each item, with a total in the row of the null item."""
    return templates.rollup("item").agg(F.count("*").alias("built"), F.count_if(F.col("scale") == 0).alias("unusable"), (F.count("*") * dim).alias("bytes"))


def confirmed(live: DataFrame, variants: DataFrame) -> DataFrame:
    """live: (window_id, item, v); variants: (item, u), several of an item. The greatest cosine of each window with its item's variants, -1 without any."""
    met = live.join(variants, "item", "left").withColumn("c", F.when(F.col("u").isNull(), -1.0).otherwise(V.cosine(F.col("v"), F.col("u"))))
    return met.groupBy("window_id", "item").agg(F.max("c").alias("confirm"))
