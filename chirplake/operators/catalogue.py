"""Catalogue and inbox: items, samples, candidates, and the joins and rewrites that keep them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import vectors as V


def reconcile(meta: DataFrame, blobs: DataFrame, on: list[str]) -> DataFrame:
    """State of each sample: `kept` where both sides have it, `missing_audio`, or `recovered` where only the audio is there."""
    m, b = meta.withColumn("_m", F.lit(True)), blobs.withColumn("_b", F.lit(True))
    state = F.when(F.col("_m") & F.col("_b"), "kept").when(F.col("_m"), "missing_audio").otherwise("recovered")
    return m.join(b, on, "full_outer").withColumn("state", state).drop("_m", "_b")


def absent(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """Rows of df without a partner: orphans, or what may be inserted."""
    return df.join(other.select(*on).distinct(), on, "left_anti")


def merged_classes(samples: DataFrame, mapping: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Samples under their target class (mapping: source, target), numbered anew from 0 in each class."""
    out = samples.join(mapping, samples[item] == mapping["source"], "left").withColumn("target", F.coalesce("target", item))
    return renumbered(out.drop("source"), "target", order)


def renumbered(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    return df.withColumn("sample_idx", F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)


#: Quotes that may stand around a name.
QUOTES = "「」《》\"'"


def _parts(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs (part, whole) of which the part, not empty, is a piece of the whole.

    Of a whole only the pieces of lengths that parts have are looked at, so that what is looked up is linear in the text for each such length, and a
    piece meets a part by equality of their hashes, then of themselves. Lengths are bounded by the longest name.
    """
    parts = inner.where("part <> ''").select("part", F.xxhash64("part").alias("_hash"))
    lengths = [r[0] for r in parts.select(F.length("part")).distinct().collect()]
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("whole"))
    spans = outer.select("whole", F.explode(fitting).alias("_n"))
    pieces = spans.select("whole", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("whole") - F.col("_n") + 1), lambda k: F.substring("whole", k, F.col("_n"))))).alias("_piece"))
    met = pieces.withColumn("_hash", F.xxhash64("_piece")).join(parts, "_hash")
    return met.where(F.col("_piece") == F.col("part")).select("part", "whole")


def resolved_names(wanted: DataFrame, assets: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted: name; assets: asset; aliases: alias, asset. The asset of each name, in this order: equal to the trimmed name, by alias, equal without
    the quotes around it, or the only one of which the name (quotes included) is a part or that is a part of it; null where several are.
    """
    names = wanted.select("name", F.trim("name").alias("trimmed")).withColumn("bare", F.expr("btrim(trimmed, '「」《》\"\\'')"))
    known = assets.select("asset").distinct()
    to = lambda column, out: known.select(F.col("asset").alias(column), F.col("asset").alias(out))
    direct = names.join(to("trimmed", "exact"), "trimmed", "left").join(aliases.join(known, "asset").select(F.col("alias").alias("trimmed"), F.col("asset").alias("by_alias")), "trimmed", "left").join(to("bare", "unquoted"), "bare", "left")
    open_ = direct.where(F.coalesce("exact", "by_alias", "unquoted").isNull()).select("trimmed").distinct()
    within = _parts(open_.select(F.col("trimmed").alias("part")), known.select(F.col("asset").alias("whole"))).select(F.col("part").alias("trimmed"), F.col("whole").alias("asset"))
    around = _parts(known.select(F.col("asset").alias("part")), open_.select(F.col("trimmed").alias("whole"))).select(F.col("whole").alias("trimmed"), F.col("part").alias("asset"))
    only = within.unionByName(around).groupBy("trimmed").agg(F.min("asset").alias("only"), F.max("asset").alias("last")).where("only = last").select("trimmed", "only")
    return direct.join(only, "trimmed", "left").select("name", F.coalesce("exact", "by_alias", "unquoted", "only").alias("asset"))


def upserted(items: DataFrame, patches: DataFrame, key: str, at: Column) -> DataFrame:
    """items with the patches' values where these give one; updated_at moves with a patch."""
    fields = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_patched"))
    out = items.join(p, key, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return out.withColumn("updated_at", F.when(F.col("_patched"), at).otherwise(F.col("updated_at"))).drop("_patched", *[f"_{c}" for c in fields])


def promoted(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """candidates: (candidate_id, target). What becomes of each: a `new` item, `exists` if its id is an item's, `appended` to its target, or an `unknown_target`."""
    known = items.select(F.col("item_id").alias("at"), F.lit(True).alias("known")).distinct()
    target = F.nullif(F.trim("target"), F.lit(""))
    action = F.when(F.col("to").isNull(), F.when(F.col("known"), "exists").otherwise("new")).when(F.col("known"), "appended").otherwise("unknown_target")
    asked = candidates.withColumn("to", target).withColumn("at", F.coalesce(target, F.col("candidate_id").cast("string")))
    return asked.join(known, "at", "left").withColumn("action", action).drop("at", "to", "known")


def created_items(candidates: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """The items with a new one for each promoted candidate without a target: its id is the candidate's, with defaults for what isn't given.

    candidates: (candidate_id, target, name, threshold, cooldown_ms, profile); a missing name is told from the time in the id.
    """
    new = promoted(candidates, items).where("action = 'new'")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.concat(F.lit("capture "), F.right(F.col("candidate_id").cast("string"), F.lit(15))))
    rows = new.select(
        F.col("candidate_id").cast("string").alias("item_id"),
        name.alias("name"),
        X.clamp_threshold(F.col("threshold")).alias("threshold"),
        X.clamp_cooldown(F.col("cooldown_ms")).alias("cooldown_ms"),
        F.coalesce(F.nullif(F.trim("profile"), F.lit("")), F.lit("default")).alias("profile"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )
    return items.unionByName(rows)


def appended_samples(samples: DataFrame, candidates: DataFrame, items: DataFrame, source: str = "recall") -> DataFrame:
    """samples: (item_id, sample_idx, file, source). Adds each promoted candidate's clip to its target or new item, numbered on from the last."""
    done = promoted(candidates, items).where("action in ('new', 'appended')")
    to = F.when(F.col("action") == "new", F.col("candidate_id").cast("string")).otherwise(F.trim("target"))
    new = done.select(to.alias("item_id"), F.col("candidate_id").cast("string").alias("file"), F.lit(source).alias("source"))
    last = samples.groupBy("item_id").agg(F.max("sample_idx").alias("last"))
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("file"))
    return samples.unionByName(new.join(last, "item_id", "left").select("item_id", (F.coalesce("last", F.lit(-1)) + nth).alias("sample_idx"), "file", "source"))


def inbox_left(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """The candidates that weren't promoted: those with an unknown target or an id that an item has."""
    return promoted(candidates, items).where("action not in ('new', 'appended')").drop("action")


def with_variants(clean: DataFrame, vector: str, noise: Column, ratios_db: list[float]) -> DataFrame:
    """Each vector as it is (variant 0) and with noise of its own length at each ratio, as one set."""
    length = lambda v: F.sqrt(V.dot(v, v))
    at = lambda db: V.let(length(F.col(vector)) / length(noise) * 10 ** (-db / 20), lambda scale: F.zip_with(vector, noise, lambda x, e: x + scale * e))
    sets = [clean.withColumn("variant", F.lit(0))] + [clean.withColumn(vector, at(db)).withColumn("variant", F.lit(k + 1)) for k, db in enumerate(ratios_db)]
    return reduce(DataFrame.unionByName, sets)


def listed(candidates: DataFrame) -> DataFrame:
    """The unused candidates of each inbox with their place, newest first, by descending id where times are equal."""
    return candidates.where("not used").withColumn("place", F.row_number().over(Window.partitionBy("inbox").orderBy(F.desc("created"), F.desc("id"))))


#: Orders of a library's listing.
SORTS = {"name": lambda name, samples, created: [F.collate(name, "zh")], "samples": lambda name, samples, created: [F.desc(samples)], "newest": lambda name, samples, created: [F.desc(created)], "oldest": lambda name, samples, created: [F.asc(created)]}


def library_sorted(items: DataFrame, sort: str, *, by: str, name: str, samples: str, created: str) -> DataFrame:
    """The items of each library `by` with their place in one of SORTS; names compare as in Chinese, and rows that an order leaves equal stand by id."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*SORTS[sort](name, samples, created), "id")))


def pruned(candidates: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` candidates of each inbox and max(1, keep / 4) used ones."""
    n = F.row_number().over(Window.partitionBy("inbox", "used").orderBy(F.desc("created"), F.desc("id")))
    return candidates.withColumn("rk", n).where(F.col("rk") <= F.when(F.col("used"), max(1, keep // 4)).otherwise(keep)).drop("rk")


def manifest_order(items: DataFrame, by: str) -> DataFrame:
    """Listed items first, in their order, then the rest by id."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.col("display_order").asc_nulls_last(), "id")))


def realigned(names: DataFrame, pictures: DataFrame) -> DataFrame:
    """names: (owner, pos, name); pictures: (owner, pos, name, icon). Each name, blanks around it aside, keeps its picture: of several the first by place, then by icon. Empty names have none."""
    key = F.nullif(F.trim("name"), F.lit("")).alias("_name")
    first = pictures.where("icon is not null").select("owner", "pos", "icon", key).groupBy("owner", "_name").agg(F.min(F.struct("pos", "icon"))["icon"].alias("icon"))
    return names.select("*", key).join(first, ["owner", "_name"], "left").drop("_name")


def stale(items: DataFrame, built: DataFrame, key: str) -> DataFrame:
    """Items that must be built: never built, or updated strictly later."""
    out = items.join(built.select(key, "built_at"), key, "left")
    why = F.when(F.col("built_at").isNull(), "missing").when(F.col("updated_at") > F.col("built_at"), "newer")
    return out.withColumn("reason", why).where("reason is not null")


def next_sequences(old: DataFrame, new: DataFrame, by: str, order: list[str]) -> DataFrame:
    """new rows with seq counted on from the greatest of their group in old."""
    top = old.groupBy(by).agg(F.max("seq").alias("top"))
    return new.join(top, by, "left").withColumn("seq", F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy(by).orderBy(*order))).drop("top")


def searched(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which one of the columns holds the query, letter case aside."""
    return df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(query))))


def hint_grids(hints: DataFrame) -> DataFrame:
    """hints: (pos, grid). For each grid its first place, count, and the layout of up to 8 columns."""
    g = hints.groupBy("grid").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    return g.withColumn("columns", F.least(F.lit(8), F.col("n")).cast("int")).withColumn("rows", F.ceil(F.col("n") / 8).cast("int"))


def failed_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each row of df and rule that it fails (null counts as failing)."""
    checks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("rule", F.explode(F.array_compact(checks)))


def captured(clips: DataFrame, hits: DataFrame) -> DataFrame:
    """clips: (stream, t, id); hits: (stream, t, item, score). Each clip with the last hit of its stream up to then; a score without an item is none."""
    guess = F.struct("item", F.round("score", 4).alias("score"))
    both = clips.select("stream", "t", "id", F.lit(1).alias("side"), F.lit(None).cast("struct<item:string,score:double>").alias("g")).unionByName(
        hits.select("stream", "t", F.lit(None).cast("long").alias("id"), F.lit(0).alias("side"), F.when(F.col("item").isNotNull(), guess).alias("g"))
    )
    upto = Window.partitionBy("stream").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("g", F.last("g", ignorenulls=True).over(upto)).where("side = 1").select("id", F.col("g.item").alias("guess_id"), F.col("g.score").alias("guess_score"))
