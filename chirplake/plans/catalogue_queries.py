"""Catalogue and inbox queries: parts, suppliers, orders, documents and conversations stand in for items, samples and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from chirplake.functions import scalars as X
from chirplake.functions import vectors as V
from chirplake.operators import catalogue as C


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_search(spark, sf_dir):
    return C.searched(_t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], "BRAND#2").select("p_partkey", "p_name")


def tag_lists(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", X.tags(F.concat_ws(" , ", "p_name", "p_type", "p_name")).alias("tags"))
    return p.select("p_partkey", F.size("tags").alias("n"), F.array_join("tags", "|").alias("tags"))


def hit_labels(spark, sf_dir):
    p = _hinted(spark, sf_dir)
    return p.select("p_partkey", X.hit_label(F.col("p_brand"), X.normal_hints(F.col("hints")), 24).alias("label"))


def _hinted(spark, sf_dir):
    """Parts with up to three raw hints each: of many forms, with bad grids, and without names."""
    pair = lambda grid, name: F.struct(grid.alias("grid"), name.alias("name"))
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    first = pair(F.concat(F.lit(" "), size, F.when(key % 3 == 0, "×").when(key % 3 == 1, "Ｘ").otherwise("X"), (key % 120).cast("string")), F.concat(F.lit(" "), "p_name", F.lit(" ")))
    second = pair(F.concat(size, F.lit("x2")), F.when(key % 7 > 0, F.col("p_type")).otherwise(" "))
    none = pair(F.lit(" "), F.lit(None).cast("string"))
    hints = F.when(key % 5 == 0, F.array().cast("array<struct<grid:string,name:string>>")).when(key % 5 == 1, F.array(first)).when(key % 5 == 2, F.array(none, second)).otherwise(F.array(first, none, second))
    return _t(spark, sf_dir, "part").withColumn("hints", F.when(key % 97 == 0, F.array_repeat(second, 17)).otherwise(hints))


def hint_checks(spark, sf_dir):
    p = _hinted(spark, sf_dir)
    listed = F.array_join(F.transform(X.normal_hints(F.col("hints")), lambda h: F.concat_ws(":", h["grid"], h["name"])), "|")
    return p.select("p_partkey", listed.alias("hints"), X.hints_error(F.col("hints")).alias("error"))


def grid_hints(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " × ").otherwise("X"), (F.col("p_partkey") % 150).cast("string"), F.lit(" "))
    return _t(spark, sf_dir, "part").select("p_partkey", X.grid_key(raw).alias("grid")).withColumn("valid", X.valid_grid(F.col("grid")))


def grid_layout(spark, sf_dir):
    hints = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.concat_ws("x", (F.col("p_size") % 7).cast("string"), F.substring("p_brand", -1, 1)).alias("grid"))
    return C.hint_grids(hints).select("grid", "first", "n", "columns", "rows")


def rounding(spark, sf_dir):
    v = F.col("c_acctbal") / 7
    return _t(spark, sf_dir, "customer").select("c_custkey", X.round3(v).alias("r3"), F.round(v, 2).alias("r2"), F.round(X.finite(F.when(F.col("c_custkey") % 5 == 0, float("nan")).when(F.col("c_custkey") % 5 == 1, float("-inf")).otherwise(v)), 2).alias("finite"))


def clamped_metadata(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    threshold = X.clamp_threshold(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal") / 5000))
    cooldown = X.clamp_cooldown(F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") * 900).cast("int")))
    return c.select("c_custkey", F.round(threshold, 6).alias("threshold"), cooldown.cast("long").alias("cooldown_ms"))


def method_alias(spark, sf_dir):
    name = X.aliased(F.concat(F.lit(" "), F.initcap("c_mktsegment")), {"building": "wiener", "machinery": "gate", "furniture": "off"}, "wiener")
    return _t(spark, sf_dir, "customer").groupBy(name.alias("method")).agg(F.count("*").alias("n"))


def id_check(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier")
    id = F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(" ", "s_name", "s_suppkey")).otherwise(F.translate("s_name", "#", "-"))
    return s.select("s_suppkey", X.valid_id(id).alias("valid"))


def candidate_ids(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    id = X.candidate_id(F.col("event_id") * 137, F.col("t"))  # some of over six digits
    return e.select("event_id", id.alias("candidate_id"), F.unix_seconds(F.to_timestamp(F.right(id, F.lit(15)), "yyyyMMdd-HHmmss")).alias("taken_at"))


def keep_newest(spark, sf_dir):
    c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("inbox"), (F.col("o_orderstatus") == "F").alias("used"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"))
    return C.pruned(c, 4).select("inbox", "used", "id")


def keep_newest_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("inbox"), F.lit(False).alias("used"), F.col("turn").alias("created"), F.col("turn").alias("id"))
    return C.pruned(c, 2).select("inbox", F.col("id").alias("turn"))


def library_sort(spark, sf_dir):
    parts = _t(spark, sf_dir, "part")
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_name", "p_partkey")
    return parts.select("p_brand", "p_partkey", F.row_number().over(w).alias("place"))


def next_sequence(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(F.count("*").alias("seq"))
    new = o.where("o_orderkey % 2 = 1").select("o_custkey", "o_orderkey")
    return C.next_sequences(old, new, "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "seq")


def renumber(spark, sf_dir):
    kept = _t(spark, sf_dir, "lineitem").where("l_linenumber % 3 <> 0").select("l_orderkey", "l_linenumber")
    return C.renumbered(kept, "l_orderkey", ["l_linenumber"])


def manifest_order(spark, sf_dir):
    items = _t(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_size")).alias("display_order"))
    return C.manifest_order(items, "p_brand").select("p_brand", "id", "place")


def merge_classes(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    mapping = p.select(F.col("p_brand").alias("source")).distinct().withColumn("target", F.concat(F.lit("Class#"), F.substring("source", 7, 1))).where("source <> 'Brand#11'")
    return C.merged_classes(p.select("p_brand", "p_partkey"), mapping, "p_brand", ["p_partkey"]).select("p_partkey", "target", "sample_idx")


def seed_missing(spark, sf_dir):
    presets = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    have = _t(spark, sf_dir, "part").where("p_size < 3 and p_brand < 'Brand#4'").select(F.col("p_brand").alias("name"))
    return C.absent(presets, have, ["name"]).withColumn("threshold", F.lit(0.8))


def reconcile(spark, sf_dir):
    meta = _t(spark, sf_dir, "labels").where("doc_id % 7 <> 0").select("doc_id", "quality")
    blobs = _t(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select("doc_id", "n_chars")
    return C.reconcile(meta, blobs, ["doc_id"]).select("doc_id", "quality", "n_chars", "state")


def orphans(spark, sf_dir):
    return C.absent(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), ["doc_id"])


def name_resolution(spark, sf_dir):
    """All part names in several forms: plain, quoted, the first word alone, longer, and in capitals, for which half have an alias."""
    p, key = _t(spark, sf_dir, "part"), F.col("p_partkey") % 5
    name = F.when(key == 0, F.concat("p_name", F.lit(" "))).when(key == 1, F.concat(F.lit("「"), "p_name", F.lit("」"))).when(key == 2, F.substring_index("p_name", " ", 1))
    wanted = p.select(name.when(key == 3, F.concat("p_name", F.lit(" mk2"))).otherwise(F.upper("p_name")).alias("name")).distinct()
    assets = p.select(F.col("p_name").alias("asset")).distinct()
    return C.resolved_names(wanted, assets, assets.where("asset < 'm'").select(F.upper("asset").alias("alias"), "asset"))


def realign(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_partkey").alias("icon"))
    names = li.where("pos % 2 = 1").select("owner", "pos", "name")
    return C.realigned(names, li.where("pos % 2 = 0"))


def stale_items(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    items = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("updated_at"))
    built = o.where("o_orderkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_orderdate").alias("built_at"))
    return C.stale(items, built, "o_custkey").select("o_custkey", "reason")


def patch_upsert(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    items = o.select("o_orderkey", F.col("o_totalprice").alias("threshold"), F.col("o_orderstatus").alias("note"), F.lit(0).alias("updated_at"))
    patches = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, 0.5).alias("threshold"), F.lit("patched").alias("note"))
    out = C.upserted(items, patches, "o_orderkey", F.lit(1))
    return out.select("o_orderkey", F.round("threshold", 2).alias("threshold"), "note", "updated_at")


def promote(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    candidates = d.select(F.col("doc_id").alias("candidate_id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.col("source"), F.when(F.col("doc_id") % 11 == 0, "?").otherwise(""))).alias("target"))
    return C.promoted(candidates, d.select(F.col("source").alias("item_id")).distinct())


def _inbox(spark, sf_dir):
    """Documents as candidates, their sources and some of their own ids as items, labels as samples."""
    d = _t(spark, sf_dir, "documents")
    target = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" "), "source", F.when(F.col("doc_id") % 11 == 0, "?").otherwise("")))
    candidates = d.select(
        F.col("doc_id").alias("candidate_id"), target.alias("target"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("name"),
        (F.col("n_chars") / 2000).alias("threshold"), F.when(F.col("doc_id") % 4 > 0, F.col("n_chars").cast("int")).alias("cooldown_ms"), F.lit(" ").alias("profile"),
    )
    ids = d.select(F.col("source").alias("item_id")).union(d.where("doc_id % 33 = 0").select(F.col("doc_id").cast("string"))).distinct()
    items = ids.select("item_id", F.col("item_id").alias("name"), F.lit(0.5).alias("threshold"), F.lit(100).alias("cooldown_ms"), F.lit("own").alias("profile"), F.lit(0).alias("created_at"), F.lit(0).alias("updated_at"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    samples = d.join(_t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id").select(F.col("source").alias("item_id"), nth.alias("sample_idx"), F.col("doc_id").cast("string").alias("file"), F.lit("upload").alias("source"))
    return candidates, items, samples


def promote_items(spark, sf_dir):
    candidates, items, _ = _inbox(spark, sf_dir)
    return C.created_items(candidates, items, F.lit(1)).withColumn("threshold", F.round("threshold", 6))


def promote_samples(spark, sf_dir):
    candidates, items, samples = _inbox(spark, sf_dir)
    return C.appended_samples(samples, candidates, items)


def promote_inbox(spark, sf_dir):
    candidates, items, _ = _inbox(spark, sf_dir)
    return C.inbox_left(candidates, items).select("candidate_id", "target")


def noise_variants(spark, sf_dir):
    """Each vector and three noisy ones, as the sums of their places' squares and products with the clean one."""
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    noise = F.transform(F.sequence(F.lit(1), F.size("v")), lambda k: ((k * 7919 + F.col("vec_id") * 104729) % 1000) / 500.0 - 1.0)
    out = C.with_variants(e.withColumn("clean", F.col("v")), "v", noise, [12.0, 6.0, 0.0])
    return out.select("vec_id", "variant", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("power"), F.round(V.dot(F.col("v"), F.col("clean")), 6).alias("along"))


def inbox_listing(spark, sf_dir):
    c = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("inbox"), (F.col("o_orderstatus") == "F").alias("used"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("id"))
    return C.listed(c).select("inbox", "id", "place")


def library_sorts(spark, sf_dir):
    """Each brand's parts in the four orders of a listing."""
    p = _t(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    each = [C.library_sorted(p, s, by="p_brand", name="p_name", samples="p_size", created="p_retailprice").select("p_brand", "id", F.lit(s).alias("sort"), "place") for s in C.SORTS]
    return reduce(lambda a, b: a.unionByName(b), each)


def delete_items(spark, sf_dir):
    gone = _t(spark, sf_dir, "labels").where("toxic = 1")
    return C.absent(_t(spark, sf_dir, "documents").select("doc_id", "lang"), gone, ["doc_id"])


def mark_used(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.coalesce("quality", F.lit(0)) == 1, "used").otherwise("new").alias("status"))


def append_samples(spark, sf_dir):
    old = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("library").alias("source"))
    new = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return old.unionByName(new.withColumn("source", F.lit("recorded")))


def library_totals(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("samples"), F.count_distinct("lang").alias("langs"), F.sum("n_chars").alias("total"))


def put_down_filter(spark, sf_dir):
    return _t(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring"))).select("p_partkey", "p_name")


def validation(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    rules = {"size": F.col("p_size").between(1, 45), "price": F.col("p_retailprice") < 1800, "brand": F.col("p_brand").rlike("^Brand#[1-4]")}
    return C.failed_rules(p, rules).groupBy("rule").agg(F.count("*").alias("rejected"))


def parameter_hash(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    doc = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_brand").alias("profile"), F.col("p_size").alias("bands")))
    return p.select("p_partkey", F.sha2(doc, 256).alias("fingerprint"))


QUERIES = {f.__name__: f for f in (text_search, tag_lists, hit_labels, grid_hints, grid_layout, rounding, clamped_metadata, method_alias, id_check, candidate_ids, hint_checks, promote_items, promote_samples, promote_inbox, noise_variants, inbox_listing, library_sorts, keep_newest, keep_newest_turns, library_sort, next_sequence, renumber, manifest_order, merge_classes, seed_missing, reconcile, orphans, name_resolution, realign, stale_items, patch_upsert, promote, delete_items, mark_used, append_samples, library_totals, put_down_filter, validation, parameter_hash)}

_HINTS = """WITH r AS (SELECT *, {'grid': p_size || 'x' || (p_partkey % 120), 'name': p_name} AS f, {'grid': p_size || 'x2', 'name': CASE WHEN p_partkey % 7 > 0 THEN p_type ELSE '' END} AS s FROM part),
h AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 97 = 0 THEN 17 WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN 1 ELSE 3 END AS raw,
  CASE WHEN p_partkey % 97 = 0 THEN list_transform(range(17), lambda k: s) WHEN p_partkey % 5 = 0 THEN [] WHEN p_partkey % 5 = 1 THEN [f] WHEN p_partkey % 5 = 2 THEN [s] ELSE [f, s] END AS hints FROM r)"""

_INBOX = """WITH i AS (SELECT DISTINCT source AS item_id FROM documents UNION SELECT DISTINCT doc_id::VARCHAR FROM documents WHERE doc_id % 33 = 0),
c AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN source || CASE WHEN doc_id % 11 = 0 THEN '?' ELSE '' END END AS target,
  CASE WHEN doc_id % 33 = 0 THEN 'exists' WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'unknown_target' ELSE 'appended' END AS action FROM documents) """

ORACLES = {
    "text_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#2')",
    "tag_lists": r"""WITH a AS (SELECT p_partkey, list_filter(regexp_split_to_array(p_name || ' , ' || p_type || ' , ' || p_name, '[,;，；\s]+'), lambda x: x <> '') AS t FROM part),
b AS (SELECT p_partkey, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM a) SELECT p_partkey, len(t)::INT AS n, array_to_string(t, '|') AS tags FROM b""",
    "hit_labels": _HINTS + """, l AS (SELECT p_partkey, p_brand, len(hints) AS n, p_brand || '｜' || array_to_string(list_transform(hints, lambda h: replace(h.grid, 'x', '×') || ' ' || h.name), ' / ') AS line FROM h)
SELECT p_partkey, CASE WHEN n = 0 THEN p_brand WHEN length(line) > 24 THEN substr(line, 1, 23) || '…' ELSE line END AS label FROM l""",
    "hint_checks": _HINTS + """, b AS (SELECT p_partkey, hints, raw, list_filter(list_transform(hints, lambda h: CASE WHEN NOT regexp_full_match(h.grid, '[0-9]{1,2}x[0-9]{1,2}') THEN 'grid' WHEN h.name = '' THEN 'name' END), lambda x: x IS NOT NULL) AS bad FROM h)
SELECT p_partkey, array_to_string(list_transform(hints, lambda h: h.grid || ':' || h.name), '|') AS hints, CASE WHEN raw > 16 THEN 'too many' ELSE bad[1] END AS error FROM b""",
    "promote_items": _INBOX + """SELECT item_id, item_id AS name, 0.5::DOUBLE AS threshold, 100 AS cooldown_ms, 'own' AS profile, 0 AS created_at, 0 AS updated_at FROM i UNION ALL
SELECT d.doc_id::VARCHAR, CASE WHEN d.doc_id % 2 = 0 THEN d.lang ELSE 'capture ' || d.doc_id END, round(least(1, greatest(0, d.n_chars / 2000)), 6), CASE WHEN d.doc_id % 4 > 0 THEN least(600000, d.n_chars)::INT ELSE 400 END, 'default', 1, 1 FROM documents d JOIN c USING (doc_id) WHERE action = 'new'""",
    "promote_samples": _INBOX + """, s AS (SELECT source AS item_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_idx, doc_id::VARCHAR AS file, 'upload' AS source FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT CASE WHEN action = 'new' THEN doc_id::VARCHAR ELSE target END AS item_id, doc_id::VARCHAR AS file FROM c WHERE action IN ('new', 'appended')),
m AS (SELECT item_id, max(sample_idx) AS last FROM s GROUP BY item_id)
SELECT * FROM s UNION ALL SELECT n.item_id, coalesce(last, -1) + row_number() OVER (PARTITION BY n.item_id ORDER BY file), file, 'recall' FROM n LEFT JOIN m USING (item_id)""",
    "promote_inbox": _INBOX + "SELECT doc_id AS candidate_id, ' ' || target AS target FROM c WHERE action NOT IN ('new', 'appended')",
    "noise_variants": """WITH a AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
b AS (SELECT vec_id, x, ((k * 7919 + vec_id * 104729) % 1000) / 500.0::DOUBLE - 1 AS e FROM a),
s AS (SELECT vec_id, sqrt(sum(x * x)) / sqrt(sum(e * e)) AS scale FROM b GROUP BY vec_id),
v AS (SELECT * FROM (VALUES (0, NULL), (1, 12), (2, 6), (3, 0)) t(variant, db)),
y AS (SELECT b.vec_id, variant, x, CASE WHEN db IS NULL THEN x ELSE x + scale * pow(10.0::DOUBLE, -db / 20.0::DOUBLE) * e END AS y FROM b JOIN s USING (vec_id), v)
SELECT vec_id, variant, round(sum(y * y), 6) AS power, round(sum(x * y), 6) AS along FROM y GROUP BY vec_id, variant""",
    "inbox_listing": "SELECT o_custkey AS inbox, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'F'",
    "library_sorts": """SELECT p_brand, p_partkey AS id, 'name' AS sort, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS place FROM part UNION ALL
SELECT p_brand, p_partkey, 'samples', row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) FROM part UNION ALL
SELECT p_brand, p_partkey, 'newest', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) FROM part UNION ALL
SELECT p_brand, p_partkey, 'oldest', row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) FROM part""",
    "grid_hints": "WITH a AS (SELECT p_partkey, p_size || 'x' || (p_partkey % 150) AS grid FROM part) SELECT p_partkey, grid, regexp_full_match(grid, '[0-9]{1,2}x[0-9]{1,2}') AS valid FROM a",
    "grid_layout": "SELECT (p_size % 7) || 'x' || right(p_brand, 1) AS grid, min(p_partkey) AS first, count(*) AS n, least(8, count(*))::INT AS columns, ceil(count(*) / 8.0)::INT AS rows FROM part GROUP BY 1",
    "rounding": "SELECT c_custkey, trunc(c_acctbal / 7 * 1000 + 0.5)::BIGINT / 1000 AS r3, round(c_acctbal / 7, 2) AS r2, CASE WHEN c_custkey % 5 > 1 THEN round(c_acctbal / 7, 2) END AS finite FROM customer",
    "clamped_metadata": "SELECT c_custkey, round(least(1, greatest(0, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal / 5000 ELSE 0.72 END)), 6) AS threshold, least(600000, greatest(0, CASE WHEN c_custkey % 4 > 0 THEN c_custkey * 900 ELSE 400 END))::BIGINT AS cooldown_ms FROM customer",
    "method_alias": "SELECT CASE c_mktsegment WHEN 'MACHINERY' THEN 'gate' WHEN 'FURNITURE' THEN 'off' ELSE 'wiener' END AS method, count(*) AS n FROM customer GROUP BY 1",
    "id_check": "SELECT s_suppkey, regexp_full_match(CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' ' || s_suppkey ELSE replace(s_name, '#', '-') END, '[A-Za-z0-9_-]{1,64}') AS valid FROM supplier",
    "candidate_ids": "SELECT event_id, format('{:06d}', event_id * 137) || '-' || strftime(ts, '%Y%m%d-%H%M%S') AS candidate_id, epoch(date_trunc('second', ts))::BIGINT AS taken_at FROM events",
    "keep_newest": "SELECT o_custkey AS inbox, o_orderstatus = 'F' AS used, o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) <= CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 4 END",
    "keep_newest_turns": "SELECT conv_id AS inbox, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "library_sort": "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part",
    "next_sequence": "WITH o AS (SELECT o_custkey, count(*) AS seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT n.o_custkey, o_orderkey, coalesce(seq, 0) + row_number() OVER (PARTITION BY n.o_custkey ORDER BY o_orderkey) AS seq FROM orders n LEFT JOIN o USING (o_custkey) WHERE o_orderkey % 2 = 1",
    "renumber": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS sample_idx FROM lineitem WHERE l_linenumber % 3 <> 0",
    "manifest_order": "SELECT p_brand, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 4 = 0 THEN p_size END NULLS LAST, p_partkey) AS place FROM part",
    "merge_classes": "WITH a AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN p_brand ELSE 'Class#' || substr(p_brand, 7, 1) END AS target FROM part) SELECT *, row_number() OVER (PARTITION BY target ORDER BY p_partkey) - 1 AS sample_idx FROM a",
    "seed_missing": "SELECT DISTINCT p_brand AS name, 0.8::DOUBLE AS threshold FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size < 3 AND p_brand < 'Brand#4')",
    "reconcile": "SELECT doc_id, quality, n_chars, CASE WHEN quality IS NULL THEN 'recovered' WHEN n_chars IS NULL THEN 'missing_audio' ELSE 'kept' END AS state FROM (SELECT * FROM labels WHERE doc_id % 7 <> 0) FULL JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id % 5 <> 0) USING (doc_id)",
    "orphans": "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)",
    "name_resolution": """WITH w AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_name || ' ' WHEN 1 THEN '「' || p_name || '」' WHEN 2 THEN split_part(p_name, ' ', 1) WHEN 3 THEN p_name || ' mk2' ELSE upper(p_name) END AS name FROM part),
a AS (SELECT DISTINCT p_name AS asset FROM part), l AS (SELECT upper(asset) AS alias, asset FROM a WHERE asset < 'm'),
o AS (SELECT name, CASE WHEN count(DISTINCT asset) = 1 THEN min(asset) END AS sole FROM w JOIN a ON contains(asset, trim(name)) OR contains(trim(name), asset) GROUP BY name)
SELECT w.name, coalesce(e.asset, l.asset, q.asset, sole) AS asset FROM w LEFT JOIN a e ON e.asset = trim(w.name) LEFT JOIN l ON l.alias = trim(w.name) LEFT JOIN a q ON q.asset = trim(trim(w.name), '「」《》"' || chr(39)) LEFT JOIN o ON o.name = w.name""",
    "realign": "WITH i AS (SELECT l_orderkey AS owner, l_returnflag AS name, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000000 + l_partkey) AS icon FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2) SELECT l_orderkey AS owner, l_returnflag AS name, l_linenumber AS pos, icon FROM lineitem LEFT JOIN i ON owner = l_orderkey AND name = l_returnflag WHERE l_linenumber % 2 = 1",
    "stale_items": "WITH i AS (SELECT o_custkey, max(o_orderdate) AS u, max(o_orderdate) FILTER (o_orderkey % 3 = 0) AS b FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN b IS NULL THEN 'missing' ELSE 'newer' END AS reason FROM i WHERE b IS NULL OR u > b",
    "patch_upsert": "SELECT o_orderkey, round(CASE WHEN o_orderkey % 6 = 0 THEN 0.5 ELSE o_totalprice END, 2) AS threshold, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderstatus END AS note, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS updated_at FROM orders",
    "promote": "SELECT doc_id AS candidate_id, CASE WHEN doc_id % 3 > 0 THEN source || CASE WHEN doc_id % 11 = 0 THEN '?' ELSE '' END END AS target, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'unknown_target' ELSE 'appended' END AS action FROM documents",
    "delete_items": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "mark_used": "SELECT doc_id, CASE WHEN coalesce(quality, 0) = 1 THEN 'used' ELSE 'new' END AS status FROM documents LEFT JOIN labels USING (doc_id)",
    "append_samples": "SELECT s_suppkey AS id, s_name AS name, 'library' AS source FROM supplier UNION ALL SELECT c_custkey, c_name, 'recorded' FROM customer",
    "library_totals": "SELECT source, count(*) AS samples, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS total FROM documents GROUP BY source",
    "put_down_filter": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')",
    "validation": "SELECT rule, count(*) AS rejected FROM (SELECT unnest(list_filter([CASE WHEN p_size NOT BETWEEN 1 AND 45 THEN 'size' END, CASE WHEN p_retailprice >= 1800 THEN 'price' END, CASE WHEN NOT regexp_matches(p_brand, '^Brand#[1-4]') THEN 'brand' END], lambda x: x IS NOT NULL)) AS rule FROM part) GROUP BY rule",
    "parameter_hash": """SELECT p_partkey, sha256('{"id":' || p_partkey || ',"profile":"' || p_brand || '","bands":' || p_size || '}') AS fingerprint FROM part""",
}
