"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import secrets
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import lang_id, pieces, whitening
from chirplake.llm.line_dedup import dedup_lines
from chirplake.llm.line_rules import line_quality
from chirplake.llm.merkle import folded, leaf_hash, manifest, proof_nodes
from chirplake.llm.mixing import mix_sources, symbol_quality, word_count
from chirplake.llm.sharding import uniform_shards
from chirplake.llm.ngram_lm import score_texts
from chirplake.llm.phrases import compare_with_next
from chirplake.llm.simhash import fingerprinted, near_components
from chirplake.llm.store import frozen, new_path, table
from chirplake.llm.surrogates import replace_pii
from chirplake.llm.warc import RECORD_ID, read_warc, write_warc


#: The SentencePiece model that op4 and the pipeline read on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of `documents` under the law `rows`: counts at most one apart."""
    text = F.col("text")
    return uniform_shards(table(spark, sf_dir, "documents", "doc_id", "text"), 24).select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all `documents`, learned from those whose remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("held_out", lang_id.held_out(F.col("doc_id")))
    model = lang_id.fit(docs.where(~F.col("held_out")), id="doc_id", text="text", lang="lang")
    return lang_id.identify(docs, model, carry=["doc_id", "held_out"])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 64-bit fingerprints are linked at up to 4 bits."""
    prints = frozen(fingerprinted(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"]), "fingerprints")
    return near_components(prints, "doc_id", most=4).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECE_MODEL) -> DataFrame:
    """Ids of all `documents` and whether they decode to the text."""
    return pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), Path(model).read_bytes(), carry=["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    mixed = mix_sources(docs, source="source", size=word_count(F.col("text")), quality=symbol_quality(F.col("text")), identity=["doc_id"], carry=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents` and of each one's edited text."""
    return compare_with_next(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, the base rule and the cross-document line rule for `documents`, sources as hosts."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return line_quality(docs, carry=["doc_id"])


def crc_mod(column: str, n: int) -> Column:
    """CRC-32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents` under a bigram model of those whose remainder by 5 is not 1."""
    return score_texts(table(spark, sf_dir, "documents", "doc_id", "text"), id="doc_id", text="text", train=crc_mod("doc_id", 5) != 1)


#: The setting that holds the secret key of the surrogates.
PII_KEY = "spark.chirplake.pii.key"


def pii_key(spark: SparkSession) -> str:
    """The key of the session's setting; where that is unset, a random one is set, so that surrogates agree within the session alone."""
    if not spark.conf.get(PII_KEY, None):
        spark.conf.set(PII_KEY, secrets.token_hex(32))
    return spark.conf.get(PII_KEY)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` with surrogates for their personal data and secrets."""
    return replace_pii(table(spark, sf_dir, "documents", "doc_id", "text"), key=pii_key(spark), carry=["doc_id"])


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` as WARC archives in the shared folder, read back by byte ranges."""
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    page = lambda c: F.nullif(F.substring(c, len(RECORD_ID) + 1, 20), F.lit("")).cast("long")
    return read_warc(spark, path, split_bytes=4 << 20, payload=False).where("warc_type <> 'warcinfo'").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), page("refers_to").alias("refers_to")
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings`, whitened on up to eight components."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return whitening.whitened(vectors, whitening.fit(vectors, vector="embedding"), vector="embedding", carry=["vec_id"])


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree of all `documents` by lang; a seventh of the leaves, by CRC-32 of doc_id, is tampered with and folded with its proof."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    values = {c: F.col(c) for c in docs.columns}
    tampered = values | {"n_chars": F.when(crc_mod("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    docs = docs.withColumn("_seen", leaf_hash(*tampered.values()))
    tree = manifest(docs, group="lang", order=["doc_id"], leaf=leaf_hash(*values.values()), carry=["doc_id", "_seen"])
    tree = tree.withColumn("folded_root", folded(F.col("_seen"), F.col("proof"))).withColumn("proof_sha256", F.sha2(proof_nodes(F.col("proof")), 256))
    return tree.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` without the lines that ten documents or more have."""
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"), carry=["doc_id"])


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_lang_id": op2_lang_id,
    "op3_simhash": op3_simhash,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_mixing": op5_mixing,
    "op6_phrases": op6_phrases,
    "op7_line_rules": op7_line_rules,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_surrogates": op9_surrogates,
    "op10_warc": op10_warc,
    "op11_whitening": op11_whitening,
    "op12_merkle": op12_merkle,
    "op13_line_dedup": op13_line_dedup,
}



def _leaf_sql(n_chars: str) -> str:
    """SQL of a leaf's hash, with an expression for n_chars."""
    values = (f"({v})::VARCHAR" for v in ("doc_id", "source", "lang", n_chars, "text"))
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


ORACLES = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 9.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>!', ''))) / greatest(length(text), 1)), 1.0) AS quality,
    ((('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(cap, weight * coalesce((SELECT arg_min(level, ratio) FROM r WHERE level <= ratio), 0)) AS target FROM r),
o AS (
  SELECT d.*, t.source_size, t.target, floor(t.target / greatest(t.source_size, 1)) AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / quality, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  least(2 * size, epochs * size + greatest(0, least(size, floor(target - epochs * source_size) - (upto - size))))::BIGINT AS taken
FROM o
""",
    "op7_line_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
c AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (
  SELECT r, host, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
z AS (
  SELECT r, host, text, line, len(ws) AS words,
    translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000') AS norm FROM m),
f AS (SELECT host, norm FROM z GROUP BY host, norm HAVING count(DISTINCT r) > 20),
x AS (SELECT r, sum(words)::BIGINT AS removed_words FROM z SEMI JOIN f USING (host, norm) GROUP BY r),
y AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM z GROUP BY r),
b AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM d JOIN w USING (r) LEFT JOIN c USING (r) LEFT JOIN x USING (r) LEFT JOIN y USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.5 * n_words AS kept
FROM b
""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, lower(sha1(html)) AS hex, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT // [32768, 1024, 32, 1][1 + i % 4]) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id OR page_id IS NULL THEN first END AS refers_to
FROM h
""",
    "op12_merkle": f"""
WITH RECURSIVE crc AS (
  SELECT [list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FOR i IN range(256)] AS t),
m AS (
  SELECT documents.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 7 = 0 AS hit FROM documents, crc),
d AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS g,
    {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + coalesce(hit, false)::INT")} AS seen FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
up(g, level, pos, h, n) AS (
  SELECT g, 0, pos, leaf, count(*) OVER (PARTITION BY g) FROM p
  UNION ALL
  SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY g, level, pos // 2),
l AS (SELECT g, h AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS pos FROM up WHERE n = 1),
above(level, pos, h, n) AS (
  SELECT 0, pos, subroot, count(*) OVER () FROM l
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM above WHERE n > 1 GROUP BY level, pos // 2),
own AS (
  SELECT p.g, p.pos, u.level, CASE WHEN (p.pos >> u.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS side
  FROM p JOIN (SELECT DISTINCT g, level FROM up WHERE n > 1) u USING (g)
  LEFT JOIN up s ON s.g = p.g AND s.level = u.level AND s.pos = xor(p.pos >> u.level, 1)),
over_ AS (
  SELECT l.g, u.level, CASE WHEN (l.pos >> u.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS side
  FROM l, (SELECT DISTINCT level FROM above WHERE n > 1) u LEFT JOIN above s ON s.level = u.level AND s.pos = xor(l.pos >> u.level, 1)),
own_path AS (SELECT g, pos, list(side ORDER BY level) AS path FROM own GROUP BY g, pos),
over_path AS (SELECT g, list(side ORDER BY level) AS path FROM over_ GROUP BY g),
w AS (
  SELECT doc_id, leaf, seen, subroot, (SELECT h FROM above WHERE n = 1) AS root, list_concat(coalesce(o.path, []), coalesce(v.path, [])) AS path
  FROM p JOIN l USING (g) LEFT JOIN own_path o ON o.g = p.g AND o.pos = p.pos LEFT JOIN over_path v ON v.g = p.g),
x AS (
  SELECT *, list_reduce(list_prepend(seen, path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM x
""",
    "op13_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT *, [translate(trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FOR x IN lines] AS keys FROM d),
f AS (SELECT key FROM (SELECT r, unnest(keys) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
l AS (SELECT r, unnest(lines) AS line, unnest(keys) AS key, unnest(range(len(lines))) AS nth FROM k),
s AS (
  SELECT r, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE f.key IS NULL), '') AS kept
  FROM l LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (r)
""",
}
