"""The corpus pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chirplake.llm import lang_id, pieces
from chirplake.llm.mixing import mix_sources, symbol_quality, word_count
from chirplake.llm.queries import PIECE_MODEL, pii_key
from chirplake.llm.simhash import drop_near_copies
from chirplake.llm.store import frozen
from chirplake.llm.surrogates import replace_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; a missing lang is filled with the prediction."""
    docs = docs.select(*COLUMNS)
    model = lang_id.fit(docs.where(~lang_id.held_out(F.col("doc_id"))), id="doc_id", text="text", lang="lang")
    found = lang_id.identify(docs, model, carry=COLUMNS).where(~F.col("rejected"))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return drop_near_copies(docs.select(*COLUMNS))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for their personal data; n_chars follows the text."""
    done = replace_pii(docs.select(*COLUMNS), key=pii_key(spark), carry=["doc_id", "lang", "source"])
    return done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: its share of words, to the nearest whole copy."""
    text = F.col("text")
    mixed = mix_sources(docs.select(*COLUMNS), source="source", size=word_count(text), quality=symbol_quality(text), identity=["doc_id"], carry=COLUMNS)
    copies = F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    return mixed.select(*COLUMNS, F.explode(F.array_repeat(F.lit(1), copies))).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, and whether they decode to its text."""
    return pieces.encode(docs, Path(PIECE_MODEL).read_bytes(), carry=["doc_id", "source"])


STAGES = [("language", language), ("near_copies", near_copies), ("surrogates", surrogates), ("mixture", mixture), ("encoding", encoding)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = frozen(docs, f"stage-{name}")
    return docs
