"""Documents to packed training sequences: language, near copies, mix of sources, packing."""

from __future__ import annotations

from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm import language, minhash, mixing, packing
from adtally.llm.queries import MIX_EPOCHS, MIX_PATH, TOKENIZER, mix_domain, mix_rows, mix_weights, table
from adtally.llm.staging import staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without any letter go, and those too far from all learnt languages."""
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8; other texts of one id stay."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the budget of its source asks for, none included."""
    rows = staged(mix_rows(docs))
    copies = mixing.mixed(rows, MIX_PATH, mix_weights(spark), epochs=MIX_EPOCHS, id_column="doc_id")
    keys = [*MIX_PATH, "doc_id"]
    drawn = copies.where("copies > 0").groupBy(*keys).agg(F.max("copies").alias("__copies")).withColumnsRenamed({k: f"__{k}" for k in keys})
    placed = docs.withColumn("domain_", mix_domain(F.col("source")))
    own = {"domain": "domain_", "lang": "lang", "source": "source", "doc_id": "doc_id"}
    same = reduce(Column.__and__, [F.col(own[k]).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return placed.join(drawn, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("language_id", known_language), ("near_dedup", near_dedup), ("source_mixing", mix_sources), ("best_fit_packing", pack)]

#: Languages, sketches and token ids are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
