"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrowatch.llm import exact_dedup as exact
from ferrowatch.llm import language_id, mixing, near_dedup, packing
from ferrowatch.sources.staging import stage

# Texts whose language is less certain than this go, with those in which no learned one is found.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised, by a model of the labelled ones.

    Text that is in none of the languages, or no language, goes: see language_id.is_spoken.
    """
    model = language_id.fit(docs)
    predicted = language_id.predict(docs, model)
    known = language_id.is_spoken("text") & (F.col("score") >= LEAST_SCORE)
    return predicted.where(known).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those with equal text."""
    return exact.exact_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.Mix(docs).documents()


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]

# The stages learn, solve and pack; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, function in first:
        docs = stage(function(spark, docs, sf_dir), f"pipeline_{name}")
    return last(spark, docs, sf_dir)
