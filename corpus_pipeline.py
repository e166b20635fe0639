"""The corpus pipeline: documents that are not toxic, one of each group of
near copies, without repeated passages, mixed to target weights, encoded.

Each stage takes all that the one before kept; between stages the table is
written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from limnospark.llm import mixing, simhash, suffix_dedup, toxicity
from limnospark.llm import sentencepiece_lattice as lattice
from limnospark.llm.common import discard, load, settled
from limnospark.llm.queries import MIX_WEIGHTS, domain_of


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go (score 0.3 or more)."""
    return toxicity.clean(docs, load(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of fingerprints within 4 bits stays."""
    return simhash.one_of_each(docs, shingle=4, radius=4)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur elsewhere go from the texts."""
    return suffix_dedup.clean(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the target weights, each row once at most."""
    return mixing.mix(docs, domain_of(), share=0.8, weights=MIX_WEIGHTS, epochs=1, seed=5).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return lattice.encode(docs, lattice.Model.load())


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: Hashes, trained weights and merges are beyond DuckDB SQL; tests hold each
#: stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
