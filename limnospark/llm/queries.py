"""One query per operator: the operator on its whole table with production
parameters, and the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, imi, laesa, mixing, quality, repair_runs, sharding, simhash, spotsigs, suffix_dedup, token_files, toxicity
from . import sentencepiece_lattice as lattice
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(load(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(load(spark, sf_dir, "documents"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, nearest_n=20)


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = lattice.MODEL) -> DataFrame:
    return lattice.encode(load(spark, sf_dir, "documents"), lattice.Model.load(model))


#: Target weights of the mix: a path of the tree to its weight among its
#: siblings; paths not named have weight 1.
MIX_WEIGHTS = {
    "web": 5.0, "books": 3.0, "reference": 2.0,
    **{f"{d}/{lang}": w for d in ("web", "books", "reference") for lang, w in (("en", 6.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
}


def domain_of(source: str = "source") -> Column:
    """The tables name no domain; a source's number decides it here."""
    number = F.regexp_extract(F.col(source), r"(\d+)$", 1).try_cast("long")
    return F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("reference")), (F.coalesce(number, F.lit(0)) % 3 + 1).cast("int"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    chosen = mixing.mix(docs, domain_of(), share=0.8, weights=MIX_WEIGHTS, epochs=3, seed=5)
    return chosen.select(
        "doc_id", F.col("_mix_domain").alias("domain"), "lang", "source", mixing.tokens_of().alias("n_tokens"),
        F.col("_mix_epoch").alias("epoch"), F.col("_mix_budget").alias("leaf_budget"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edit_check(load(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"), shingle=4, radius=4)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(load(spark, sf_dir, "documents"), shards=24).drop("row_number")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.report(load(spark, sf_dir, "documents"))


def op12_repair_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_runs.report(load(spark, sf_dir, "documents"))


def op13_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.encode(load(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_html_extraction, op2_suffix_dedup, op3_multi_index, op4_sentencepiece, op5_mixing, op6_spotsigs, op7_toxicity, op8_quality, op9_simhash, op10_sharding,
                                  op11_token_files, op12_repair_runs, op13_laesa)}


def oracle_sql() -> dict[str, str]:
    return {}
