"""From raw documents to token ids: toxic texts go, near copies go, repeated substrings and benchmark passages go, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.llm import bpe, common, decontaminate, near_dedup, substrings, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.without_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substrings that stand in the documents more than once are cut out."""
    return substrings.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontaminate.without_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The digests of each document's ids and of the text decoded from them."""
    return bpe.digest(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_copies), ("suffix_array_dedup", repeats), ("decontamination", benchmark), ("bpe", encode)]

#: No stage but the last two could be put in SQL over whole tables; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
