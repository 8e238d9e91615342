"""From raw documents to encoded training text, one operator a stage; each stage is written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.llm import op01_pii, op02_jaccard, op03_bpe, op06_decontaminate, op10_quality
from kernelweave.session import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return op10_quality.kept_only(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return op02_jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly benchmark go."""
    return op06_decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return op01_pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document."""
    return op03_bpe.encode(docs, op03_bpe.vocabulary_path()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", quality_rules), ("near copies", near_copies), ("decontamination", decontaminate), ("pii", redact), ("bpe", encode)]
ORACLE_SQL = None  # perplexity bands, suffix automata and merges are not SQL; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
