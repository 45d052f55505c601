"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every row is decided by its own text, whatever its id: null and repeated ids are no special case. Of rows of equal or nearly
equal text one stays, that with the smallest id (nulls last); rows without words all stay, as do rows without a text. A
document of which substring dedup leaves nothing goes; rows without an id are not cut, as no id is smaller than theirs. The
stages but the last keep all columns of their input, whatever these are called; the last gives digests. An empty table gives empty results. Without labels of
both kinds the first stage keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, near_dedup, queries, substring_dedup, toxicity
from tidemark.llm.common import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, scores below 0.5."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable=queries.learnable())
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, width=5, threshold=0.8)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id holds as well."""
    return substring_dedup.drop_passages(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of each document."""
    return bpe.encode_digests(docs, queries.BPE)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The classifier and the searches are not to be had in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
