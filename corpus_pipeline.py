"""The corpus pipeline: stages over documents, each a training-data operator with its query's parameters.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps. All but the last return
the columns of ``documents``; ``run`` writes every stage's rows as Parquet to the shared folder and gives them to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchlight.llm import mixing, packing, quality, simhash, toxicity
from branchlight.llm.queries import quality_folds, tokenizer_file, toxicity_folds
from branchlight.llm.shared import table, written


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), toxicity_folds(F.col("doc_id")), threshold=0.3)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.with_quality(docs, table(spark, sf_dir, "labels"), quality_folds(F.col("doc_id")), threshold=0.3)


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.one_of_each(docs, shingle=4, radius=4)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most=3)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids and the checksum of these."""
    pieces = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1, window=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "ids")


STAGES = [("toxicity", not_toxic), ("quality", good), ("near_duplicates", unique), ("mixing", mixed), ("packing", packed)]
#: Classifiers, SimHash and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
