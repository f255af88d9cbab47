"""Small helpers of the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Bytes that separate words: space and 0x09 to 0x0D, the bytes on which bytes.split() splits as well.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, rows_each: int) -> int:
    """Shuffle partitions so that none holds many more than ``rows_each`` rows, the session's number at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(df.count() / rows_each))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """A broadcast hint only if ``df`` is counted to have at most ``most_rows`` rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, chosen: Column, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled documents whose id satisfies ``chosen`` (an expression over doc_id).

    The rows with the smallest hashes of their ids are taken, so the sample doesn't depend on partitions; of rows that
    repeat an id, the first by the text's hash. Only ids are ordered; texts are fetched by a join with the bounded id list.
    """
    picked = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & chosen)
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .join(docs.select("doc_id"), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))
    return (texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(first.alias("first"))
            .select("doc_id", "first.text", "label"))


def scored_texts(docs: DataFrame, model, scorer: Callable) -> DataFrame:
    """(doc_id, score) of every document; ``scorer(model)`` gives a function from a text array to scores."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score = scorer(held.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")), pa.float64())],
                                             names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def rows_by_score(docs: DataFrame, model, scorer: Callable, keep: Callable) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text's score satisfies ``keep``."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        score = scorer(held.value)
        for batch in batches:
            yield batch.filter(pa.array(keep(score(batch.column(at)))))

    return docs.mapInArrow(run, docs.schema)
