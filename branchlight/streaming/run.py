"""Draining a stream into a table, for replays and tests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: The time of the row that closes a replayed log, within the range of nanosecond clocks.
CLOSING = "2250-01-01 00:00:00"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the checkpoint folder every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything now available with the exactly-once file sink and read the result back."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "stream")
    query = (stream.writeStream.format("parquet").outputMode("append")
             .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_windows(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process everything now available of an aggregated stream and read all its windows, the open ones too.

    Each trigger replaces the whole result, so a repeated one changes nothing; state holds every window. That suits replays
    of a finished log; a stream that never ends writes windows as the watermark closes them."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark, "windows")
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows")
    query = (stream.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state")
             .foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, which map state and timers need. A stream that goes on from
    a checkpoint keeps the provider it has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def drain_to_the_end(rows: DataFrame, rule: Callable[[DataFrame], DataFrame], ts: str, folder: str | None = None,
                     run: Callable[[DataFrame, str], DataFrame] = drain) -> DataFrame:
    """Replay a finished log through an event-time ``rule`` and read all it gives, also for the rows at the log's end.

    Such a rule decides a row when the watermark has passed it. After the log a second run on the same checkpoint reads a
    closing row, null but for a time far ahead, which moves the watermark past everything and is never decided itself.
    ``run`` processes what is available of the ruled stream, with its checkpoint in the folder, and returns all results so far."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "stream")
    spark.createDataFrame([], rows.schema).write.parquet(f"{folder}/closing")
    out = rule(rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{folder}/closing")))
    run(out, folder)
    end = {f.name: F.lit(CLOSING if f.name == ts else None).cast(f.dataType).alias(f.name) for f in rows.schema}
    spark.range(1).select(*end.values()).write.mode("append").parquet(f"{folder}/closing")
    return run(out, folder)
