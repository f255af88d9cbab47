"""Concurrency peaks on a stream of starts and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import running

WATERMARK = "10 minutes"


def operation_edges(events: DataFrame, ts: str = "ts", phase: str = "phase") -> DataFrame:
    """(at, step) of each event: one operation more at a ``start``, one less at a ``finish``; other phases change nothing."""
    return events.select(F.col(ts).cast("timestamp").alias("at"),
                         F.when(F.col(phase) == "start", 1).when(F.col(phase) == "finish", -1).alias("step"))


def stream_concurrency_peaks(edges: DataFrame, target: str, state: str, at_least: int = 5, watermark: str = WATERMARK,
                             slot: str = "1 minute") -> StreamingQuery:
    """Write the moments of ``edges`` (at, step) with at least ``at_least`` operations active afterwards below ``target``.

    Steps are netted per moment in the stream's own state, and a moment comes out once the watermark has passed its
    slot. Each trigger adds them up range by range, as the batch rule does, from the level that the trigger before it left,
    so operations may span any number of slots and no task holds a trigger's moments. A repeated trigger starts from the
    same level and replaces its own rows. An end later than the watermark's delay is lost, and its operation stays active."""
    nets = (edges.withWatermark("at", watermark).groupBy(F.window("at", slot), F.unix_micros("at").alias("us"))
            .agg(F.sum("step").alias("step")).select(F.timestamp_micros("us").alias("at"), "step"))

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        level = _level(spark, target, batch_id)
        peaks = running(batch.filter("step IS NOT NULL"), ["at"], sums={"active": F.col("step")})
        whole = peaks.withColumn("active", F.col("active") + level)
        whole.filter(F.col("active") >= at_least).select(F.col("at").alias("moment"), "active").write.mode(
            "overwrite").parquet(f"{target}/peaks/batch={batch_id}")
        whole.agg(F.coalesce(F.max_by("active", "at"), F.lit(level)).cast("long").alias("level")).write.mode(
            "overwrite").parquet(f"{target}/level/batch={batch_id}")

    return (nets.writeStream.outputMode("append").foreachBatch(add).option("checkpointLocation", state)
            .trigger(availableNow=True).start())


def _level(spark: SparkSession, target: str, batch_id: int) -> int:
    """Operations active at the end of the newest complete trigger before ``batch_id``; older levels are removed."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(f"{target}/level")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = sorted(int(found.getPath().getParent().getName().removeprefix("batch="))
                  for found in fs.globStatus(jvm.Path(root, "batch=*/_SUCCESS")) or [])
    before = [n for n in done if n < batch_id]
    for old in before[:-1]:
        fs.delete(jvm.Path(root, f"batch={old}"), True)
    return spark.read.parquet(f"{target}/level/batch={before[-1]}").first().level if before else 0


def read_peaks(spark: SparkSession, target: str) -> DataFrame:
    """(moment, active) of all triggers so far."""
    return spark.read.schema("moment timestamp, active long, batch long").parquet(f"{target}/peaks").select("moment", "active")
