"""Upload statistics, request rates, stuck operations and expiry on streams.

Late rows are waited for by a ten-minute watermark; a window is written once the watermark has passed its end."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import tables

WATERMARK = "10 minutes"


def stream_upload_stats(log: DataFrame, window: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """Successes, failures and mean processing time per tumbling window."""
    ok, bad = F.col("event") == "upload_success", F.col("event") == "upload_failure"
    rows = log.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", WATERMARK)
    return rows.filter(ok | bad).groupBy(F.window("_ts", window).alias("_w")).agg(
        F.count_if(ok).alias("successful"), F.count_if(bad).alias("failed"),
        F.avg(F.when(ok, F.col("processing_time_ms"))).alias("average_processing_time_ms")).select(
        F.col("_w.start").alias("window_start"), "successful", "failed", "average_processing_time_ms")


def stream_rate_windows(requests: DataFrame, most: int = 10, window: str = "1 minute", slide: str = "10 seconds",
                        ts: str = "ts", user: str = "username") -> DataFrame:
    """(user, sliding window) pairs with more than ``most`` requests: fixed windows, for a rough and cheap limit.
    ``ordered.stream_rate_violations`` is the exact trailing rule."""
    rows = requests.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", WATERMARK)
    counts = rows.groupBy(user, F.window("_ts", window, slide).alias("_w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.filter(F.col("requests") > most).select(
        user, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "requests")


def stream_stuck_operations(events: DataFrame, limit_seconds: int = 600, ts: str = "ts") -> DataFrame:
    """Operations (``op_id``, ``phase`` start/finish) whose end has not come within the limit of event time.

    One small state per operation, which keeps an end that is read before its start; the event-time timer fires when the
    watermark passes the deadline (or the time of an end whose start hasn't come)."""
    limit_ms = limit_seconds * 1000

    def late(key: tuple, start: int) -> pd.DataFrame:
        return pd.DataFrame({"op_id": [key[0]], "started": [pd.Timestamp(start, unit="ms")],
                             "deadline": [pd.Timestamp(start + limit_ms, unit="ms")]})

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, finished = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            state.remove()
            if started is not None and (finished is None or finished > started + limit_ms):
                yield late(key, started)
            return
        rows = pd.concat(list(frames))
        at_ms = rows["_ts"].map(lambda t: int(t.timestamp() * 1000))
        starts, ends = at_ms[rows["phase"] == "start"], at_ms[rows["phase"] == "finish"]
        started = min([int(x) for x in starts] + ([started] if started is not None else []), default=None)
        finished = min([int(x) for x in ends] + ([finished] if finished is not None else []), default=None)
        # Either side may be read first: both stay until the watermark has passed what could still come.
        due, mark = (started + limit_ms if started is not None else finished), state.getCurrentWatermarkMs()
        if due <= mark:
            if state.exists:
                state.remove()
            if started is not None and (finished is None or finished > due):
                yield late(key, started)
            return
        state.update((started, finished))
        state.setTimeoutTimestamp(due)

    rows = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", WATERMARK)
    return rows.select("op_id", "phase", "_ts").groupBy("op_id").applyInPandasWithState(
        watch, "op_id long, started timestamp, deadline timestamp", "started_ms long, finished_ms long", "append",
        GroupStateTimeout.EventTimeTimeout)


def stream_expire(records: DataFrame, ttl: str, as_of: str, ts: str = "ts") -> DataFrame:
    """Records whose own lifetime hasn't ended at ``as_of``; a replay gives the same rows.

    Every record expires by its own time; a newer version of a key doesn't depend on an older one.
    ``ordered.stream_expirations`` follows keys through their versions by event time."""
    return records.filter(F.col(ts).cast("timestamp") + F.expr(f"INTERVAL {ttl}") > F.lit(as_of).cast("timestamp"))


def upsert_stream(changes: DataFrame, target: str, keys: list[str], version: str, state: str, buckets: int = 64):
    """Keep ``target`` at the newest version of every key. Each trigger writes only the key buckets that it touches and commits
    them as a new version of the table (``sources.tables``), so a lost executor never leaves a half-written one.

    A version notes stream and batch; a batch that is repeated finds its note and changes nothing. Two streams may write to
    one target: the one that finds its version taken starts again from the newest. A target that holds whole generations
    instead is taken over from the newest complete one, which stays as it is."""
    name = hashlib.sha256(state.encode()).hexdigest()[:16]

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def first():
            whole = max(_whole_generations(spark, target), default=-1)
            return whole, read_generation(spark, target, whole)

        for tries in range(10):
            try:
                tables.upsert(batch, target, keys, version, buckets, stream=name, batch=batch_id, first=first)
                return
            except tables.ConcurrentChange:
                if tries == 9:
                    raise

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def _whole_generations(spark, target: str) -> list[int]:
    """Complete generations that were written as whole folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f for pattern in ("generation=*/_SUCCESS", "generation=*/stream=*/batch=*/_SUCCESS")
             for f in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []]
    return sorted(int(f.getPath().toString().split("/generation=", 1)[1].split("/")[0]) for f in found)


def generations(spark, target: str) -> dict[int, tuple[str, int] | None]:
    """The versions of ``target`` with the stream and batch that wrote each, if a stream did."""
    out: dict[int, tuple[str, int] | None] = dict.fromkeys(_whole_generations(spark, target))
    for n in tables.numbers(spark, target):
        writer = tables.version(spark, target, n).writer
        out[n] = tuple(writer) if writer else None
    return out


def read_generation(spark, target: str, generation: int) -> DataFrame | None:
    """The rows of one version; None before the first."""
    if generation < 0:
        return None
    if tables.number_taken(spark, target, generation):
        return tables.read(spark, target, tables.version(spark, target, generation)).drop("_bucket")
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/generation={generation}")
