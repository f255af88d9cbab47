"""Rate, concurrency, stuck-operation and repeat-alert rules on stored logs.

``branchlight.streaming`` holds the same rules on streams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .oplog import moment
from .scan import running


def rate_violations(requests: DataFrame, most: int = 10, seconds: int = 60, ts: str = "ts",
                    user: str = "username") -> DataFrame:
    """Requests that are refused or late because their user made more than ``most`` in the ``seconds`` up to them.

    The span is open at its start: a request exactly ``seconds`` ago no longer counts. A user's time line is cut into spans of
    that length and each span also sees the one before it, so a busy user's requests are counted by many tasks."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    length = seconds * 1_000_000
    span = F.floor(F.col("_at") / length)
    seen = (requests.withColumn("_at", micros).withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
            .withColumn("_span", F.when(F.col("_own"), span).otherwise(span + 1)))
    upto = Window.partitionBy(user, "_span").orderBy("_at").rangeBetween(1 - length, 0)
    counted = seen.withColumn("requests", F.count(F.lit(1)).over(upto))
    return counted.filter((F.col("_own")) & (F.col("requests") > most)).select(user, ts, "requests")


def rate_windows(requests: DataFrame, most: int = 10, window: str = "1 minute", slide: str | None = None,
                 ts: str = "ts", user: str = "username") -> DataFrame:
    """(user, window) pairs with more than ``most`` requests: the rule on fixed windows, as streams apply it."""
    frame = F.window(F.col(ts), window, slide) if slide else F.window(F.col(ts), window)
    counts = requests.groupBy(user, frame.alias("_w")).agg(F.count(F.lit(1)).alias("requests"))
    return counts.filter(F.col("requests") > most).select(
        user, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "requests")


def concurrency_peaks(ops: DataFrame, at_least: int = 5) -> DataFrame:
    """Moments at which an operation starts or ends with at least ``at_least`` operations active afterwards.

    Starts and ends are netted per moment first; the running sum over all time is built range by range."""
    edges = ops.select(F.explode(F.array(
        F.struct(F.col("started").alias("at"), F.lit(1).alias("step")),
        F.struct(F.col("finished").alias("at"), F.lit(-1).alias("step")))).alias("_e")).select("_e.*")
    net = edges.filter("at IS NOT NULL").groupBy("at").agg(F.sum("step").alias("step"))
    return running(net, ["at"], sums={"active": F.col("step")}).filter(F.col("active") >= at_least).select(
        F.col("at").alias("moment"), "active")


def stuck_operations(starts: DataFrame, finishes: DataFrame, as_of: str, limit_seconds: int = 600) -> DataFrame:
    """Started operations without an end inside the limit, judged at ``as_of``."""
    limit = F.make_dt_interval(secs=F.lit(limit_seconds))
    ends = finishes.select(F.col("op_id").alias("_id"), F.col("finished").alias("_end"))
    in_time = (F.col("op_id") == F.col("_id")) & (F.col("_end") <= F.col("started") + limit)
    late = starts.join(ends, in_time, "left_anti").filter(F.col("started") + limit < moment(as_of))
    return late.withColumn("deadline", F.col("started") + limit)


def resource_alerts(metrics: DataFrame, percent: float = 90, memory_mb: float = 1000) -> DataFrame:
    """Alert rows for readings over their limit. Works on batch and streaming input."""
    names = {"memory": "high_system_memory", "cpu": "high_system_cpu", "disk": "high_disk_usage",
             "operation_memory": "high_memory_usage"}
    limits = F.when(F.col("metric") == "operation_memory", F.lit(float(memory_mb))).otherwise(F.lit(float(percent)))
    label = None
    for metric, alert in names.items():
        hit = F.col("metric") == metric
        label = F.when(hit, alert) if label is None else label.when(hit, alert)
    return metrics.withColumns({"alert_type": label, "threshold": limits}).filter(
        "alert_type IS NOT NULL AND value > threshold")


# --- repeat suppression ---------------------------------------------------------------------------
#
# An alert is emitted when the last *emitted* alert of its type is older than the quiet time, so each decision
# depends on the one before. It is made parallel all the same: the distinct times are cut into ranges of about
# equally many rows, whatever their types, and within a range every alert is followed to the last emission that a
# walk starting at it makes there, its exit. A walk goes on at the first alert at least the quiet time after its exit,
# which a scan over all ranges finds for every exit; so each exit has a next exit. The exits that are really reached
# from each type's first alert are found by pointer doubling: as many joins as the logarithm of the number of ranges.
# Each range is then replayed from the alerts at which the walk enters it. A task holds one range at a time.

_LINKS = "alert_type string, at_us long, exit_us long, range long"


def _exits(quiet: int):
    def exits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(frames)  # one range
        if held:
            for kind, part in pd.concat(held).groupby("alert_type", sort=False):
                times = np.sort(part["at_us"].to_numpy())
                place = np.arange(len(times))
                following = np.searchsorted(times, times + quiet, side="left")
                last = np.where(following < len(times), following, place)
                for _ in range(len(times).bit_length()):
                    last = last[last]
                yield pd.DataFrame({"alert_type": kind, "at_us": times, "exit_us": times[last],
                                    "range": TaskContext.get().partitionId()})
    return exits


def _replay(quiet: int):
    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, part in pdf.groupby("alert_type", sort=False):
            times = np.sort(part["at_us"].to_numpy())
            for entry in np.sort(part.loc[part["entered"], "at_us"].to_numpy()):
                i = int(np.searchsorted(times, entry))
                while i < len(times):
                    out.append((kind, times[i]))
                    i = int(np.searchsorted(times, times[i] + quiet, side="left"))
        return pd.DataFrame(out, columns=["alert_type", "at_us"])
    return replay


def suppress_repeat_alerts(alerts: DataFrame, quiet_seconds: int = 300, range_rows: int = 1_000_000,
                           ts: str = "ts", kind: str = "alert_type") -> DataFrame:
    """Emitted alerts (type, time): the first of a type, then each one at least the quiet time after the last
    emitted one. Equal times of one type count once; null types and times are left out.

    A task holds about ``range_rows`` rows, also where one type has all of them."""
    quiet = quiet_seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp")) if dict(alerts.dtypes)[ts] != "timestamp_ntz" else \
        F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    times = staged(alerts.select(F.col(kind).alias("alert_type"), at.alias("at_us")).dropna().distinct())
    ranges = max(1, math.ceil(times.count() / range_rows))
    links = staged(times.repartitionByRange(ranges, "alert_type", "at_us").mapInPandas(_exits(quiet), _LINKS))

    # Where a walk that left by an exit comes in again: the first alert at or after exit + quiet, from the last row back.
    exits = links.select("alert_type", "exit_us").distinct()
    both = links.select("alert_type", F.col("at_us").alias("us"), F.lit(None).cast("long").alias("exit_us"), F.lit(0).alias("asks")).unionAll(
        exits.select("alert_type", (F.col("exit_us") + quiet).alias("us"), "exit_us", F.lit(1)))
    back = running(both, [-F.col("us"), F.col("asks")], ["alert_type"],
                   last_known={"entry": F.when(F.col("asks") == 0, F.col("us"))}, ranges=ranges)
    entries = staged(back.filter("asks = 1 AND entry IS NOT NULL").select("alert_type", "exit_us", "entry"))
    reached = links.select("alert_type", F.col("at_us").alias("entry"), F.col("exit_us").alias("next"))
    jumps = staged(entries.join(reached, ["alert_type", "entry"]).select("alert_type", "exit_us", "next"))

    first = staged(links.groupBy("alert_type").agg(F.min("at_us").alias("at_us"), F.min_by("exit_us", "at_us").alias("exit_us")))
    seen, many = first.select("alert_type", "exit_us"), -1
    while True:
        further = seen.join(jumps, ["alert_type", "exit_us"]).select("alert_type", F.col("next").alias("exit_us"))
        seen = staged(seen.unionAll(further).distinct())
        count = seen.count()
        if count == many:
            break
        many = count
        onward = jumps.select("alert_type", F.col("exit_us").alias("next"), F.col("next").alias("after"))
        jumps = staged(jumps.join(onward, ["alert_type", "next"]).select("alert_type", "exit_us", F.col("after").alias("next")))

    entered = first.select("alert_type", "at_us").unionAll(
        seen.join(entries, ["alert_type", "exit_us"]).select("alert_type", F.col("entry").alias("at_us"))).distinct()
    marked = links.join(entered.withColumn("entered", F.lit(True)), ["alert_type", "at_us"], "left").select(
        "alert_type", "at_us", "range", F.coalesce("entered", F.lit(False)).alias("entered"))
    out = marked.groupBy("range").applyInPandas(_replay(quiet), "alert_type string, at_us long")
    return out.select("alert_type", (F.lit("1970-01-01").cast("timestamp_ntz")
                                     + F.make_dt_interval(secs=(F.col("at_us").cast("decimal(20,0)")
                                                                / F.lit(1_000_000).cast("decimal(10,0)"))
                                                          .cast("decimal(18,6)"))).alias("emitted_at"))
