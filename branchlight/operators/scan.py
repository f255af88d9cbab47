"""Running totals, row numbers and carried values over orderings too large for one task.

A plain window without a partition key, or with one hot key, sorts everything in a single task.
Here the rows are first split into ranges of (keys, order), each range is summarised, the few range
summaries are combined, and every range then finishes its own window from its starting offset.
A key that fills many ranges is therefore worked on by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

_PART = "_range"
#: Rows that a range has at most, about.
ROWS = 2_000_000


def _name(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def running(df: DataFrame, order: Sequence[Column | str], keys: Sequence[str] = (),
            sums: Mapping[str, Column] | None = None, row_number: str | None = None,
            last_known: Mapping[str, Column] | None = None,
            previous: Mapping[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """Add running columns to ``df`` in the given order, separately per ``keys``.

    ``sums``: name -> expression, inclusive running total (use integers or decimals for exact results).
    ``row_number``: name of a 1-based position column.
    ``last_known``: name -> expression, last non-null value up to and including this row.
    ``previous``: name -> expression, value of the row just before (NULL on the first row).
    The order must be total within a key; key columns must not be null.
    """
    sums, last_known, previous = dict(sums or {}), dict(last_known or {}), dict(previous or {})
    order = [_name(o) for o in order]

    inputs = {**{f"_s_{n}": e for n, e in sums.items()}, **{f"_l_{n}": e for n, e in last_known.items()},
              **{f"_p_{n}": e for n, e in previous.items()}}
    rows = df.withColumns(inputs) if inputs else df
    by = [F.col(k) for k in keys] + order
    if not ranges:
        # As many ranges as the rows need. Up to the shuffle partitions, adaptive execution merges small ones.
        rows = staged(rows)
        needed = math.ceil(rows.count() / ROWS)
        ranges = needed if needed > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    rows = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    rows = staged(rows.withColumn(_PART, F.spark_partition_id()))

    within = Window.partitionBy(*keys, _PART).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    # Range summaries: only keys that reach into more than one range need an offset. A range has one
    # first and one last key, so at most two rows per range are left and the broadcast stays that small.
    tops = rows.withColumns({
        "_at": F.row_number().over(within),
        **{f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(upto) for n in last_known}})
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]]
    aggs += [F.max_by(f"_l_{n}", "_at").alias(f"_l_{n}") for n in last_known]
    aggs += [F.max_by(F.struct(f"_p_{n}"), "_at").alias(f"_p_{n}") for n in previous]
    source = tops if (last_known or previous) else rows
    totals = source.groupBy(*keys, _PART).agg(*aggs)
    spread = Window.partitionBy(*keys)
    before = spread.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumn("_spans", F.count(F.lit(1)).over(spread)).filter("_spans > 1").select(
        *keys, _PART,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        *[F.sum(f"_s_{n}").over(before).alias(f"_s0_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l0_{n}") for n in last_known],
        *[F.last(f"_p_{n}").over(before).alias(f"_p0_{n}") for n in previous]))

    joined = rows.join(F.broadcast(offsets), [*keys, _PART], "left")
    out: dict[str, Column] = {}
    if row_number:
        out[row_number] = F.row_number().over(within) + F.coalesce(F.col("_n0"), F.lit(0))
    for n in sums:
        own = F.sum(f"_s_{n}").over(upto)
        out[n] = F.when(F.col(f"_s0_{n}").isNull(), own).otherwise(F.coalesce(own, F.col(f"_s0_{n}") * 0)
                                                                  + F.col(f"_s0_{n}"))
    for n in last_known:
        out[n] = F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(upto), F.col(f"_l0_{n}"))
    for n in previous:
        out[n] = F.when(F.row_number().over(within) == 1, F.col(f"_p0_{n}")[f"_p_{n}"]).otherwise(
            F.lag(f"_p_{n}").over(within))
    drop = [c for c in joined.columns if c not in df.columns]
    return joined.withColumns(out).drop(*[c for c in drop if c not in out])
