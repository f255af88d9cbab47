"""User functions over row chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LEDGER = "chunk_id string, ok boolean, error string, items long, result string"


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Frames of ``size`` rows, carried over batch borders; the last may be shorter."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        while len(batch):
            part, batch = batch.iloc[:size - rows], batch.iloc[size - rows:]
            held.append(part)
            rows += len(part)
            if rows == size:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], object], chunk_size: int = 50) -> DataFrame:
    """Run ``fn`` on chunks of each partition; one ledger row per chunk with its outcome or its error.

    Every chunk but a partition's last has ``chunk_size`` rows, whatever size the Arrow batches have. A failing
    chunk is reported and does not stop the others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, at = TaskContext.get().partitionId(), 0
        for chunk in _chunks(batches, chunk_size):
            try:
                row = (f"{part}-{at}", True, None, len(chunk), str(fn(chunk)))
            except Exception as err:  # noqa: BLE001  the ledger carries every error of the user's function
                row = (f"{part}-{at}", False, f"{type(err).__name__}: {err}", len(chunk), None)
            at += 1
            yield pd.DataFrame([row], columns=["chunk_id", "ok", "error", "items", "result"])
    return df.mapInPandas(run, _LEDGER)


def batch_report(ledger: DataFrame) -> DataFrame:
    done = F.sum(F.when(F.col("ok"), F.col("items")).otherwise(0))
    total = F.coalesce(F.sum("items"), F.lit(0))
    return ledger.agg(total.alias("total_items"), F.coalesce(done, F.lit(0)).alias("processed_items"),
                      (total - F.coalesce(done, F.lit(0))).alias("failed_items"),
                      F.count_if(~F.col("ok")).alias("failed_chunks"),
                      F.when(total > 0, done / total * 100).otherwise(0.0).alias("success_rate"))


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a frame-to-frame function to Arrow batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)
    return df.mapInPandas(run, schema)
