"""Named queries over the driver's tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and arrays as text, so two engines' results compare value by value."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), " | ", "")
        out.append(c.alias(field.name))
    return df.select(*out)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: portable(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def he(expr: str, digits: int = 0) -> str:
    """SQL text of half-to-even rounding on the scaled value."""
    y = f"(({expr}) * {10 ** digits}.0::DOUBLE)" if digits else f"({expr})"
    whole = f"(CASE WHEN abs({y} - trunc({y})) = 0.5 THEN 2 * round({y} / 2) ELSE round({y}) END)"
    return f"({whole} / {10 ** digits}.0::DOUBLE)" if digits else whole


def money(expr: str) -> str:
    return f"CAST(round({expr}, 2) AS DOUBLE)"
