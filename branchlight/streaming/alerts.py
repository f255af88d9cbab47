"""Stock alerts, resource alerts and repeat suppression on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.alerts import alert_rows
from ..operators.monitor import resource_alerts
from .ordered import stream_suppress_repeats

__all__ = ["stream_resource_alerts", "stream_stock_alerts", "stream_suppress_repeats"]


def stream_stock_alerts(stock: DataFrame, as_of: str | None = None) -> DataFrame:
    """Alerts for every stock update in a band. Stateless; the rule is the one of the batch alerts."""
    return alert_rows(stock, as_of)


def stream_resource_alerts(readings: DataFrame, percent: float = 90, memory_mb: float = 1000) -> DataFrame:
    return resource_alerts(readings, percent, memory_mb)
