"""Tiered stock alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stock as S
from ..params import check_limit
from .activity import drop_inactive_inventory
from .clean import filter_branch


def alert_rows(inventory: DataFrame, as_of: str | None = None) -> DataFrame:
    """Every stock row that falls in an alert band, unsorted. Works on batch and streaming input."""
    stamp: Column = F.lit(as_of).cast("timestamp_ntz")
    rows = inventory.filter("product_code IS NOT NULL AND product_code NOT IN ('', 'Unknown')").withColumn(
        "current_stock", S.clean_stock(F.col("Last_on_hand")))
    rows = rows.withColumn("_band", S.alert_level(F.col("current_stock"))).filter("_band IS NOT NULL")
    return rows.select(
        "product_code", S.short_name(F.coalesce("product_name", "product_code")).alias("product_name"),
        "branch_code", "current_stock", F.col("_band.status").alias("alert_status"),
        F.col("_band.style").alias("status_class"), F.col("_band.priority").alias("priority"),
        stamp.alias("last_updated"))


def inventory_alerts(inventory: DataFrame, sales: DataFrame, branch: str | None = None, limit: int | None = 10,
                     as_of: str | None = None, status: str | None = None) -> DataFrame:
    """The most urgent alerts of active items: by priority, then stock. ``limit=None`` keeps all.

    Sales enter as one row per product; stock rows are shuffled once, by product."""
    inventory, sales = filter_branch(inventory, branch), filter_branch(sales, branch)
    rows = filter_severity(alert_rows(drop_inactive_inventory(sales, inventory), as_of), status)
    rows = rows.orderBy("priority", "current_stock", "product_code", "branch_code")
    return rows if limit is None else rows.limit(check_limit(limit))


def filter_severity(alerts: DataFrame, status: str | None) -> DataFrame:
    return alerts if status in (None, "", "all") else alerts.filter(F.col("alert_status") == status)


def alert_summary(alerts: DataFrame) -> DataFrame:
    """Total and count per level over all alerts."""
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"), *[
        F.count_if(F.col("alert_status") == label).alias(level) for level, _, _, label, _, _ in S.ALERT_BANDS])


def alert_levels(inventory: DataFrame) -> DataFrame:
    """Band of each stock row, with 'none' above all bands."""
    band = S.alert_level(S.clean_stock(F.col("Last_on_hand")))
    return inventory.select("product_code", "branch_code", S.clean_stock(F.col("Last_on_hand")).alias("stock"),
                            F.coalesce(band["level"], F.lit("none")).alias("level"),
                            band["status"].alias("alert_status"), band["style"].alias("status_class"),
                            F.coalesce(band["priority"], F.lit(0)).alias("priority"))
