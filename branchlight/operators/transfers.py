"""Branch balance and transfer proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stock as S
from ..functions.numeric import ratio
from ..params import AnalysisParams
from .inventory import selling_day_rates


def branch_sales_rate(sales: DataFrame) -> DataFrame:
    """Per (branch, product): quantity, selling days and quantity per selling day."""
    rates = selling_day_rates(sales, ("branch_code", "product_code"))
    return rates.select("branch_code", "product_code", F.col("quantity_sold").alias("total_quantity_sold"),
                        "sale_days", ratio(F.col("quantity_sold"), F.col("sale_days"), 0.0).alias("avg_daily_sales"))


def branch_balance(sales: DataFrame, inventory: DataFrame, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Stock rows of branches that sold anything, with rate, coverage and shortage/balanced/surplus label.

    A branch without sales in the window is left out entirely."""
    rates = branch_sales_rate(sales).select("branch_code", "product_code", "avg_daily_sales")
    selling = rates.select("branch_code").distinct()
    cols = ["branch_code", "product_code", "product_name", "item_category1", "item_category2", "Last_on_hand"]
    rows = (inventory.select(*cols).join(selling, "branch_code", "left_semi")
            .join(rates, ["branch_code", "product_code"], "left")
            .withColumn("avg_daily_sales", F.coalesce("avg_daily_sales", F.lit(0.0))))
    rows = rows.withColumn("coverage_days", ratio(F.col("Last_on_hand"), F.col("avg_daily_sales")))
    return (rows.filter(~((F.col("Last_on_hand") == 0) & (F.col("avg_daily_sales") == 0)))
            .withColumn("coverage_status", S.coverage_label(F.col("coverage_days"), params.min_coverage,
                                                            params.max_coverage)))


def propose_transfers(balance: DataFrame, min_days: float = 7, max_days: float = 30) -> DataFrame:
    """Who sends how much to whom, per product.

    Serving needy branches one after the other from donors one after the other is the same as laying both on
    a line of running totals and taking the overlaps. A product has at most one row per branch, which bounds
    each window and each side of the join.
    """
    rate, cover = F.col("avg_daily_sales"), F.col("coverage_days")
    one = (balance.filter((cover < min_days) | (cover > max_days))
           .groupBy("product_code", "branch_code").agg(F.min(F.struct(
               "Last_on_hand", "avg_daily_sales", "coverage_days", "product_name", "item_category1",
               "item_category2")).alias("_r")).select("product_code", "branch_code", "_r.*"))
    amount = (F.when(cover < min_days, (F.lit(float(min_days)) - cover) * rate)
              .otherwise((cover - F.lit(float(max_days))) * rate)).cast("bigint")
    sides = one.withColumns({"_needy": cover < min_days, "_qty": amount}).filter("_qty > 0")
    line = Window.partitionBy("product_code", "_needy").orderBy("branch_code").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    sides = sides.withColumn("_end", F.sum("_qty").over(line)).withColumn("_start", F.col("_end") - F.col("_qty"))
    need = sides.filter("_needy").select(
        "product_code", "product_name", "item_category1", "item_category2", F.col("branch_code").alias("to_branch"),
        F.col("_start").alias("_ns"), F.col("_end").alias("_ne"))
    offer = sides.filter("NOT _needy").select(
        F.col("product_code").alias("_code"), F.col("branch_code").alias("from_branch"),
        F.col("_start").alias("_os"), F.col("_end").alias("_oe"))
    overlap = F.least("_ne", "_oe") - F.greatest("_ns", "_os")
    return (need.join(offer, (F.col("product_code") == F.col("_code")) & (F.col("_ns") < F.col("_oe"))
                      & (F.col("_os") < F.col("_ne")))
            .select("product_code", "product_name", "item_category1", "item_category2", "from_branch", "to_branch",
                    overlap.alias("transfer_qty")))


def filter_transfers(proposals: DataFrame, source: str | None = None, target: str | None = None) -> DataFrame:
    if source not in (None, "", "all"):
        proposals = proposals.filter(F.col("from_branch") == source)
    if target not in (None, "", "all"):
        proposals = proposals.filter(F.col("to_branch") == target)
    return proposals


def transfer_report_tables(balance: DataFrame, proposals: DataFrame) -> dict[str, DataFrame]:
    """Branch summary and transfer list in export column order."""
    return {
        "summary": balance.select("branch_code", "product_code", "product_name", "item_category1", "item_category2",
                                  "Last_on_hand", "avg_daily_sales", "coverage_days", "coverage_status"),
        "transfers": proposals.select("product_code", "product_name", "item_category1", "item_category2",
                                      "from_branch", "to_branch", "transfer_qty")}
