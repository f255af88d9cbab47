"""Dashboard figures over sales and stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even, money
from ..session import staged
from .activity import drop_inactive


def sales_base(sales: DataFrame, by_month: bool = False) -> DataFrame:
    """Revenue per product (and month, as its first day) with the highest quantity of any row.

    The dashboard figures and the activity rule can be read off this smaller table, so the activity
    joins do not touch single sales rows."""
    keys = ["product_code"] + ([F.trunc("sale_date", "month").alias("month")] if by_month else [])
    return sales.groupBy(*keys).agg(F.sum("revenue").alias("revenue"), F.max("quantity_sold").alias("quantity_sold"))


def dashboard_inputs(sales: DataFrame, inventory: DataFrame, by_month: bool = False) -> tuple[DataFrame, DataFrame]:
    """What the dashboard shows: compact sales and stock of active products, orphan sales left out.

    The compact table is written out once; the activity rule and the figures both read that, so the sales
    themselves are scanned a single time."""
    return drop_inactive(staged(sales_base(sales, by_month)), inventory)


def dashboard_kpis(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Total revenue, products in stock, stock value and number of suppliers, as one row."""
    stocked = F.col("Last_on_hand") > 0
    left = sales.agg(F.coalesce(money(F.sum("revenue")), F.lit(0.0)).alias("total_sales"))
    value = F.coalesce("inventory_value", F.lit(0)).cast("decimal(18,4)") * F.col("Last_on_hand").cast("decimal(18,2)")
    right = inventory.agg(
        F.count_distinct(F.when(stocked, F.col("product_code"))).alias("total_products"),
        F.coalesce(money(F.sum(F.when(stocked, value))), F.lit(0.0)).alias("total_stock_value"),
        F.count_distinct("supplier_name").alias("total_suppliers"))
    return right.withColumn("total_sales", left.scalar())


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Revenue per calendar month; the label is made from the few grouped rows, not from every sale."""
    month = F.col("month") if "month" in sales.columns else F.trunc("sale_date", "month").alias("month")
    return sales.groupBy(month).agg(money(F.sum("revenue")).alias("revenue")).withColumn(
        "month", F.date_format("month", "yyyy-MM"))


def supplier_rows(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sales with every supplier that lists the product; a product with several suppliers fans out."""
    pairs = inventory.select("product_code", "supplier_name").distinct()
    return sales.join(pairs, "product_code", "left")


def _supplier_revenue(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    per_product = sales.filter("product_code IS NOT NULL").groupBy("product_code").agg(F.sum("revenue").alias("revenue"))
    return (supplier_rows(per_product, inventory).filter("supplier_name IS NOT NULL")
            .groupBy("supplier_name").agg(F.sum("revenue").alias("revenue")))


def top_suppliers(sales: DataFrame, inventory: DataFrame, n: int = 10) -> DataFrame:
    return (_supplier_revenue(sales, inventory).orderBy(F.desc("revenue"), "supplier_name").limit(n)
            .select("supplier_name", money(F.col("revenue")).alias("revenue")))


def supplier_distribution(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Revenue and percent of total for every supplier."""
    per = _supplier_revenue(sales, inventory)
    # The total reads the same shuffled rows as the listing itself (the exchange is reused).
    total = per.agg(F.sum("revenue").cast("double")).scalar()
    share = F.when(F.col("_total") > 0, half_even(F.col("revenue").cast("double") / F.col("_total") * 100, 2)) \
        .otherwise(0.0)
    return (per.withColumn("_total", total)
            .select("supplier_name", money(F.col("revenue")).alias("revenue"), share.alias("percentage")))


def department_stock(inventory: DataFrame, n: int | None = 10) -> DataFrame:
    per = (inventory.filter("item_category1 IS NOT NULL").groupBy("item_category1")
           .agg(F.sum("Last_on_hand").cast("double").alias("Last_on_hand"))
           .orderBy(F.desc("Last_on_hand"), "item_category1"))
    return per if n is None else per.limit(n)


def dashboard_report_tables(sales: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
    """The three export tables; unlike the dashboard they are not filtered by activity."""
    return {
        "monthly": monthly_revenue(sales).orderBy("month"),
        "suppliers": _supplier_revenue(sales, inventory).orderBy(F.desc("revenue"), "supplier_name")
        .select("supplier_name", money(F.col("revenue")).alias("revenue")),
        "departments": department_stock(inventory, None)}
