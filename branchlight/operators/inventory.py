"""Inventory analysis: sales rates, coverage, status, ABC and order advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stock as S
from ..functions.numeric import half_even, number_or_zero, ratio
from ..params import AnalysisParams
from ..session import staged
from .activity import top_stock
from .clean import missing_columns
from .scan import running

NO_COVERAGE = 9999.0
OPTIONAL_TEXT = ("item_category1", "item_category2", "supplier_name")


def product_sales_stats(sales: DataFrame) -> DataFrame:
    """Per product: quantity sum, mean and count, first and last sale, days spanned and rate per day."""
    return _sales_stats(sales.filter("product_code IS NOT NULL"))


def _sales_stats(sales: DataFrame) -> DataFrame:
    agg = (sales.groupBy("product_code").agg(
        half_even(F.sum("quantity_sold"), 2).alias("quantity_sold_sum"),
        half_even(F.avg("quantity_sold"), 2).alias("quantity_sold_mean"),
        F.count("quantity_sold").alias("quantity_sold_count"),
        F.min("sale_date").alias("sale_date_min"), F.max("sale_date").alias("sale_date_max"),
        F.max(number_or_zero(F.col("quantity_sold"))).alias("_top_sale")))
    days = F.datediff("sale_date_max", "sale_date_min") + 1
    return agg.withColumn("days_in_period", days).withColumn(
        "daily_sales", ratio(F.col("quantity_sold_sum"), F.col("days_in_period"), 0.0))


def _branch_columns(inventory: DataFrame) -> list[Column]:
    base = ["product_code", "product_name", "Last_on_hand", "branch_code"]
    return [F.col(c) for c in base] + [
        F.col(c) if c in inventory.columns else F.lit("-").alias(c) for c in OPTIONAL_TEXT]


def analyze_inventory(sales: DataFrame, inventory: DataFrame, params: AnalysisParams = AnalysisParams(),
                      ordered: bool = True) -> DataFrame:
    """One row per stock row with coverage, demand, order quantity, status, ABC grade and advice.

    Sales enter only as one row per product, written once: the inactive filter and the test whether there are sales at all
    (without any, nothing is filtered) read those rows. Stock rows are read once and shuffled once, by product.
    """
    gaps = (missing_columns(sales, ["product_code", "quantity_sold", "sale_date"]),
            missing_columns(inventory, ["product_code", "Last_on_hand"]))
    if any(gaps):
        raise ValueError(f"missing sales columns {gaps[0]}, missing inventory columns {gaps[1]}")
    p = params
    products = staged(_sales_stats(sales))
    # The inactive rule of operators.activity.
    idle = F.col("product_code").isNotNull() & (F.col("_top_stock") == 0) & (F.coalesce("_top_sale", F.lit(0.0)) <= 0)
    rows = (inventory.select(*_branch_columns(inventory)).withColumn("_top_stock", top_stock())
            .join(products.filter("product_code IS NOT NULL"), "product_code", "left").filter(~idle | ~products.exists()))

    have = number_or_zero(F.col("Last_on_hand"))
    daily = F.coalesce("daily_sales", F.lit(0.0))
    rows = rows.select(
        "product_code", "product_name", "branch_code", *OPTIONAL_TEXT,
        have.alias("_have"), daily.alias("_daily"),
        F.coalesce("quantity_sold_sum", F.lit(0.0)).alias("quantity_sold"),
        F.coalesce("quantity_sold_mean", F.lit(0.0)).alias("quantity_sold_mean"),
        F.coalesce("quantity_sold_count", F.lit(0)).alias("quantity_sold_count"),
        "sale_date_min", "sale_date_max",
        F.coalesce("days_in_period", F.lit(p.forecast_days)).alias("days_in_period"),
        ratio(have, daily, NO_COVERAGE).alias("_cover"),
        (daily * p.forecast_days).alias("_demand"))
    rows = rows.withColumn("status", S.stock_status(F.col("_have"), F.col("_cover"), F.col("_daily"), p))
    order = F.when(F.col("_daily") == 0, 0.0).otherwise(
        F.greatest(F.col("_demand") + F.lit(float(p.safety_stock)) - F.col("_have"), F.lit(0.0)))
    stagnant, enough = F.col("status") == S.STAGNANT, F.col("_have") >= F.col("_demand")
    killed = stagnant | enough
    out = rows.select(
        "product_code", "product_name", "branch_code", *OPTIONAL_TEXT,
        half_even(F.col("_have"), 2).alias("Last_on_hand"), "quantity_sold", "quantity_sold_mean",
        "quantity_sold_count", "sale_date_min", "sale_date_max", "days_in_period",
        half_even(F.col("_daily"), 2).alias("daily_sales"),
        half_even(F.col("_cover"), 2).alias("coverage_days"),
        F.when(~killed, F.col("_demand")).alias("expected_demand"),
        half_even(F.col("_demand"), 2).alias("forecasted_demand"),
        F.when(~killed, half_even(order, 2)).alias("recommended_order"),
        "status", stagnant.alias("is_stagnant"),
        S.status_priority(F.col("status")).alias("priority_score"),
        S.abc_by_rate(F.col("_daily")).alias("abc_classification"),
        S.status_advice(F.col("status"), F.col("_cover"), F.col("_daily")).alias("recommendations"),
        enough.alias("Stock_Is_Sufficient"))
    if ordered:
        out = out.orderBy("priority_score", "coverage_days", "product_code", "branch_code")
    return out


def critical_items(results: DataFrame, min_coverage: int = 7) -> DataFrame:
    return results.filter((F.col("coverage_days") < min_coverage) & (F.col("daily_sales") > 0))


def stagnant_items(results: DataFrame) -> DataFrame:
    return results.filter("is_stagnant")


# --- Pareto variant -------------------------------------------------------------------------------

A_SHARE, B_SHARE = 0.80, 0.95


def pareto_abc(quantities: DataFrame, quantity: str = "quantity_sold", key: str = "product_code") -> DataFrame:
    """Grade products by cumulative share of quantity, largest first; products without sales are C.

    The running total has no partition key, so it is built range by range (see ``scan.running``); ``quantities``
    is evaluated once for that and its other columns are kept. Equal quantities are taken in key order."""
    sold = F.col(quantity) > 0
    amount = F.when(sold, F.col(quantity)).otherwise(0).cast("decimal(28,4)")
    ranked = running(quantities, [F.col(quantity).desc_nulls_last(), F.col(key)], sums={"_upto": amount})
    total = ranked.agg(F.sum(amount).cast("double")).scalar()
    share = F.when(sold, ratio(F.col("_upto"), F.col("_total")))
    return ranked.withColumn("_total", total).select(
        *quantities.columns, share.alias("cumulative_share"),
        F.when(share <= A_SHARE, "A").when(share <= B_SHARE, "B").otherwise("C").alias("abc_classification"))


def selling_day_rates(sales: DataFrame, keys: tuple[str, ...] = ("product_code",)) -> DataFrame:
    """Quantity and number of distinct selling days per key.

    Grouping by day first keeps a hot product spread over its days before the final merge."""
    daily = (sales.filter("product_code IS NOT NULL").groupBy(*keys, "sale_date")
             .agg(F.sum("quantity_sold").alias("_day")))
    return daily.groupBy(*keys).agg(F.sum("_day").alias("quantity_sold"), F.count("sale_date").alias("sale_days"))


def pareto_analysis(sales: DataFrame, inventory: DataFrame, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Coverage from the rate per selling day, demand gap, and advice by Pareto grade."""
    p = params
    trimmed = F.trim(F.col("product_code")).alias("product_code")
    sales = sales.select(trimmed, "sale_date", "quantity_sold")
    inventory = inventory.withColumn("product_code", F.trim("product_code"))
    in_stock = inventory.select("product_code").distinct()
    grades = pareto_abc(selling_day_rates(sales).join(in_stock, "product_code", "left_semi"))
    rows = (inventory.select("product_code", "branch_code", "product_name", "Last_on_hand")
            .join(grades.drop("cumulative_share"), "product_code", "left"))
    sold, days = F.coalesce("quantity_sold", F.lit(0.0)), F.coalesce("sale_days", F.lit(0))
    rows = rows.withColumns({"quantity_sold": sold, "sale_days": days,
                             "abc_classification": F.coalesce("abc_classification", F.lit("C")),
                             "daily_sales": ratio(sold, days, 0.0)})
    rows = rows.withColumn("coverage_days", F.when(
        F.col("daily_sales") > 0, half_even(F.col("Last_on_hand") / F.col("daily_sales"), 1)).otherwise(999.0))
    gap = F.col("daily_sales") * p.forecast_days - F.col("Last_on_hand")
    stagnant = (F.col("quantity_sold") == 0) & (F.col("Last_on_hand") > 0)
    return rows.filter(~((F.col("quantity_sold") == 0) & (F.col("Last_on_hand") == 0))).select(
        "product_code", "branch_code", "product_name", "Last_on_hand", "quantity_sold", "sale_days", "daily_sales",
        "coverage_days", F.when((gap > 0) & ~stagnant, half_even(gap)).alias("expected_demand"),
        (gap <= 0).alias("Stock_Is_Sufficient"), stagnant.alias("is_stagnant"), "abc_classification",
        S.pareto_advice(F.col("abc_classification"), F.col("coverage_days"), F.col("daily_sales"), p)
        .alias("recommendations"))


# --- reports over analysis rows -------------------------------------------------------------------

REPORT_COLUMNS = ["product_code", "product_name", "item_category1", "item_category2", "branch_code", "Last_on_hand",
                  "Inventory_valueunit", "supplier_name", "supplier_code", "quantity_sold", "sale_days",
                  "daily_sales", "coverage_days", "expected_demand", "is_stagnant", "abc_classification",
                  "recommendations"]


def inventory_report_tables(results: DataFrame, params: AnalysisParams = AnalysisParams()) -> dict[str, DataFrame]:
    """Main, critical and stagnant report tables in fixed column order; order quantities stay blank where
    stock suffices or is stagnant."""
    shown = [c for c in REPORT_COLUMNS if c in results.columns]
    blank = F.col("Stock_Is_Sufficient") | F.col("is_stagnant")
    base = results.withColumn("expected_demand", F.when(~blank, F.col("expected_demand")))
    return {"main": base.filter("quantity_sold > 0").select(*shown),
            "critical": critical_items(base, params.min_coverage).select(*shown),
            "stagnant": stagnant_items(base).select(*shown)}


# Notification texts.
NOTE_TITLE = "تنبيه مخزون"


def notifications(results: DataFrame, safety_stock: float = 0, limit: int = 20) -> DataFrame:
    """The first rows (in result order) that are under the safety stock or run out within seven days."""
    have, cover = F.col("Last_on_hand"), F.coalesce("coverage_days", F.lit(999.0))
    name, branch = F.coalesce("product_name", "product_code"), F.coalesce("branch_code", F.lit("الكل"))
    floor = F.coalesce("safety_stock", F.lit(float(safety_stock))) if "safety_stock" in results.columns \
        else F.lit(float(safety_stock))
    soon = cover < 7
    text = (F.when(have == 0, F.concat(F.lit("نفد المخزون للمنتج "), name, F.lit(" في فرع "), branch))
            .when(soon, F.concat(F.lit("المنتج "), name, F.lit(" سينفد خلال "), cover.cast("bigint"),
                                 F.lit(" أيام في فرع "), branch))
            .otherwise(F.concat(F.lit("المخزون ("), have.cast("bigint"), F.lit(") أقل من حد الأمان للمنتج "),
                                name, F.lit(" في فرع "), branch)))
    return (results.filter((have < floor) | soon)
            .orderBy("priority_score", "coverage_days", "product_code", "branch_code").limit(limit)
            .select(F.concat(F.lit("notif_"), "product_code", F.lit("_"), branch).alias("id"),
                    F.lit(NOTE_TITLE).alias("title"), text.alias("message"),
                    F.when(soon, "warning").otherwise("info").alias("type"),
                    "product_code", branch.alias("branch")))
