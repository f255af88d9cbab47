"""The inactive-item filter and the repair of sales without stock rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even, number_or_zero
from ..session import staged


def _sold(sales: DataFrame) -> Column:
    """Whether a row shows activity; compacted sales carry the highest single quantity as ``top_sale``."""
    for name in ("top_sale", "quantity_sold"):
        if name in sales.columns:
            return number_or_zero(F.col(name)) > 0
    return F.lit(len(sales.columns) > 1)


def inactive_products(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Products whose highest stock over all branches is exactly 0 and that were never sold."""
    top = (inventory.filter("product_code IS NOT NULL").groupBy("product_code")
           .agg(F.max(number_or_zero(F.col("Last_on_hand"))).alias("_top")).filter("_top = 0"))
    sold = sales.filter(_sold(sales)).select("product_code").distinct()
    return top.join(sold, "product_code", "left_anti").select("product_code")


def top_stock() -> Column:
    """A product's highest stock over all branches, beside each of its rows. Rows without a product are spread."""
    product = F.coalesce("product_code", F.concat(F.lit("\0"), F.spark_partition_id()))
    return F.max(number_or_zero(F.col("Last_on_hand"))).over(Window.partitionBy(product))


def drop_inactive_inventory(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Stock rows of active products. With no sales at all nothing is dropped.

    Sales are brought to one row per product, which is written: both the test of each product and that of "any sales" read it."""
    products = staged(sales.groupBy("product_code").agg(F.max(_sold(sales)).alias("_sold")))
    sold = products.filter("_sold").select("product_code", "_sold")
    return (inventory.withColumn("_top", top_stock()).join(sold, "product_code", "left")
            .filter(F.col("product_code").isNull() | (F.col("_top") != 0) | F.col("_sold").isNotNull() | ~products.exists())
            .select(*inventory.columns))


def drop_inactive_sales(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sales rows of active products that have a stock row; an empty inventory drops nothing.

    Stock is brought to one row per product, which is written and read by both tests."""
    top = staged(inventory.groupBy("product_code").agg(F.max(number_or_zero(F.col("Last_on_hand"))).alias("_top")))
    sold = sales.filter(_sold(sales)).select("product_code").distinct().withColumn("_sold", F.lit(True))
    active = (top.filter("product_code IS NOT NULL").join(sold, "product_code", "left")
              .filter("_top <> 0 OR _sold").select("product_code").withColumn("_ok", F.lit(True)))
    return (sales.join(active, "product_code", "left")
            .filter(F.col("_ok").isNotNull() | ~top.exists())
            .select(*sales.columns))


def stock_by_product(inventory: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per product: its highest stock (``_top``), and a map from branch to the smallest of the branch's rows (``_items``).

    Rows of one pair collapse first, so a product's group holds one entry per branch."""
    pairs = inventory.groupBy("product_code", "branch_code").agg(
        F.max(number_or_zero(F.col("Last_on_hand"))).alias("_top"), F.min(F.struct(*columns)).alias("_item"))
    entry = F.when(F.col("branch_code").isNotNull(), F.struct("branch_code", "_item"))
    return pairs.groupBy("product_code").agg(
        F.max("_top").alias("_top"), F.map_from_entries(F.collect_list(entry)).alias("_items"))


def active_days(daily: DataFrame, inventory: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rule of ``drop_inactive_sales`` on rows at day grain, with the stock ``columns`` of each row's (product, branch).

    Both follow the product, so one shuffle serves them: whether a product was sold is a window over its days, which are
    bounded by the calendar and its branches, and the attributes come with its stock row."""
    stock = staged(stock_by_product(inventory, columns))
    days = daily.withColumn("_sold", F.max(_sold(daily)).over(Window.partitionBy("product_code")))
    rows = days.join(stock.withColumn("_listed", F.lit(True)), "product_code", "left").withColumn(
        "_item", F.try_element_at("_items", F.col("branch_code")))
    return (rows.filter((F.col("_listed") & ((F.col("_top") != 0) | F.col("_sold"))) | ~stock.exists())
            .select("product_code", "branch_code", *[c for c in daily.columns if c not in ("product_code", "branch_code")],
                    *[F.col("_item")[c].alias(c) for c in columns]))


def drop_inactive(sales: DataFrame, inventory: DataFrame) -> tuple[DataFrame, DataFrame]:
    return drop_inactive_sales(sales, inventory), drop_inactive_inventory(sales, inventory)


def drop_orphan_sales(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Sales whose product is in the inventory; stock without sales is left alone."""
    return sales.join(inventory.select("product_code").distinct(), "product_code", "left_semi") \
        .select(*sales.columns)


def _per_product(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row per product of either table with its row counts and activity, from one pass over each."""
    s = (sales.filter("product_code IS NOT NULL").groupBy("product_code")
         .agg(F.count(F.lit(1)).alias("s_rows"), F.count_if(_sold(sales)).alias("s_sold")))
    stock = number_or_zero(F.col("Last_on_hand"))
    i = (inventory.filter("product_code IS NOT NULL").groupBy("product_code")
         .agg(F.count(F.lit(1)).alias("i_rows"), F.max(stock).alias("top"),
              F.count_if(stock > 0).alias("i_stocked")))
    both = s.join(i, "product_code", "full")
    return (both.withColumn("idle", F.coalesce((F.col("top") == 0) & (F.coalesce("s_sold", F.lit(0)) == 0),
                                               F.lit(False))))


def activity_filter_stats(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """What the inactive filter removed, whether the tables still fit together, and how to report it."""
    kept_i, kept_s = ~F.col("idle") & F.col("i_rows").isNotNull(), ~F.col("idle") & F.col("s_rows").isNotNull()
    zero = F.lit(0).cast("bigint")
    one = _per_product(sales, inventory).agg(
        F.count_if("idle").alias("items_filtered"),
        F.coalesce(F.sum("i_rows"), zero).alias("total_items_before"),
        F.coalesce(F.sum(F.when(kept_i, F.col("i_rows"))), zero).alias("total_items_after"),
        F.coalesce(F.sum("s_rows"), zero).alias("sales_records_before"),
        F.coalesce(F.sum(F.when(kept_s & F.col("i_rows").isNotNull(), F.col("s_rows"))), zero)
        .alias("sales_records_after"),
        F.count_if(F.col("idle") & (F.col("i_stocked") > 0)).alias("_lost_stock"),
        F.count_if(kept_s & F.col("i_rows").isNull()).alias("orphan_products"))
    share = F.when(F.col("total_items_before") > 0,
                   F.col("items_filtered") / F.col("total_items_before") * 100).otherwise(0.0)
    return one.withColumns({
        "filtering_percentage": half_even(share, 2),
        "integrity_valid": F.col("_lost_stock") == 0,
        "referential_valid_before_repair": F.col("orphan_products") == 0,
        "severity": F.when(F.col("_lost_stock") > 0, "ERROR")
        .when(F.col("orphan_products") > 0, "WARNING")
        .when(share > 20, "INFO_SIGNIFICANT")
        .when(F.col("items_filtered") > 0, "INFO").otherwise("DEBUG"),
    }).drop("_lost_stock")


def referential_diff(sales_before: DataFrame, inventory_before: DataFrame, sales_after: DataFrame,
                     inventory_after: DataFrame) -> DataFrame:
    """Product sets that differ between the tables and between before and after filtering, one tagged row each.

    One aggregate over the four tagged product lists replaces six set operations."""
    tags = [(sales_before, 1), (inventory_before, 2), (sales_after, 4), (inventory_after, 8)]
    marked = None
    for df, bit in tags:
        part = df.select("product_code").filter("product_code IS NOT NULL").distinct() \
            .withColumn("_bit", F.lit(bit))
        marked = part if marked is None else marked.unionAll(part)
    seen = marked.groupBy("product_code").agg(F.bit_or("_bit").alias("_in"))

    def has(bit: int) -> Column:
        return F.col("_in").bitwiseAND(bit) != 0

    kinds = [("orphaned_sales", has(4) & ~has(8)), ("inventory_without_sales", has(8) & ~has(4)),
             ("removed_sales_product", has(1) & ~has(4)), ("removed_inventory_product", has(2) & ~has(8)),
             ("filtered_from_inventory_only", has(2) & ~has(8) & has(4))]
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda k: k.isNotNull())
    return seen.select("product_code", F.explode(found).alias("difference"))
