"""Row-level joins of sales with stock attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import clean_inventory, clean_sales, filter_dates, one_per_pair, with_price

ITEM_COLUMNS = ("product_name", "item_category1", "item_category2", "Last_on_hand")


def unified_sales(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Cleaned sales joined to their cleaned stock row, with unit price; unreadable dates dropped."""
    joined = clean_sales(sales).join(clean_inventory(inventory), ["product_code", "branch_code"])
    return filter_dates(with_price(joined))


def sales_with_item_info(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every sales row with the attributes of its stock row where there is one, and a discount of 0 where none is given."""
    attrs = one_per_pair(inventory.select(
        "product_code", "branch_code", *[c for c in ITEM_COLUMNS if c in inventory.columns]))
    discount = F.coalesce("discount", F.lit(0)) if "discount" in sales.columns else F.lit(0)
    return with_price(sales.withColumn("discount", discount.cast("decimal(18,4)")), positive_only=True) \
        .join(attrs, ["product_code", "branch_code"], "left")
