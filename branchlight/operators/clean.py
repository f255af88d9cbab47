"""Column standardising, cleaning and row filters on sales and inventory tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import number_or_zero, ratio
from ..schemas import REQUIRED_COLUMNS

# Accepted spellings per standard column, per table role (T9: the roles do not share "quantity").
_SHARED = {
    "product_code": ["كود_الصنف", "product_code", "item_code"],
    "branch_code": ["الفرع", "branch_code", "location", "branch"],
    "product_name": ["اسم_الصنف", "product_name", "item_name", "item_description"],
    "item_category1": ["item_category1", "category1", "القسم"],
    "item_category2": ["item_category2", "category2", "القسم_الفرعي"],
    "supplier_name": ["supplier_name"],
    "supplier_code": ["supplier_code"],
}
SYNONYMS = {
    "sales": {
        **_SHARED,
        "sale_date": ["تاريخ", "sale_date", "date"],
        "quantity_sold": ["الكمية_المباعة", "quantity_sold", "quantity"],
        "revenue": ["إجمالي_الإيراد", "revenue", "total_revenue", "transaction_revenue", "sales_amount", "amount",
                    "total_amount", "total_price"],
        "discount": ["قيمة_الخصم", "discount", "promo"],
    },
    "inventory": {
        **_SHARED,
        "Last_on_hand": ["المخزون_الحالي", "current_stock", "stock", "last_on_hand", "qty", "quantity", "on_hand",
                         "count", "inventory_count", "balance", "stock_balance"],
        "inventory_value": ["inventory_value", "inventory_valueunit", "cost", "average_cost", "unit_cost",
                            "cost_price", "price", "purchase_price", "buying_price", "cost_per_unit", "unit_value",
                            "value", "item_cost"],
    },
}
NUMERIC_COLUMNS = ("Last_on_hand", "quantity_sold", "inventory_value", "revenue", "discount")


def clean_name(name: str) -> str:
    return re.sub(r"[^\w_]", "", re.sub(r"\s+", "_", name.strip()))


def standardize(df: DataFrame, role: str) -> DataFrame:
    """Standard column names for the role, and numbers in the five numeric columns (unreadable -> 0)."""
    known = {spelling: standard for standard, spellings in SYNONYMS[role].items() for spelling in spellings}
    cleaned = [clean_name(c) for c in df.columns]
    names = [known.get(c.lower(), c) for c in cleaned]
    taken: set[str] = set()
    final = []
    for clean, name in zip(cleaned, names):
        keep = name if name not in taken else clean
        taken.add(keep)
        final.append(keep)
    out = df.toDF(*final)
    return out.withColumns({c: number_or_zero(F.col(c)) for c in NUMERIC_COLUMNS if c in out.columns})


def filter_dates(df: DataFrame, start: str | None = None, end: str | None = None,
                 column: str = "sale_date") -> DataFrame:
    """Keep readable dates inside the closed range; a DATE column is compared as it is so the range
    reaches the file scan."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn(column, F.try_to_date(F.col(column)))
    elif not isinstance(kind, T.DateType):
        df = df.withColumn(column, F.col(column).cast("date"))
    keep = F.col(column).isNotNull()
    if start:
        keep &= F.col(column) >= F.lit(start).cast("date")
    if end:
        keep &= F.col(column) <= F.lit(end).cast("date")
    return df.filter(keep)


def filter_branch(df: DataFrame, branch: str | None, column: str = "branch_code") -> DataFrame:
    return df if branch in (None, "", "all") else df.filter(F.col(column) == branch)


def filter_inventory(df: DataFrame, search: str | None = None, min_stock: float | None = None,
                     max_stock: float | None = None, category: str | None = None, status: str | None = None,
                     min_coverage: float = 7, columns: Sequence[str] | None = None,
                     regex: bool = False) -> DataFrame:
    """Search and status filters over analysis or inventory rows."""
    if search:
        term = search.lower()

        def hit(name: str) -> Column:
            text = F.lower(F.col(name))
            return F.coalesce(text.rlike(term) if regex else F.contains(text, F.lit(term)), F.lit(False))

        df = df.filter(hit("product_code") | hit("product_name") | hit("item_category1"))
    if min_stock is not None:
        df = df.filter(F.col("Last_on_hand") >= min_stock)
    if max_stock is not None:
        df = df.filter(F.col("Last_on_hand") <= max_stock)
    if category and category != "all":
        df = df.filter(F.col("item_category1") == category)
    if status == "low_stock" and "coverage_days" in df.columns:
        df = df.filter(F.col("coverage_days") < min_coverage)
    elif status == "stagnant" and "is_stagnant" in df.columns:
        df = df.filter("is_stagnant")
    elif status == "available":
        if "coverage_days" in df.columns:
            df = df.filter(F.col("coverage_days") >= min_coverage)
        if "is_stagnant" in df.columns:
            df = df.filter("NOT is_stagnant")
    known = [c for c in (columns or []) if c in df.columns]
    return df.select(*known) if known else df


def clean_sales(sales: DataFrame) -> DataFrame:
    """Complete rows with a positive quantity, each once."""
    return (sales.dropna(subset=["product_code", "branch_code", "sale_date", "quantity_sold"])
            .filter(F.col("quantity_sold") > 0).distinct())


def one_per_pair(inventory: DataFrame) -> DataFrame:
    """One row per (product, branch): the smallest row in column order.

    Taken with an aggregate, so repeated rows of one pair collapse before the shuffle."""
    rest = [c for c in inventory.columns if c not in ("product_code", "branch_code")]
    return (inventory.groupBy("product_code", "branch_code").agg(F.min(F.struct(*rest)).alias("_r"))
            .select("product_code", "branch_code", *[F.col(f"_r.{c}").alias(c) for c in rest])
            .select(*inventory.columns))


def clean_inventory(inventory: DataFrame) -> DataFrame:
    """Complete rows with positive stock, one per (product, branch)."""
    return one_per_pair(inventory.dropna(subset=["product_code", "branch_code", "Last_on_hand"])
                        .filter(F.col("Last_on_hand") > 0))


def with_price(df: DataFrame, positive_only: bool = False) -> DataFrame:
    """Unit price; 0 where nothing (or, with ``positive_only``, not a positive amount) was sold."""
    price = ratio(F.col("revenue"), F.col("quantity_sold"), 0.0)
    if positive_only:
        price = F.when(F.col("quantity_sold") > 0, price).otherwise(0.0)
    return df.withColumn("price", price)


def check_table(df: DataFrame, role: str) -> DataFrame:
    """One row per required column: is it there, how many nulls, how many values do not fit its type."""
    required = REQUIRED_COLUMNS[role]

    def unreadable(name: str, kind: str) -> Column:
        c = F.col(name)
        is_text = isinstance(df.schema[name].dataType, T.StringType)
        if kind == "string" or not is_text:
            return F.lit(0).cast("bigint")
        parsed = F.try_to_date(c) if kind == "date" else c.try_cast(kind)
        return F.count_if(c.isNotNull() & parsed.isNull())

    present = [n for n in required if n in df.columns]
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in present],
        *[unreadable(n, required[n]).alias(f"bad_{n}") for n in present])
    none = F.lit(None).cast("bigint")
    cells = [F.struct(F.lit(n).alias("column_name"), F.lit(n in present).alias("is_present"),
                      (F.col(f"null_{n}") if n in present else none).alias("null_count"),
                      (F.col(f"bad_{n}") if n in present else none).alias("unreadable_count"),
                      F.col("n").alias("row_count")) for n in required]
    return counts.select(F.inline(F.array(*cells)))


def missing_columns(df: DataFrame, needed: Sequence[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def json_safe(df: DataFrame) -> DataFrame:
    """NaN -> null, dates and timestamps -> ISO text, ready for JSON output."""
    out = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out[field.name] = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
        elif isinstance(field.dataType, T.DateType):
            out[field.name] = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            out[field.name] = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.withColumns(out) if out else df
