"""Writing report tables as CSV, JSON and partitioned sheets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import json_safe

# Report headers.
ARABIC_HEADERS = {
    "product_code": "كود الصنف", "product_name": "اسم الصنف", "Last_on_hand": "المخزون الحالي",
    "quantity_sold": "الكمية المباعة", "daily_sales": "المبيعات اليومية", "coverage_days": "أيام التغطية",
    "expected_demand": "الطلب المتوقع", "Stock_Is_Sufficient": "كفاية المخزون", "abc_classification": "تصنيف ABC",
    "recommendations": "التوصيات", "item_category1": "القسم", "item_category2": "القسم الفرعي",
    "supplier_name": "اسم المورد", "supplier_code": "كود المورد", "branch_code": "الفرع",
    "Inventory_valueunit": "قيمة المخزون للوحدة", "sale_days": "عدد أيام البيع", "is_stagnant": "راكد",
    "source_branch": "الفرع المصدر", "destination_branch": "الفرع المستلم", "transfer_quantity": "كمية التحويل",
    "reason": "سبب التحويل", "forecast_quantity": "الكمية المتوقعة", "confidence": "درجة الثقة",
    "confidence_lower": "الحد الأدنى للثقة", "confidence_upper": "الحد الأقصى للثقة", "trend": "الاتجاه",
    "seasonality": "الموسمية", "month": "الشهر", "revenue": "المبيعات"}
BYTE_ORDER_MARK = "﻿"


def localized(df: DataFrame, headers: Mapping[str, str] = ARABIC_HEADERS) -> DataFrame:
    return df.withColumnsRenamed({c: headers[c] for c in df.columns if c in headers})


def write_report_csv(df: DataFrame, path: str, headers: Mapping[str, str] = ARABIC_HEADERS) -> None:
    """CSV part files with localized headers and empty cells for nulls. Each file opens with a byte order mark
    (as part of its first header), so spreadsheet programs read it as UTF-8."""
    out = localized(df, headers)
    out = out.withColumnRenamed(out.columns[0], BYTE_ORDER_MARK + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_report_json(df: DataFrame, path: str, user: str, operation: str, exported_at: str) -> None:
    """Records as JSON lines under ``records`` and one metadata row beside them."""
    safe = json_safe(df)
    safe.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/records")
    meta = df.agg(F.count(F.lit(1)).alias("total_records")).select(
        F.lit(exported_at).alias("export_date"), F.lit(user).alias("user"), F.lit(operation).alias("operation"),
        "total_records", F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
    meta.write.mode("overwrite").json(f"{path}/metadata")


def write_report_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Each named table as its own ``report=`` folder, empty ones left out by Spark as empty folders."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/report={name}")
