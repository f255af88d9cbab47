"""Reading branch uploads, snapshots, calendars, logs and forecast exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.oplog import parse_jsonl, parse_text_log
from ..operators.versions import branch_scan
from ..schemas import EVENTS_CALENDAR_SCHEMA, UPLOAD_LOG_SCHEMA


def read_branch_uploads(spark: SparkSession, root: str, fmt: str, schema: T.StructType | None = None) -> DataFrame:
    """All branch files under ``root`` as one table. The branch is the ``branch_code=`` folder or, without one,
    the name of the folder a file lies in."""
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported upload format {fmt!r}; use csv, parquet or json")
    # A recursive listing finds the files of either folder style; the branch comes from their path.
    reader = spark.read.option("recursiveFileLookup", "true")
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    if schema is not None:
        reader = reader.schema(T.StructType([f for f in schema.fields if f.name != "branch_code"]))
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    named = F.regexp_extract(F.col("_metadata.file_path"), r"/branch_code=([^/]+)/", 1)
    # Folder names are escaped in paths.
    code = F.url_decode(F.replace(F.when(named != "", named).otherwise(folder), F.lit("+"), F.lit("%2B")))
    return reader.format(fmt).load(root).withColumn("branch_code", code)


SNAPSHOT_PARTITIONS = ["module", "data_type", "branch_code", "snapshot_ts"]


def write_snapshot(df: DataFrame, root: str, module: str, data_type: str, snapshot_ts: str,
                   branch: str | None = None) -> None:
    """Add one version of a table. Rows keep their own branch unless ``branch`` names one for all."""
    code: Column = F.col("branch_code") if branch is None else F.lit(branch)
    stamped = df.withColumns({"module": F.lit(module), "data_type": F.lit(data_type), "branch_code": code,
                              "snapshot_ts": F.lit(snapshot_ts)})
    (stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*SNAPSHOT_PARTITIONS).parquet(root))


def read_snapshot(spark: SparkSession, root: str, module: str, data_type: str, branch: str | None = None,
                  latest_only: bool = True) -> DataFrame:
    """Rows of a stored table; module, type and branch are partition filters, so other folders are not read."""
    rows = spark.read.parquet(root).filter((F.col("module") == module) & (F.col("data_type") == data_type))
    return branch_scan(rows, branch, latest_only)


def read_events_calendar(spark: SparkSession, path: str | None) -> DataFrame:
    """Special events in listing order. Without a file the calendar is empty; other formats are refused."""
    shape = "event_order long, event_name string, start_date date, end_date date"
    if path is None or not _exists(spark, path):
        return spark.createDataFrame([], shape)
    if not path.lower().endswith(".csv"):
        raise ValueError("unsupported event file format, use .csv")
    rows = spark.read.option("header", True).option("multiLine", False).schema(EVENTS_CALENDAR_SCHEMA).csv(path)
    return rows.select(F.monotonically_increasing_id().alias("event_order"), "event_name",
                       F.try_to_date("start_date").alias("start_date"), F.try_to_date("end_date").alias("end_date"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def read_jsonl_log(spark: SparkSession, path: str, as_of: str | None = None, hours: int | None = None,
                   schema: T.StructType = UPLOAD_LOG_SCHEMA) -> DataFrame:
    return parse_jsonl(spark.read.text(path), as_of, hours, schema=schema)


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_text_log(spark.read.text(path))


# Headers of the forecast export.
FORECAST_HEADERS = {
    "كود الصنف": "product_code", "اسم الصنف": "product_name", "تاريخ البيع": "sale_date",
    "الكمية المباعة": "quantity_sold", "الكمية المتوقعة": "predicted_quantity_sold", "السعر": "price",
    "إجمالي الإيراد": "total_revenue", "متوسط البيع اليومي": "avg_daily_sales", "معدل النمو": "growth_rate",
    "الملاحظات": "notes", "المناسبة الخاصة": "special_event_name", "القسم": "item_category1",
    "القسم الفرعي": "item_category2", "اسم المورد": "supplier_name", "كود المورد": "supplier_code"}


def read_forecast_export(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Standard names for a forecast export, split into past rows and future rows."""
    rows = df.withColumnsRenamed({k: v for k, v in FORECAST_HEADERS.items() if k in df.columns})
    rows = rows.withColumn("sale_date", F.col("sale_date").try_cast("date"))
    past = F.col("quantity_sold").isNotNull()
    return rows.filter(past), rows.filter(~past & F.col("predicted_quantity_sold").isNotNull())
