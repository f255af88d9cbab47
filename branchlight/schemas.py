"""Fixed schemas of the tables the operators exchange."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SALES_SCHEMA = _schema(
    ("product_code", T.StringType()), ("branch_code", T.StringType()), ("sale_date", T.DateType()),
    ("quantity_sold", T.DoubleType()), ("revenue", MONEY), ("discount", MONEY))

INVENTORY_SCHEMA = _schema(
    ("product_code", T.StringType()), ("branch_code", T.StringType()), ("product_name", T.StringType()),
    ("item_category1", T.StringType()), ("item_category2", T.StringType()), ("Last_on_hand", T.LongType()),
    ("inventory_value", MONEY), ("supplier_name", T.StringType()), ("supplier_code", T.StringType()))

EVENTS_CALENDAR_SCHEMA = _schema(
    ("event_name", T.StringType()), ("start_date", T.StringType()), ("end_date", T.StringType()))

UPLOAD_LOG_SCHEMA = _schema(
    ("timestamp", T.StringType()), ("level", T.StringType()), ("logger", T.StringType()),
    ("message", T.StringType()), ("event", T.StringType()), ("username", T.StringType()),
    ("branch_name", T.StringType()), ("filename", T.StringType()), ("file_size_mb", T.DoubleType()),
    ("processing_time_ms", T.DoubleType()), ("query_time_ms", T.DoubleType()),
    ("transaction_time_ms", T.DoubleType()), ("records_processed", T.LongType()),
    ("error_type", T.StringType()), ("_corrupt_record", T.StringType()))

ALERT_SCHEMA = _schema(
    ("product_code", T.StringType()), ("product_name", T.StringType()), ("branch_code", T.StringType()),
    ("current_stock", T.LongType()), ("alert_status", T.StringType()), ("status_class", T.StringType()),
    ("priority", T.IntegerType()), ("last_updated", T.TimestampNTZType()))

# Columns a table must have for the analysis to accept it (F6).
REQUIRED_COLUMNS = {
    "sales": {"branch_code": "string", "product_code": "string", "sale_date": "date",
              "quantity_sold": "double", "price": "double"},
    "inventory": {"product_code": "string", "product_name": "string", "Last_on_hand": "double"},
    "forecast": {"date": "date", "product_code": "string", "quantity_sold": "double"},
}
