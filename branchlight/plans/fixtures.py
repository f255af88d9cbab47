"""The domain tables, derived from the driver's star schema and event tables.

Each DataFrame here has a SQL twin in ``CTES`` so that the oracle starts from the same rows.
Every table is derived from whole input tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

AS_OF = "2024-01-31 00:00:00"
WINDOW = ("1998-01-01", "1998-03-31")

CTES = {
    "sales": """
  SELECT CAST(l_partkey AS VARCHAR) AS product_code, r_name AS branch_code, CAST(l_shipdate AS DATE) AS sale_date,
         l_quantity AS quantity_sold,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    # Returned lines are booked under a separate code that no stock list carries.
    "sales_r": """
  SELECT CASE WHEN l_returnflag = 'R' THEN 'RET-' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS product_code,
         r_name AS branch_code, CAST(l_shipdate AS DATE) AS sale_date, l_quantity AS quantity_sold,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
       JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "sales_w": """
  SELECT * FROM sales WHERE sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'""",
    "inventory": """
  SELECT CAST(p_partkey AS VARCHAR) AS product_code, r_name AS branch_code, p_name AS product_name,
         p_type AS item_category1, p_brand AS item_category2,
         CAST(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE (p_partkey*37 + r_regionkey*211) % 997 - 2 END AS BIGINT) AS Last_on_hand,
         CAST(p_retailprice AS DECIMAL(18,4)) AS inventory_value, s_name AS supplier_name,
         CAST(s_suppkey AS VARCHAR) AS supplier_code
  FROM part CROSS JOIN region CROSS JOIN (SELECT count(*) AS n_supp FROM supplier) ns
       JOIN supplier ON s_suppkey = p_partkey % n_supp""",
    "ops": """
  SELECT event_id AS op_id, CAST(user_id AS VARCHAR) AS username, event_type AS operation, ts AS started,
         ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS finished, value AS duration_s,
         event_type <> 'error' AS success, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size_mb
  FROM events""",
    "uploads": """
  SELECT event_id AS doc_id, CAST(user_id AS VARCHAR) AS username, 'module_' || (event_id % 3) AS module,
         event_type AS branch_name, 'file_' || CAST(json_extract_string(props, '$.k') AS VARCHAR) || '.csv' AS original_filename,
         ts AS upload_timestamp, CAST(json_extract_string(props, '$.k') AS BIGINT) * 1048576 AS file_size
  FROM events""",
    "query_log": """
  SELECT event_id AS query_id, CAST(user_id AS VARCHAR) AS username, ts, value AS duration_s,
         CASE event_type WHEN 'view' THEN 'how much stock of item P' || user_id || ' in branch A'
              WHEN 'error' THEN 'show low stock alert for today'
              WHEN 'click' THEN 'What is the SALES trend of product X' || user_id || ' this month'
              WHEN 'purchase' THEN 'forecast of demand for branch B ' || user_id || ' and 12 units'
              WHEN 'signup' THEN 'Where can I find item Z9 at branch north ' || user_id
              ELSE 'hello there' END AS query
  FROM events""",
}


# The driver's table schemas; stated so that planning a query opens no file footers.
TABLE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _read(spark, sf_dir, name)


#: Line items that a task joins with their orders, and parts that a task unfolds over the regions, at most about: what such
#: a task sorts and groups stays in proportion to them, however large the table.
LINES_EACH, PARTS_EACH = 500_000, 50_000


def _tasks(table: DataFrame, each: int) -> int:
    """Tasks for ``each`` rows apiece; the rows are counted from the file footers."""
    return math.ceil(table.count() / each)


def sales(spark: SparkSession, sf_dir: str, returns_coded: bool = False) -> DataFrame:
    line, orders = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    # The branch is resolved on the order side, so the line items are shuffled once, by order.
    place = (_read(spark, sf_dir, "customer")
             .join(_read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
             .join(_read(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
             .select("c_custkey", "r_name"))
    placed = orders.join(place, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "r_name")
    # Adaptive execution sizes tasks by compressed bytes, of which a line has few; up to a task per core it deals well.
    tasks = _tasks(line, LINES_EACH)
    if tasks > spark.sparkContext.defaultParallelism:
        line, placed = line.repartition(tasks, "l_orderkey"), placed.repartition(tasks, "o_orderkey")
    price, cut = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)")
    code = F.col("l_partkey").cast("string")
    if returns_coded:
        code = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("RET-"), code)).otherwise(code)
    return (line.join(placed, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(code.alias("product_code"), F.col("r_name").alias("branch_code"),
                    F.to_date("l_shipdate").alias("sale_date"), F.col("l_quantity").alias("quantity_sold"),
                    (price * (F.lit(1).cast("decimal(1,0)") - cut)).cast(schemas.MONEY).alias("revenue"),
                    (price * cut).cast(schemas.MONEY).alias("discount")))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and region: a part row is unfolded over the regions' places and joined with the region at each.

    Few bytes of the file make many rows, so parts are dealt out by their number before they unfold."""
    part, supplier = _read(spark, sf_dir, "part"), _read(spark, sf_dir, "supplier")
    region = _read(spark, sf_dir, "region")
    # One row per region.
    placed = region.withColumn("_place", F.row_number().over(Window.orderBy("r_regionkey")))
    count = F.count(F.lit(1))
    places = F.sequence(F.lit(1), region.agg(count.cast("int")).scalar())
    parts = (part.withColumn("_supp", F.col("p_partkey") % supplier.agg(count).scalar())
             .join(supplier, F.col("s_suppkey") == F.col("_supp")))
    tasks = _tasks(part, PARTS_EACH)
    if tasks > 1:
        parts = parts.repartition(tasks, "p_partkey")
    grid = parts.withColumn("_at", F.explode(places)).join(placed, F.col("_place") == F.col("_at"))
    key = F.col("p_partkey")
    stock = F.when(key % 10 == 0, F.lit(0)).otherwise((key * 37 + F.col("r_regionkey") * 211) % 997 - 2)
    return (grid.select(key.cast("string").alias("product_code"), F.col("r_name").alias("branch_code"),
                    F.col("p_name").alias("product_name"), F.col("p_type").alias("item_category1"),
                    F.col("p_brand").alias("item_category2"), stock.cast("bigint").alias("Last_on_hand"),
                    F.col("p_retailprice").cast(schemas.MONEY).alias("inventory_value"),
                    F.col("s_name").alias("supplier_name"), F.col("s_suppkey").cast("string").alias("supplier_code")))


def _k(kind: str = "bigint") -> Column:
    return F.get_json_object("props", "$.k").cast(kind)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("op_id"), F.col("user_id").cast("string").alias("username"),
        F.col("event_type").alias("operation"), F.col("ts").alias("started"),
        F.expr("ts + make_dt_interval(0, 0, 0, cast(value as decimal(18,6)))").alias("finished"),
        F.col("value").alias("duration_s"), (F.col("event_type") != "error").alias("success"),
        _k().alias("size_mb"))


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("user_id").cast("string").alias("username"),
        F.concat(F.lit("module_"), F.col("event_id") % 3).alias("module"),
        F.col("event_type").alias("branch_name"),
        F.concat(F.lit("file_"), F.get_json_object("props", "$.k"), F.lit(".csv")).alias("original_filename"),
        F.col("ts").alias("upload_timestamp"), (_k() * 1048576).alias("file_size"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    kind = F.col("event_type")
    phrase = (F.when(kind == "view", F.concat(F.lit("how much stock of item P"), user, F.lit(" in branch A")))
              .when(kind == "error", F.lit("show low stock alert for today"))
              .when(kind == "click", F.concat(F.lit("What is the SALES trend of product X"), user,
                                              F.lit(" this month")))
              .when(kind == "purchase", F.concat(F.lit("forecast of demand for branch B "), user,
                                                 F.lit(" and 12 units")))
              .when(kind == "signup", F.concat(F.lit("Where can I find item Z9 at branch north "), user))
              .otherwise("hello there"))
    return _read(spark, sf_dir, "events").select(
        F.col("event_id").alias("query_id"), user.alias("username"), "ts", F.col("value").alias("duration_s"),
        phrase.alias("query"))


_NEEDS = {"sales_w": ("sales",)}


def with_ctes(names: str, body: str) -> str:
    """``WITH`` the named fixture tables; ``body`` may open with further CTEs written as ``, x AS (...)``."""
    wanted: list[str] = []
    for name in names.split():
        for n in (*_NEEDS.get(name, ()), name):
            if n not in wanted:
                wanted.append(n)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}{body if body.startswith(',') else chr(10) + body}"
