"""Summaries, findings and reduced exports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..operators import clean, reports as rp
from . import fixtures as fx
from .fixtures import with_ctes
from .registry import he, money, register


@register("category_summary", with_ctes("inventory", f"""
SELECT item_category1, count(product_code) AS products, CAST(sum(Last_on_hand) AS BIGINT) AS total_stock, {money('sum(inventory_value)')} AS total_value
FROM inventory GROUP BY 1"""))
def _(spark, d):
    return rp.category_summary(fx.inventory(spark, d))


_NUM = ("quantity_sold", "revenue", "discount")


@register("numeric_summary", with_ctes("sales", " UNION ALL ".join(f"""
SELECT '{c}' AS column_name, {he(f'CAST(sum({c}) AS DOUBLE)', 4)} AS total, {he(f'CAST(sum({c}) AS DOUBLE) / count({c})', 4)} AS mean,
  CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, count({c}) AS values FROM sales""" for c in _NUM)))
def _(spark, d):
    return rp.numeric_summary(fx.sales(spark, d)).withColumns({c: half_even(F.col(c), 4) for c in ("total", "mean")})


@register("stock_levels", with_ctes("inventory", """
SELECT count(*) AS total_products, count(*) FILTER (Last_on_hand < 10) AS low_stock_items, count(*) FILTER (Last_on_hand = 0) AS out_of_stock_items,
  CAST(sum(Last_on_hand) AS BIGINT) AS total_stock_value FROM inventory"""))
def _(spark, d):
    return rp.stock_levels(fx.inventory(spark, d))


@register("sales_totals", with_ctes("sales", f"""
SELECT {money('sum(revenue)')} AS total_revenue, {he('CAST(sum(revenue) AS DOUBLE) / count(revenue)', 4)} AS average_transaction, count(*) AS transaction_count FROM sales"""))
def _(spark, d):
    return rp.sales_totals(fx.sales(spark, d))


@register("branch_list", with_ctes("inventory", """
SELECT branch_code, count(*) OVER () AS branch_count FROM (SELECT DISTINCT branch_code FROM inventory)"""))
def _(spark, d):
    return rp.branch_list(fx.inventory(spark, d))


def _metrics_sql(keys: str) -> str:
    """Figures per group; supplier names are missing on part of the stock rows of two branches."""
    k, on = (f"{keys},", f"USING ({keys})") if keys else ("", "ON true")
    by = f"GROUP BY {keys}" if keys else ""
    return f""", inv2 AS (SELECT * REPLACE (CASE WHEN branch_code IN ('ASIA', 'EUROPE') AND Last_on_hand < 500 THEN NULL ELSE supplier_name END AS supplier_name,
     CASE WHEN branch_code = 'ASIA' THEN NULL ELSE item_category2 END AS item_category2) FROM inventory),
s AS (SELECT {k} count(*) AS transaction_count, sum(revenue) AS rev FROM sales {by}),
i AS (SELECT {k} count(*) AS total_products, count(*) FILTER (Last_on_hand < 10) AS low_stock_items,
   count(*) FILTER (Last_on_hand = 0) AS out_of_stock_items,
   sum(CASE WHEN supplier_name IS NULL THEN 1 ELSE 0 END + CASE WHEN item_category2 IS NULL THEN 1 ELSE 0 END) / (count(*) * 9) AS gaps FROM inv2 {by}),
m AS (SELECT {k} transaction_count, {money('rev')} AS total_revenue, {he('CAST(rev AS DOUBLE) / transaction_count', 4)} AS avg_transaction,
   total_products, low_stock_items, out_of_stock_items, CAST(100 - trunc(gaps * 30) AS INTEGER) AS data_quality_score FROM s JOIN i {on})"""


def _gappy(spark, d):
    branch = F.col("branch_code")
    return fx.inventory(spark, d).withColumns({
        "supplier_name": F.when(~(branch.isin("ASIA", "EUROPE") & (F.col("Last_on_hand") < 500)), F.col("supplier_name")),
        "item_category2": F.when(branch != "ASIA", F.col("item_category2"))})


def metrics(spark, d):
    s, i = fx.sales(spark, d), _gappy(spark, d)
    return rp.report_metrics(s, i, ["branch_code"]).join(rp.data_quality_score(s, i, ["branch_code"]), "branch_code")


_FIGURES = "transaction_count, total_revenue, avg_transaction, total_products, low_stock_items, out_of_stock_items"


@register("report_metrics", with_ctes("sales inventory", _metrics_sql("") + f"SELECT {_FIGURES} FROM m"))
def _(spark, d):
    return rp.report_metrics(fx.sales(spark, d), _gappy(spark, d))


@register("data_quality_score", with_ctes("sales inventory", _metrics_sql("branch_code") + "SELECT branch_code, data_quality_score FROM m"))
def _(spark, d):
    return rp.data_quality_score(fx.sales(spark, d), _gappy(spark, d), ["branch_code"])


@register("report_findings", with_ctes("sales inventory", _metrics_sql("branch_code") + f"""
, f AS (SELECT *, list_filter([CASE WHEN low_stock_items > 0 THEN '{rp.INSIGHT_RESTOCK[0]}' || low_stock_items || '{rp.INSIGHT_RESTOCK[1]}' END,
    CASE WHEN total_revenue > 10000 THEN '{rp.INSIGHT_REVENUE}' END], lambda t: t IS NOT NULL) AS ins,
  list_filter([CASE WHEN out_of_stock_items > 0 THEN '{rp.RISK_OUT}' END, CASE WHEN low_stock_items > total_products * 0.3 THEN '{rp.RISK_LOW}' END], lambda t: t IS NOT NULL) AS rk FROM m)
SELECT branch_code, array_to_string(ins, ' | ') AS insights,
  CASE WHEN low_stock_items / total_products > 0.2 THEN '{rp.PATTERN_HIGH_LOW}' WHEN low_stock_items / total_products < 0.05 THEN '{rp.PATTERN_HEALTHY}' ELSE '' END AS patterns,
  CASE WHEN low_stock_items > 0 THEN '{rp.RECOMMEND_RESTOCK[0]}' || low_stock_items || '{rp.RECOMMEND_RESTOCK[1]} | ' ELSE '' END || '{rp.RECOMMEND_PEAK}' AS recommendations,
  CASE WHEN len(rk) = 0 THEN '{rp.RISK_NONE}' ELSE '{rp.RISK_PREFIX}' || array_to_string(rk, ', ') END AS risk_assessment,
  CAST(trunc(least(greatest(75.0::DOUBLE + (data_quality_score - 50) * 0.3::DOUBLE + CASE WHEN len(ins) >= 3 THEN 10 ELSE 0 END, 0), 100)) AS INTEGER) AS confidence_score FROM f"""))
def _(spark, d):
    return rp.report_findings(metrics(spark, d), "peak").select(
        "branch_code", "insights", "patterns", "recommendations", "risk_assessment", "confidence_score")


_A, _B = rp.SUMMARY_STOCK, rp.SUMMARY_SALES


@register("executive_summary", with_ctes("sales inventory", _metrics_sql("branch_code") + f"""
SELECT branch_code, 'inventory' AS report_type, '{_A[0]}' || total_products || '{_A[1]}' || CASE WHEN low_stock_items > 0 OR out_of_stock_items > 0
  THEN '{_A[2]}' || low_stock_items || '{_A[3]}' || out_of_stock_items || '{_A[4] + _A[5]}' ELSE '{_A[6]}' END AS executive_summary FROM m
UNION ALL SELECT branch_code, 'sales', '{_B[0]}' || format('{{:,.2f}}', total_revenue) || '{_B[1]}' || transaction_count || '{_B[2] + _B[3]}' ||
  format('{{:,.2f}}', {he('avg_transaction', 2)}) || '{_B[4]}' || CASE WHEN avg_transaction > 100 THEN '{_B[5]}' ELSE '{_B[6]}' END FROM m
UNION ALL SELECT branch_code, 'general', '{rp.SUMMARY_OTHER['general']}' FROM m"""))
def _(spark, d):
    m, out = metrics(spark, d), None
    for kind in ("inventory", "sales", "general"):
        part = rp.executive_summary(m, kind).select("branch_code", F.lit(kind).alias("report_type"), "executive_summary")
        out = part if out is None else out.unionAll(part)
    return out


def _pick(*pairs: tuple[str, str]) -> str:
    cells = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in pairs)
    return f"array_to_string(list_filter([{cells}], lambda t: t IS NOT NULL), ' | ')"


_E, _G, _M = rp.KPI_EFFICIENCY, rp.KPI_TARGET, rp.KPI_MEAN


@register("kpi_findings", f"""
WITH k AS (SELECT event_id, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS DOUBLE) AS e, value / 40 AS t,
   CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + user_id % 50 + 40 AS DOUBLE) / 2 AS a FROM events)
SELECT event_id, {_pick(('e >= 80', _E[0]), ('t >= 1.2', _G[0]), ('t >= 1.0 AND t < 1.2', _G[1]), ('a >= 85', _M[0]))} AS positive_trends,
  {_pick(('e < 80 AND e > 50', _E[2]), ('t >= 0.8 AND t < 1.0', _G[2]), ('a >= 70 AND a < 85', _M[1]))} AS patterns,
  {_pick(('e <= 50', _E[1]), ('t < 0.8', _G[3]), ('a < 70', _M[2]))} AS negative_trends FROM k""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    rows = fx.raw(spark, d, "events").select(
        "event_id", k.alias("efficiency_score"), (F.col("value") / 40).alias("target_achievement"),
        F.create_map(F.lit("quality"), k, F.lit("service"), (F.col("user_id") % 50 + 40).cast("double")).alias("kpi_metrics"))
    return rp.kpi_findings(rows).select("event_id", "positive_trends", "patterns", "negative_trends")


# --- L4, A33, F11 ---------------------------------------------------------------------------------

_ROW = "product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, CAST(revenue AS DOUBLE) AS revenue"
_KEYS = ["product_code", "branch_code", "sale_date", "quantity_sold", "revenue"]


def _rows(spark, d):
    return fx.sales(spark, d).select("product_code", "branch_code", "sale_date", "quantity_sold",
                                     F.col("revenue").cast("double").alias("revenue"))


for _name, _order in (("recent", "sale_date DESC, "), ("top_values", "quantity_sold DESC, "), ("head", "")):
    register(f"reduce_{_name}", with_ctes("sales", f"""
SELECT {_ROW} FROM sales ORDER BY {_order.replace('sale_date', 'sales.sale_date')}product_code, branch_code, sales.sale_date, quantity_sold, sales.revenue LIMIT 1000"""))(
        lambda spark, d, s=_name: rp.reduce_rows(_rows(spark, d), 1000, s, _KEYS))


# Exact amounts, so that both engines write the hashed keys alike.
_EXACT = "product_code, branch_code, sale_date, CAST(quantity_sold AS DECIMAL(18,2)) AS quantity_sold, revenue"


@register("reduce_sample", with_ctes("sales", f"""
, t AS (SELECT {_EXACT} FROM sales)
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, CAST(quantity_sold AS DOUBLE) AS quantity_sold,
  CAST(revenue AS DOUBLE) AS revenue FROM t
ORDER BY md5(concat_ws('|', product_code, branch_code, t.sale_date, t.quantity_sold, t.revenue, 42)), product_code, branch_code,
  t.sale_date, t.quantity_sold, t.revenue LIMIT 1000"""))
def _(spark, d):
    rows = fx.sales(spark, d).selectExpr(*_EXACT.split(", "))
    return rp.reduce_rows(rows, 1000, "sample", _KEYS).withColumns(
        {c: F.col(c).cast("double") for c in ("quantity_sold", "revenue")})


@register("reduction_report", with_ctes("sales", f"""
SELECT count(*) > 1000 AS reduced, count(*) AS original_rows, least(count(*), 1000) AS final_rows,
  {he('CASE WHEN count(*) > 1000 THEN (count(*) - 1000) / count(*) * 100 ELSE 0 END', 4)} AS reduction_percent, 'recent' AS strategy_used FROM sales"""))
def _(spark, d):
    return rp.reduction_report(fx.sales(spark, d), 1000, "recent")


@register("partial_export", with_ctes("inventory", f"""
, t AS (SELECT product_code, branch_code, product_name, Last_on_hand FROM inventory)
SELECT 0 AS is_summary, product_code, branch_code, product_name, CAST(Last_on_hand AS VARCHAR) AS Last_on_hand FROM (SELECT * FROM t ORDER BY product_code, branch_code LIMIT 1000)
UNION ALL SELECT 1, '{rp.ROWS_PREFIX}' || count(*), '{rp.ROWS_PREFIX}' || count(*), '{rp.ROWS_PREFIX}' || count(*),
  '{rp.SUM_PREFIX}' || CAST(CAST(sum(Last_on_hand) AS DECIMAL(38,2)) AS VARCHAR) FROM t"""))
def _(spark, d):
    i = fx.inventory(spark, d).select("product_code", "branch_code", "product_name", "Last_on_hand")
    return rp.partial_export(i, 1000, ["product_code", "branch_code"])


@register("json_safe", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events""")
def _(spark, d):
    rows = fx.raw(spark, d, "events").select("event_id", "ts", F.when(
        F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return clean.json_safe(rows)
