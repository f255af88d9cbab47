"""Dashboard, joins and transfers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stock as S
from ..functions.numeric import half_even
from ..operators import clean, dashboard as dash, joins, transfers as tr
from ..params import AnalysisParams
from . import fixtures as fx
from .fixtures import WINDOW, with_ctes
from .q_inventory import _active
from .registry import he, money, register

P = AnalysisParams()


def _shown(spark, d, by_month=False):
    return dash.dashboard_inputs(fx.sales(spark, d, True), fx.inventory(spark, d), by_month)


def _on_active(tail: str) -> str:
    return with_ctes("sales_r inventory", _active("sales_r", tail))


_KPIS = f"""SELECT (SELECT {money('sum(revenue)')} FROM SALES_T) AS total_sales,
  count(DISTINCT product_code) FILTER (Last_on_hand > 0) AS total_products,
  CAST(round(sum(inventory_value * CAST(Last_on_hand AS DECIMAL(18,2))) FILTER (Last_on_hand > 0), 2) AS DOUBLE) AS total_stock_value,
  count(DISTINCT supplier_name) AS total_suppliers FROM INV_T"""


@register("dashboard_kpis", _on_active(_KPIS.replace("SALES_T", "active_sales").replace("INV_T", "active_inv")))
def _(spark, d):
    return dash.dashboard_kpis(*_shown(spark, d))


@register("dashboard_kpis_branch", with_ctes("sales inventory", _KPIS.replace(
    "SALES_T", "sales WHERE branch_code = 'ASIA' AND sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'").replace(
    "INV_T", "inventory WHERE branch_code = 'ASIA'")))
def _(spark, d):
    s = clean.filter_branch(clean.filter_dates(fx.sales(spark, d), *WINDOW), "ASIA")
    return dash.dashboard_kpis(s, clean.filter_branch(fx.inventory(spark, d), "ASIA"))


@register("monthly_revenue", _on_active(
    f"SELECT strftime(sale_date, '%Y-%m') AS month, {money('sum(revenue)')} AS revenue FROM active_sales GROUP BY 1"))
def _(spark, d):
    return dash.monthly_revenue(_shown(spark, d, True)[0])


def _supp(sales: str, inv: str) -> str:
    return f""", supp AS (SELECT supplier_name, sum(revenue) AS revenue FROM {sales} s
  LEFT JOIN (SELECT DISTINCT product_code, supplier_name FROM {inv}) p ON p.product_code = s.product_code
  WHERE supplier_name IS NOT NULL GROUP BY 1)"""


@register("top_suppliers", _on_active(_supp("active_sales", "active_inv") + f"""
SELECT supplier_name, {money('revenue')} AS revenue FROM supp ORDER BY supp.revenue DESC, supplier_name LIMIT 10"""))
def _(spark, d):
    return dash.top_suppliers(*_shown(spark, d))


@register("supplier_distribution", _on_active(_supp("active_sales", "active_inv") + f"""
SELECT supplier_name, {money('revenue')} AS revenue,
  {he('CAST(revenue AS DOUBLE) / CAST((SELECT sum(revenue) FROM supp) AS DOUBLE) * 100', 2)} AS percentage FROM supp"""))
def _(spark, d):
    return dash.supplier_distribution(*_shown(spark, d))


@register("department_stock", _on_active("""
SELECT item_category1, CAST(sum(Last_on_hand) AS DOUBLE) AS Last_on_hand FROM active_inv GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 10"""))
def _(spark, d):
    return dash.department_stock(_shown(spark, d)[1])


@register("dashboard_report_tables", with_ctes("sales inventory", _supp("sales", "inventory") + f"""
SELECT 'monthly' AS report, strftime(sale_date, '%Y-%m') AS label, {money('sum(revenue)')} AS amount FROM sales GROUP BY 2
UNION ALL SELECT 'suppliers', supplier_name, {money('revenue')} FROM supp
UNION ALL SELECT 'departments', item_category1, CAST(sum(Last_on_hand) AS DOUBLE) FROM inventory GROUP BY 2"""))
def _(spark, d):
    t = dash.dashboard_report_tables(fx.sales(spark, d), fx.inventory(spark, d))
    out = None
    for name, df in t.items():
        part = df.toDF("label", "amount").select(F.lit(name).alias("report"), "label", "amount")
        out = part if out is None else out.unionAll(part)
    return out


# --- joins ----------------------------------------------------------------------------------------

@register("unified_sales", with_ctes("sales inventory", f"""
SELECT s.product_code, s.branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, CAST(revenue AS DOUBLE) AS revenue,
  product_name, Last_on_hand, supplier_name, {he('CAST(revenue AS DOUBLE) / quantity_sold', 4)} AS price
FROM (SELECT DISTINCT * FROM sales WHERE quantity_sold > 0) s JOIN (SELECT * FROM inventory WHERE Last_on_hand > 0) i
  ON i.product_code = s.product_code AND i.branch_code = s.branch_code"""))
def _(spark, d):
    return joins.unified_sales(fx.sales(spark, d), fx.inventory(spark, d)).select(
        "product_code", "branch_code", "sale_date", "quantity_sold", F.col("revenue").cast("double").alias("revenue"),
        "product_name", "Last_on_hand", "supplier_name", half_even(F.col("price"), 4).alias("price"))


@register("sales_item_info", with_ctes("sales_r inventory", f"""
SELECT s.product_code, s.branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold,
  CASE WHEN discount > 1000 THEN 0 ELSE CAST(discount AS DOUBLE) END AS discount,
  {he('CAST(revenue AS DOUBLE) / quantity_sold', 4)} AS price, product_name, item_category1,
  CAST(Last_on_hand AS DOUBLE) AS Last_on_hand
FROM sales_r s LEFT JOIN inventory i ON i.product_code = s.product_code AND i.branch_code = s.branch_code"""))
def _(spark, d):
    s = fx.sales(spark, d, True).withColumn("discount", F.when(F.col("discount") <= 1000, F.col("discount")))
    return joins.sales_with_item_info(s, fx.inventory(spark, d)).select(
        "product_code", "branch_code", "sale_date", "quantity_sold", F.col("discount").cast("double").alias("discount"),
        half_even(F.col("price"), 4).alias("price"), "product_name", "item_category1",
        F.col("Last_on_hand").cast("double").alias("Last_on_hand"))


# Two suppliers for every product: the listed one and, per stock row, one named after the brand.
_TWO = """(SELECT product_code, supplier_name FROM inventory UNION ALL SELECT product_code, 'Brand house ' || item_category2 FROM inventory)"""


@register("supplier_attribution", with_ctes("sales inventory", f"""
SELECT s.product_code, s.branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold, supplier_name
FROM sales s LEFT JOIN (SELECT DISTINCT * FROM {_TWO}) p ON p.product_code = s.product_code"""))
def _(spark, d):
    i = fx.inventory(spark, d)
    two = i.select("product_code", "supplier_name").unionAll(
        i.select("product_code", F.concat(F.lit("Brand house "), "item_category2")))
    s = fx.sales(spark, d).select("product_code", "branch_code", "sale_date", "quantity_sold")
    return dash.supplier_rows(s, two)


@register("distinct_products", with_ctes("sales_r inventory", """
SELECT DISTINCT product_code FROM (SELECT product_code FROM sales_r UNION ALL SELECT product_code FROM inventory)"""))
def _(spark, d):
    from ..operators.versions import distinct_products
    return distinct_products([fx.sales(spark, d, True), fx.inventory(spark, d)])


# --- transfers ------------------------------------------------------------------------------------

def _balance(src: str) -> str:
    return f""", rates AS (SELECT branch_code, product_code, sum(quantity_sold) AS total_quantity_sold,
    count(DISTINCT sale_date) AS sale_days, sum(quantity_sold) / count(DISTINCT sale_date) AS avg_daily_sales
  FROM {src} GROUP BY 1, 2),
bal0 AS (SELECT i.branch_code, i.product_code, product_name, item_category1, item_category2, Last_on_hand,
    coalesce(avg_daily_sales, 0) AS avg_daily_sales,
    CASE WHEN coalesce(avg_daily_sales, 0) <> 0 THEN Last_on_hand / avg_daily_sales END AS coverage_days
  FROM inventory i LEFT JOIN rates r ON r.branch_code = i.branch_code AND r.product_code = i.product_code
  WHERE i.branch_code IN (SELECT branch_code FROM {src})),
bal AS (SELECT *, CASE WHEN coverage_days < {P.min_coverage} THEN '{S.SHORTAGE}' WHEN coverage_days <= {P.max_coverage}
    THEN '{S.BALANCED}' ELSE '{S.SURPLUS}' END AS coverage_status FROM bal0
  WHERE NOT (Last_on_hand = 0 AND avg_daily_sales = 0)),
amt AS (SELECT *, coverage_days < {P.min_coverage} AS needy,
    CAST(trunc(CASE WHEN coverage_days < {P.min_coverage} THEN ({P.min_coverage} - coverage_days) * avg_daily_sales
      ELSE (coverage_days - {P.max_coverage}) * avg_daily_sales END) AS BIGINT) AS qty
  FROM bal WHERE coverage_days < {P.min_coverage} OR coverage_days > {P.max_coverage}),
line AS (SELECT *, sum(qty) OVER (PARTITION BY product_code, needy ORDER BY branch_code ROWS UNBOUNDED PRECEDING) AS e
  FROM amt WHERE qty > 0),
moves AS (SELECT n.product_code, n.product_name, n.item_category1, n.item_category2, o.branch_code AS from_branch,
    n.branch_code AS to_branch, CAST(least(n.e, o.e) - greatest(n.e - n.qty, o.e - o.qty) AS BIGINT) AS transfer_qty
  FROM line n JOIN line o ON o.product_code = n.product_code AND n.needy AND NOT o.needy
   AND least(n.e, o.e) > greatest(n.e - n.qty, o.e - o.qty))"""


_BAL = f"""SELECT branch_code, product_code, product_name, item_category1, item_category2, Last_on_hand,
  {he('avg_daily_sales', 6)} AS avg_daily_sales, {he('coverage_days', 6)} AS coverage_days, coverage_status FROM bal"""


def _bal_out(df):
    return df.withColumns({"avg_daily_sales": half_even(F.col("avg_daily_sales"), 6),
                           "coverage_days": half_even(F.col("coverage_days"), 6)})


@register("branch_sales_rate", with_ctes("sales", _balance("sales").split(",\nbal0")[0] + f"""
SELECT branch_code, product_code, total_quantity_sold, sale_days, {he('avg_daily_sales', 6)} AS avg_daily_sales FROM rates"""))
def _(spark, d):
    return tr.branch_sales_rate(fx.sales(spark, d)).withColumn(
        "avg_daily_sales", half_even(F.col("avg_daily_sales"), 6))


for _sfx, _src in (("", "sales"), ("_window", "sales_w")):
    def _make(windowed):
        def balance(spark, d):
            s = fx.sales(spark, d)
            return tr.branch_balance(clean.filter_dates(s, *WINDOW) if windowed else s, fx.inventory(spark, d), P)
        return balance
    _b = _make(bool(_sfx))
    register(f"branch_balance{_sfx}", with_ctes(f"{_src} inventory", _balance(_src) + _BAL))(
        lambda spark, d, b=_b: _bal_out(b(spark, d)))
    register(f"transfer_proposals{_sfx}", with_ctes(f"{_src} inventory", _balance(_src) + "SELECT * FROM moves"))(
        lambda spark, d, b=_b: tr.propose_transfers(b(spark, d), P.min_coverage, P.max_coverage))
    if not _sfx:
        _whole = _b


@register("transfers_filtered", with_ctes("sales inventory", _balance("sales") + """
SELECT * FROM moves WHERE from_branch = 'ASIA' AND to_branch = 'EUROPE'"""))
def _(spark, d):
    return tr.filter_transfers(tr.propose_transfers(_whole(spark, d)), "ASIA", "EUROPE")


@register("transfer_report", with_ctes("sales inventory", _balance("sales") + """
SELECT 'transfers' AS report, product_code AS "كود المنتج", from_branch AS branch, CAST(transfer_qty AS DOUBLE) AS amount FROM moves
UNION ALL SELECT 'summary', product_code, branch_code, CAST(Last_on_hand AS DOUBLE) FROM bal"""))
def _(spark, d):
    b = _whole(spark, d)
    t = tr.transfer_report_tables(b, tr.propose_transfers(b))
    return t["transfers"].select(F.lit("transfers").alias("report"), F.col("product_code").alias("كود المنتج"),
                                 F.col("from_branch").alias("branch"), F.col("transfer_qty").cast("double").alias("amount")) \
        .unionAll(t["summary"].select(F.lit("summary"), "product_code", "branch_code",
                                      F.col("Last_on_hand").cast("double")))
