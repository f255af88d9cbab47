"""Inventory analysis, alerts and the activity filter over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stock as S
from ..operators import activity, alerts, clean, inventory as inv
from ..params import AnalysisParams
from . import fixtures as fx
from .registry import he, register
from .fixtures import AS_OF, WINDOW, with_ctes

P = AnalysisParams()


def _window(spark, d):
    return clean.filter_dates(fx.sales(spark, d), *WINDOW)


# --- F: filters and cleaning ----------------------------------------------------------------------

@register("sales_date_filter", with_ctes("sales", """
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold,
       CAST(revenue AS DOUBLE) AS revenue
FROM sales WHERE sale_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-31'"""))
def _(spark, d):
    return _window(spark, d).select("product_code", "branch_code", "sale_date", "quantity_sold",
                                    F.col("revenue").cast("double").alias("revenue"))


@register("branch_filter", with_ctes("inventory", """
SELECT product_code, branch_code, Last_on_hand FROM inventory WHERE branch_code = 'ASIA'"""))
def _(spark, d):
    return clean.filter_branch(fx.inventory(spark, d), "ASIA").select("product_code", "branch_code", "Last_on_hand")


_STD_S = """, dirty AS (SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date,
    CASE WHEN quantity_sold = 7 THEN 'seven' ELSE CAST(CAST(quantity_sold AS BIGINT) AS VARCHAR) END AS q,
    CASE WHEN branch_code = 'ASIA' AND quantity_sold = 9 THEN NULL ELSE CAST(CAST(round(revenue) AS BIGINT) AS VARCHAR) END AS r
  FROM sales)
SELECT product_code, branch_code, sale_date, coalesce(TRY_CAST(q AS DOUBLE), 0) AS quantity_sold,
       coalesce(TRY_CAST(r AS DOUBLE), 0) AS revenue FROM dirty"""


@register("standardize_sales", with_ctes("sales", _STD_S))
def _(spark, d):
    q = F.col("quantity_sold")
    dirty = fx.sales(spark, d).select(
        F.col("product_code").alias(" Item code "), F.col("branch_code").alias("Location"),
        F.col("sale_date").cast("string").alias("Date"),
        F.when(q == 7, "seven").otherwise(q.cast("bigint").cast("string")).alias("Quantity"),
        F.when(~((F.col("branch_code") == "ASIA") & (q == 9)), F.round("revenue").cast("bigint").cast("string"))
        .alias("Total Price"))
    return clean.standardize(dirty, "sales")


@register("standardize_inventory", with_ctes("inventory", """
SELECT product_code, branch_code, product_name, item_category1,
       coalesce(TRY_CAST(CASE WHEN Last_on_hand < 0 THEN 'n/a' ELSE CAST(Last_on_hand AS VARCHAR) END AS DOUBLE), 0) AS Last_on_hand,
       CAST(inventory_value AS DOUBLE) AS inventory_value FROM inventory"""))
def _(spark, d):
    have = F.col("Last_on_hand")
    dirty = fx.inventory(spark, d).select(
        F.col("product_code").alias("Item_code"), F.col("branch_code").alias("الفرع"),
        F.col("product_name").alias("Item description"), F.col("item_category1").alias("القسم"),
        F.when(have < 0, "n/a").otherwise(have.cast("string")).alias("quantity"),
        F.col("inventory_value").cast("string").alias("Inventory_value/unit"))
    return clean.standardize(dirty, "inventory")


@register("clean_sales", with_ctes("sales", """
SELECT DISTINCT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold,
       CAST(revenue AS DOUBLE) AS revenue
FROM (SELECT * FROM sales UNION ALL SELECT * FROM sales)
WHERE product_code IS NOT NULL AND branch_code IS NOT NULL AND sale_date IS NOT NULL AND quantity_sold > 0"""))
def _(spark, d):
    s = fx.sales(spark, d).select("product_code", "branch_code", "sale_date", "quantity_sold",
                                  F.col("revenue").cast("double").alias("revenue"))
    return clean.clean_sales(s.unionAll(s))


_PAIR = "product_code, branch_code, Last_on_hand, product_name, supplier_name"


@register("clean_inventory", with_ctes("inventory", f"""
, twice AS (SELECT {_PAIR} FROM inventory UNION ALL
            SELECT product_code, branch_code, Last_on_hand + 1, product_name, supplier_name FROM inventory)
SELECT {_PAIR} FROM (
  SELECT *, row_number() OVER (PARTITION BY product_code, branch_code ORDER BY Last_on_hand, product_name, supplier_name) AS rn
  FROM twice WHERE Last_on_hand > 0) WHERE rn = 1"""))
def _(spark, d):
    one = fx.inventory(spark, d).select(*_PAIR.split(", "))
    again = one.withColumn("Last_on_hand", F.col("Last_on_hand") + 1)
    return clean.clean_inventory(one.unionAll(again))


@register("unit_price", with_ctes("sales", f"""
SELECT product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold,
       {he('CASE WHEN quantity_sold = 0 THEN 0 ELSE CAST(revenue AS DOUBLE) / quantity_sold END', 6)} AS price
FROM sales"""))
def _(spark, d):
    from ..functions.numeric import half_even
    return clean.with_price(fx.sales(spark, d)).select(
        "product_code", "branch_code", "sale_date", "quantity_sold", half_even(F.col("price"), 6).alias("price"))


def _check_sql(cte: str, source: str, cells: list[tuple[str, str | None]]) -> str:
    parts = []
    for name, bad in cells:
        if bad is None:
            parts.append(f"SELECT '{name}' AS column_name, false AS is_present, CAST(NULL AS BIGINT) AS null_count, "
                         f"CAST(NULL AS BIGINT) AS unreadable_count, count(*) AS row_count FROM {source}")
        else:
            parts.append(f"SELECT '{name}' AS column_name, true AS is_present, count(*) FILTER ({name} IS NULL) AS null_count, "
                         f"count(*) FILTER ({bad}) AS unreadable_count, count(*) AS row_count FROM {source}")
    body = " UNION ALL ".join(parts)
    return with_ctes(cte, f"SELECT column_name, is_present, CAST(null_count AS DOUBLE) AS null_count, "
                          f"CAST(unreadable_count AS DOUBLE) AS unreadable_count, row_count FROM ({body})")


def _checked(df, role):
    return clean.check_table(df, role).withColumns({
        "null_count": F.col("null_count").cast("double"), "unreadable_count": F.col("unreadable_count").cast("double")})


@register("table_check_sales", _check_sql(
    "sales", "(SELECT product_code, branch_code, sale_date, CASE WHEN quantity_sold = 7 THEN 'seven' WHEN quantity_sold = 9 "
    "THEN NULL ELSE CAST(quantity_sold AS VARCHAR) END AS quantity_sold FROM sales)",
    [("branch_code", "false"), ("product_code", "false"), ("sale_date", "false"),
     ("quantity_sold", "quantity_sold IS NOT NULL AND TRY_CAST(quantity_sold AS DOUBLE) IS NULL"), ("price", None)]))
def _(spark, d):
    q = F.col("quantity_sold")
    s = fx.sales(spark, d).select("product_code", "branch_code", "sale_date", F.when(q == 7, "seven").when(
        q != 9, q.cast("string")).alias("quantity_sold"))
    return _checked(s, "sales")


@register("table_check_inventory", _check_sql(
    "inventory", "(SELECT product_code, CASE WHEN Last_on_hand < 0 THEN NULL ELSE product_name END AS product_name, "
    "Last_on_hand FROM inventory)",
    [("product_code", "false"), ("product_name", "false"), ("Last_on_hand", "false")]))
def _(spark, d):
    i = fx.inventory(spark, d).select("product_code", F.when(F.col("Last_on_hand") >= 0, F.col("product_name"))
                                      .alias("product_name"), "Last_on_hand")
    return _checked(i, "inventory")


# --- J5, J6, A32, U3: activity filter -------------------------------------------------------------

def _active(sales: str, tail: str) -> str:
    return f"""
, inactive AS (
  SELECT product_code FROM inventory GROUP BY product_code HAVING max(Last_on_hand) = 0
  EXCEPT SELECT product_code FROM {sales} WHERE quantity_sold > 0),
active_inv AS (SELECT * FROM inventory WHERE product_code NOT IN (SELECT product_code FROM inactive)),
active_sales AS (SELECT * FROM {sales} WHERE product_code IN (SELECT product_code FROM active_inv))
{tail}"""


_INV_OUT = "product_code, branch_code, Last_on_hand"
_SALE_OUT = "product_code, branch_code, CAST(sale_date AS VARCHAR) AS sale_date, quantity_sold"


def _sale_out(df):
    return df.select("product_code", "branch_code", "sale_date", "quantity_sold")


@register("active_inventory", with_ctes("sales inventory", _active("sales", f"SELECT {_INV_OUT} FROM active_inv")))
def _(spark, d):
    return activity.drop_inactive_inventory(fx.sales(spark, d), fx.inventory(spark, d)).select(*_INV_OUT.split(", "))


@register("active_inventory_window",
          with_ctes("sales_w inventory", _active("sales_w", f"SELECT {_INV_OUT} FROM active_inv")))
def _(spark, d):
    return activity.drop_inactive_inventory(_window(spark, d), fx.inventory(spark, d)).select(*_INV_OUT.split(", "))


@register("active_sales", with_ctes("sales_r inventory", _active("sales_r", f"SELECT {_SALE_OUT} FROM active_sales")))
def _(spark, d):
    return _sale_out(activity.drop_inactive_sales(fx.sales(spark, d, True), fx.inventory(spark, d)))


@register("orphan_sales_removed", with_ctes("sales_r inventory", f"""
SELECT {_SALE_OUT} FROM sales_r WHERE product_code IN (SELECT product_code FROM inventory)"""))
def _(spark, d):
    return _sale_out(activity.drop_orphan_sales(fx.sales(spark, d, True), fx.inventory(spark, d)))


_STATS = f"""
, c AS (SELECT
  (SELECT count(*) FROM inactive) AS items_filtered,
  (SELECT count(*) FROM inventory) AS total_items_before, (SELECT count(*) FROM active_inv) AS total_items_after,
  (SELECT count(*) FROM SRC) AS sales_records_before, (SELECT count(*) FROM active_sales) AS sales_records_after,
  (SELECT count(DISTINCT product_code) FROM SRC WHERE product_code NOT IN (SELECT product_code FROM inventory)) AS orphan_products,
  (SELECT count(*) FROM inventory WHERE Last_on_hand > 0 AND product_code IN (SELECT product_code FROM inactive)) = 0 AS integrity_valid)
SELECT *, {he('items_filtered * 100.0::DOUBLE / total_items_before', 2)} AS filtering_percentage,
  orphan_products = 0 AS referential_valid_before_repair,
  CASE WHEN NOT integrity_valid THEN 'ERROR' WHEN orphan_products > 0 THEN 'WARNING'
       WHEN items_filtered * 100.0 / total_items_before > 20 THEN 'INFO_SIGNIFICANT'
       WHEN items_filtered > 0 THEN 'INFO' ELSE 'DEBUG' END AS severity FROM c"""


@register("activity_filter_stats",
          with_ctes("sales_r inventory", _active("sales_r", _STATS.replace("SRC", "sales_r"))))
def _(spark, d):
    return activity.activity_filter_stats(fx.sales(spark, d, True), fx.inventory(spark, d))


@register("activity_filter_stats_window",
          with_ctes("sales_w inventory", _active("sales_w", _STATS.replace("SRC", "sales_w"))))
def _(spark, d):
    return activity.activity_filter_stats(_window(spark, d), fx.inventory(spark, d))


_SETS = """
, s0 AS (SELECT DISTINCT product_code FROM SRC), i0 AS (SELECT DISTINCT product_code FROM inventory),
  s1 AS (SELECT DISTINCT product_code FROM active_sales), i1 AS (SELECT DISTINCT product_code FROM active_inv)
SELECT product_code, 'orphaned_sales' AS difference FROM (SELECT * FROM s1 EXCEPT SELECT * FROM i1)
UNION ALL SELECT product_code, 'inventory_without_sales' FROM (SELECT * FROM i1 EXCEPT SELECT * FROM s1)
UNION ALL SELECT product_code, 'removed_sales_product' FROM (SELECT * FROM s0 EXCEPT SELECT * FROM s1)
UNION ALL SELECT product_code, 'removed_inventory_product' FROM (SELECT * FROM i0 EXCEPT SELECT * FROM i1)
UNION ALL SELECT product_code, 'filtered_from_inventory_only' FROM
  ((SELECT * FROM i0 EXCEPT SELECT * FROM i1) INTERSECT SELECT * FROM s1)"""


@register("referential_diff", with_ctes("sales_r inventory", _active("sales_r", _SETS.replace("SRC", "sales_r"))))
def _(spark, d):
    s, i = fx.sales(spark, d, True), fx.inventory(spark, d)
    return activity.referential_diff(s, i, *activity.drop_inactive(s, i))


@register("referential_diff_window",
          with_ctes("sales_w inventory", _active("sales_w", _SETS.replace("SRC", "sales_w"))))
def _(spark, d):
    s, i = _window(spark, d), fx.inventory(spark, d)
    return activity.referential_diff(s, i, *activity.drop_inactive(s, i))


# --- A6, A7 and what is read off it ---------------------------------------------------------------

def _stats_cte(source: str) -> str:
    return f"""
stats AS (SELECT product_code, {he('sum(quantity_sold)', 2)} AS quantity_sold_sum, {he('avg(quantity_sold)', 2)} AS quantity_sold_mean,
    count(quantity_sold) AS quantity_sold_count, min(sale_date) AS sale_date_min, max(sale_date) AS sale_date_max,
    CAST(max(sale_date) - min(sale_date) + 1 AS INTEGER) AS days_in_period,
    {he('sum(quantity_sold)', 2)} / (max(sale_date) - min(sale_date) + 1) AS daily_sales
  FROM {source} GROUP BY product_code)"""


def _analysis_cte(source: str, p: AnalysisParams = P) -> str:
    return _active(source, f""", {_stats_cte('active_sales')},
joined AS (SELECT i.product_code, i.product_name, i.branch_code, i.item_category1, i.item_category2, i.supplier_name,
    CAST(i.Last_on_hand AS DOUBLE) AS have, coalesce(s.daily_sales, 0) AS daily,
    coalesce(s.quantity_sold_sum, 0) AS quantity_sold, coalesce(s.quantity_sold_mean, 0) AS quantity_sold_mean,
    coalesce(s.quantity_sold_count, 0) AS quantity_sold_count, s.sale_date_min, s.sale_date_max,
    coalesce(s.days_in_period, {p.forecast_days}) AS days_in_period
  FROM active_inv i LEFT JOIN stats s ON s.product_code = i.product_code),
covered AS (SELECT *, CASE WHEN daily = 0 THEN 9999.0::DOUBLE ELSE have / daily END AS cover,
    daily * {p.forecast_days} AS demand FROM joined),
named AS (SELECT *, CASE WHEN have = 0 THEN '{S.OUT_OF_STOCK}' WHEN cover < {p.min_coverage} THEN '{S.LOW_STOCK}'
    WHEN daily = 0 AND have > 0 THEN '{S.STAGNANT}' WHEN daily > 0 AND cover > {p.stagnant_period} THEN '{S.STAGNANT}'
    WHEN cover > {p.max_coverage} THEN '{S.OVERSTOCK}' ELSE '{S.NORMAL}' END AS status FROM covered),
results AS (SELECT product_code, product_name, branch_code, item_category1, item_category2, supplier_name,
    {he('have', 2)} AS Last_on_hand, quantity_sold, quantity_sold_mean, quantity_sold_count,
    CAST(sale_date_min AS VARCHAR) AS sale_date_min, CAST(sale_date_max AS VARCHAR) AS sale_date_max, days_in_period,
    {he('daily', 2)} AS daily_sales, {he('cover', 2)} AS coverage_days,
    CASE WHEN have >= demand OR status = '{S.STAGNANT}' THEN NULL ELSE demand END AS expected_demand,
    {he('demand', 2)} AS forecasted_demand,
    CASE WHEN have >= demand OR status = '{S.STAGNANT}' THEN NULL
         WHEN daily = 0 THEN 0.0::DOUBLE
         ELSE {he(f'greatest(demand + {p.safety_stock} - have, 0)', 2)} END AS recommended_order,
    status, status = '{S.STAGNANT}' AS is_stagnant,
    CASE status WHEN '{S.OUT_OF_STOCK}' THEN 1 WHEN '{S.LOW_STOCK}' THEN 2 WHEN '{S.OVERSTOCK}' THEN 3
         WHEN '{S.STAGNANT}' THEN 4 ELSE 5 END AS priority_score,
    CASE WHEN daily > 10 THEN 'A' WHEN daily > 1 THEN 'B' ELSE 'C' END AS abc_classification,
    CASE status WHEN '{S.OUT_OF_STOCK}' THEN '{S.ADVICE_OUT}'
         WHEN '{S.LOW_STOCK}' THEN '{S.ADVICE_LOW[0]}' || CAST({he('cover')} AS BIGINT) || '{S.ADVICE_LOW[1]}'
         WHEN '{S.OVERSTOCK}' THEN '{S.ADVICE_OVER}'
         WHEN '{S.STAGNANT}' THEN CASE WHEN daily = 0 THEN '{S.ADVICE_NO_SALES}'
              ELSE '{S.ADVICE_SLOW[0]}' || CAST({he('cover')} AS BIGINT) || '{S.ADVICE_SLOW[1]}' END
         ELSE '{S.ADVICE_NORMAL}' END AS recommendations,
    have >= demand AS Stock_Is_Sufficient FROM named)""")


@register("product_sales_stats", with_ctes("sales", f""", {_stats_cte('sales')}
SELECT product_code, quantity_sold_sum, quantity_sold_mean, quantity_sold_count,
  CAST(sale_date_min AS VARCHAR) AS sale_date_min, CAST(sale_date_max AS VARCHAR) AS sale_date_max, days_in_period,
  {he('daily_sales', 4)} AS daily_sales FROM stats"""))
def _(spark, d):
    from ..functions.numeric import half_even
    return inv.product_sales_stats(fx.sales(spark, d)).drop("_top_sale").withColumn(
        "daily_sales", half_even(F.col("daily_sales"), 4))


def _rounded(df):
    from ..functions.numeric import half_even
    return df.withColumn("expected_demand", half_even(F.col("expected_demand"), 4))


_ALL = f"SELECT * REPLACE ({he('expected_demand', 4)} AS expected_demand) FROM results"


@register("inventory_analysis", with_ctes("sales inventory", _analysis_cte("sales") + _ALL))
def analysis(spark, d):
    return _rounded(inv.analyze_inventory(fx.sales(spark, d), fx.inventory(spark, d), P))


@register("inventory_analysis_window", with_ctes("sales_w inventory", _analysis_cte("sales_w") + _ALL))
def analysis_window(spark, d):
    return _rounded(results(spark, d))


def results(spark, d):
    return inv.analyze_inventory(_window(spark, d), fx.inventory(spark, d), P, ordered=False)


def _on_results(name: str, tail: str):
    """Register a query on the analysis twice: over all sales, and as ``*_window`` over the analysis date range."""
    def keep(fn):
        register(name, with_ctes("sales inventory", _analysis_cte("sales") + tail))(
            lambda spark, d: fn(inv.analyze_inventory(fx.sales(spark, d), fx.inventory(spark, d), P, ordered=False)))
        register(f"{name}_window", with_ctes("sales_w inventory", _analysis_cte("sales_w") + tail))(
            lambda spark, d: fn(results(spark, d)))
        return fn
    return keep


_BRIEF = ["product_code", "branch_code", "Last_on_hand", "daily_sales", "coverage_days", "status"]


@_on_results(
    "critical_items",
    f"SELECT {', '.join(_BRIEF)} FROM results WHERE coverage_days < 7 AND daily_sales > 0")
def _(rows):
    return inv.critical_items(rows, P.min_coverage).select(*_BRIEF)


@_on_results("stagnant_items", f"SELECT {', '.join(_BRIEF)} FROM results WHERE is_stagnant")
def _(rows):
    return inv.stagnant_items(rows).select(*_BRIEF)


@_on_results("inventory_search", f"""
SELECT {', '.join(_BRIEF)} FROM results WHERE (contains(lower(product_code), 'ring') OR contains(lower(product_name), 'ring')
   OR contains(lower(item_category1), 'ring')) AND Last_on_hand >= 50 AND Last_on_hand <= 600""")
def _(rows):
    return clean.filter_inventory(rows, search="RING", min_stock=50, max_stock=600, columns=_BRIEF)


for _name, _status, _where in (
        ("low", "low_stock", "coverage_days < 7"), ("stagnant", "stagnant", "is_stagnant"),
        ("available", "available", "coverage_days >= 7 AND NOT is_stagnant")):
    def _make(status):
        return lambda rows: clean.filter_inventory(rows, category="ECONOMY", status=status,
                                                   min_coverage=7, columns=_BRIEF)
    _on_results(
        f"inventory_filter_status_{_name}",
        f"SELECT {', '.join(_BRIEF)} FROM results WHERE item_category1 = 'ECONOMY' AND {_where}")(_make(_status))


_REPORT = ("product_code, product_name, item_category1, item_category2, branch_code, Last_on_hand, supplier_name, "
           "quantity_sold, daily_sales, coverage_days, " + he("expected_demand", 4) + " AS expected_demand, "
           "is_stagnant, abc_classification, recommendations")
for _name, _where in (("main", "quantity_sold > 0"), ("critical", "coverage_days < 7 AND daily_sales > 0"),
                      ("stagnant", "is_stagnant")):
    def _make(name):
        return lambda rows: _rounded(inv.inventory_report_tables(rows, P)[name])
    _on_results(f"report_{_name}", f"SELECT {_REPORT} FROM results WHERE {_where}")(_make(_name))


@_on_results("notifications", """
SELECT 'notif_' || product_code || '_' || branch_code AS id, 'تنبيه مخزون' AS title,
  CASE WHEN Last_on_hand = 0 THEN 'نفد المخزون للمنتج ' || product_name || ' في فرع ' || branch_code
       WHEN coverage_days < 7 THEN 'المنتج ' || product_name || ' سينفد خلال ' || CAST(trunc(coverage_days) AS BIGINT) || ' أيام في فرع ' || branch_code
       ELSE 'المخزون (' || CAST(trunc(Last_on_hand) AS BIGINT) || ') أقل من حد الأمان للمنتج ' || product_name || ' في فرع ' || branch_code END AS message,
  CASE WHEN coverage_days < 7 THEN 'warning' ELSE 'info' END AS type, product_code, branch_code AS branch
FROM results WHERE Last_on_hand < 20 OR coverage_days < 7
ORDER BY priority_score, coverage_days, product_code, branch_code LIMIT 20""")
def _(rows):
    return inv.notifications(rows, safety_stock=20, limit=20)


# --- A10, W1 --------------------------------------------------------------------------------------

def _pareto(source: str, tail: str) -> str:
    return f""", rates AS (SELECT product_code, sum(quantity_sold) AS quantity_sold, count(DISTINCT sale_date) AS sale_days
   FROM {source} GROUP BY product_code),
graded AS (SELECT r.product_code, r.quantity_sold,
   sum(quantity_sold) OVER (ORDER BY quantity_sold DESC, product_code ROWS UNBOUNDED PRECEDING) / sum(quantity_sold) OVER () AS share
   FROM rates r WHERE quantity_sold > 0 AND product_code IN (SELECT product_code FROM inventory)),
grades AS (SELECT product_code, share, CASE WHEN share <= 0.80 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM graded)
{tail}"""


@register("pareto_abc", with_ctes("sales inventory", _pareto("sales", f"""
SELECT i.product_code, {he('share', 6)} AS cumulative_share, coalesce(abc, 'C') AS abc_classification
FROM (SELECT DISTINCT product_code FROM inventory) i LEFT JOIN grades g ON g.product_code = i.product_code""")))
def _(spark, d):
    from ..functions.numeric import half_even
    base = fx.inventory(spark, d).select("product_code").distinct().join(
        inv.selling_day_rates(fx.sales(spark, d)), "product_code", "left")
    return inv.pareto_abc(base).drop("quantity_sold", "sale_days").withColumn("cumulative_share", half_even(F.col("cumulative_share"), 6))


def _grid() -> str:
    p, out = P, []
    for grade, (below, above, within) in S.PARETO_ADVICE.items():
        out.append(f"WHEN abc = '{grade}' AND coverage_days < {p.min_coverage} THEN '{below}' "
                   f"WHEN abc = '{grade}' AND coverage_days > {p.max_coverage} THEN '{above}' "
                   f"WHEN abc = '{grade}' THEN '{within}'")
    return " ".join(out)


_PARETO_ROWS = f"""
, m AS (SELECT i.product_code, branch_code, product_name, Last_on_hand, coalesce(quantity_sold, 0) AS quantity_sold,
     coalesce(sale_days, 0) AS sale_days,
     CASE WHEN coalesce(sale_days, 0) > 0 THEN quantity_sold / sale_days ELSE 0 END AS daily_sales, coalesce(abc, 'C') AS abc
   FROM inventory i LEFT JOIN rates r ON r.product_code = i.product_code LEFT JOIN grades g ON g.product_code = i.product_code),
c AS (SELECT *, CASE WHEN daily_sales > 0 THEN {he('Last_on_hand / daily_sales', 1)} ELSE 999.0::DOUBLE END AS coverage_days,
     daily_sales * {P.forecast_days} - Last_on_hand AS gap, quantity_sold = 0 AND Last_on_hand > 0 AS is_stagnant FROM m)
SELECT product_code, branch_code, product_name, Last_on_hand, quantity_sold, sale_days, {he('daily_sales', 6)} AS daily_sales,
  coverage_days, CASE WHEN gap > 0 AND NOT is_stagnant THEN {he('gap')} END AS expected_demand,
  gap <= 0 AS Stock_Is_Sufficient, is_stagnant, abc AS abc_classification,
  CASE WHEN daily_sales <= 0 THEN '{S.PARETO_STOP}' {_grid()} ELSE '{S.PARETO_UNKNOWN}' END AS recommendations
FROM c WHERE NOT (quantity_sold = 0 AND Last_on_hand = 0)"""


def _pareto_out(df):
    from ..functions.numeric import half_even
    return df.withColumn("daily_sales", half_even(F.col("daily_sales"), 6))


@register("pareto_analysis", with_ctes("sales inventory", _pareto("sales", _PARETO_ROWS)))
def _(spark, d):
    return _pareto_out(inv.pareto_analysis(fx.sales(spark, d), fx.inventory(spark, d), P))


@register("pareto_analysis_window", with_ctes("sales_w inventory", _pareto("sales_w", _PARETO_ROWS)))
def _(spark, d):
    return _pareto_out(inv.pareto_analysis(_window(spark, d), fx.inventory(spark, d), P))


# --- L2, C7, A13, F10: alerts ---------------------------------------------------------------------

_BANDS = "(VALUES " + ", ".join(
    f"('{lv}', {lo}, {hi}, '{lab}', '{st}', {pr})" for lv, lo, hi, lab, st, pr in S.ALERT_BANDS
) + ") b(level, lo, hi, label, style, priority)"


def _alerts(source: str) -> str:
    return _active(source, f"""
, alerts AS (SELECT product_code, CASE WHEN product_name IS NULL OR product_name = '' THEN '{S.NO_NAME}'
      WHEN length(product_name) <= 30 THEN product_name ELSE substr(product_name, 1, 27) || '...' END AS product_name,
    branch_code, greatest(Last_on_hand, 0) AS current_stock, label AS alert_status, style AS status_class, priority,
    '{AS_OF}' AS last_updated
  FROM active_inv JOIN {_BANDS} ON greatest(Last_on_hand, 0) BETWEEN lo AND hi)""")


@register("inventory_alerts", with_ctes("sales inventory", _alerts("sales") + """
SELECT * FROM alerts ORDER BY priority, current_stock, product_code, branch_code LIMIT 1000"""))
def _(spark, d):
    return alerts.inventory_alerts(fx.inventory(spark, d), fx.sales(spark, d), limit=1000, as_of=AS_OF)


@register("inventory_alerts_all", with_ctes("sales inventory", _alerts("sales") + "SELECT * FROM alerts"))
def _(spark, d):
    return alerts.inventory_alerts(fx.inventory(spark, d), fx.sales(spark, d), limit=None, as_of=AS_OF)


@register("inventory_alerts_all_window", with_ctes("sales_w inventory", _alerts("sales_w") + "SELECT * FROM alerts"))
def _(spark, d):
    return alerts.inventory_alerts(fx.inventory(spark, d), _window(spark, d), limit=None, as_of=AS_OF)


@register("inventory_alerts_branch", with_ctes("sales inventory", _alerts("sales").replace(
    "FROM sales WHERE", "FROM sales WHERE branch_code = 'EUROPE' AND").replace(
    "FROM inventory GROUP", "FROM inventory WHERE branch_code = 'EUROPE' GROUP").replace(
    "FROM inventory WHERE product_code", "FROM inventory WHERE branch_code = 'EUROPE' AND product_code") + """
SELECT * FROM alerts ORDER BY priority, current_stock, product_code, branch_code LIMIT 10"""))
def _(spark, d):
    return alerts.inventory_alerts(fx.inventory(spark, d), fx.sales(spark, d), branch="EUROPE", as_of=AS_OF)


@register("alerts_by_severity", with_ctes("sales inventory", _alerts("sales") + f"""
SELECT * FROM alerts WHERE alert_status = '{S.ALERT_BANDS[2][3]}'
ORDER BY priority, current_stock, product_code, branch_code LIMIT 50"""))
def _(spark, d):
    return alerts.inventory_alerts(fx.inventory(spark, d), fx.sales(spark, d), limit=50, as_of=AS_OF,
                                   status=S.ALERT_BANDS[2][3])


@register("alert_summary", with_ctes("sales inventory", _alerts("sales") + "SELECT count(*) AS total_alerts, " + ", ".join(
    f"count(*) FILTER (alert_status = '{lab}') AS {lv}" for lv, _a, _b, lab, _c, _d in S.ALERT_BANDS) + " FROM alerts"))
def _(spark, d):
    return alerts.alert_summary(alerts.inventory_alerts(fx.inventory(spark, d), fx.sales(spark, d), limit=None))


@register("alert_levels", with_ctes("inventory", f"""
SELECT product_code, branch_code, greatest(Last_on_hand, 0) AS stock, coalesce(level, 'none') AS level,
       label AS alert_status, style AS status_class, coalesce(priority, 0) AS priority
FROM inventory LEFT JOIN {_BANDS} ON greatest(Last_on_hand, 0) BETWEEN lo AND hi"""))
def _(spark, d):
    return alerts.alert_levels(fx.inventory(spark, d))
