import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from branchlight.functions import stock as S
from branchlight.functions.numeric import half_even
from branchlight.operators import activity, alerts, clean, inventory as inv
from branchlight.params import AnalysisParams, check_date_range, check_limit

from conftest import rows

INV = "product_code string, product_name string, Last_on_hand long, branch_code string"
SALES = "product_code string, quantity_sold double, sale_date date, branch_code string, revenue decimal(18,4)"
DAY = dt.date(2024, 1, 1)


def inventory(spark, *items):
    return spark.createDataFrame([(c, f"name {c}", s, b) for c, s, b in items], INV)


def sales(spark, *items):
    from decimal import Decimal
    return spark.createDataFrame([(c, float(q), d, "A", Decimal(q)) for c, q, d in items], SALES)


def test_rounding_is_half_to_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (-2.5,), (0.125,), (None,)], "x double")
    assert [r[0] for r in df.select(half_even(F.col("x"))).collect()] == [2.0, 4.0, -2.0, 0.0, None]
    assert [r[0] for r in df.select(half_even(F.col("x"), 2)).collect()][3] == 0.12


def test_four_products(spark):
    i = inventory(spark, ("P1", 20, "A"), ("P2", 0, "A"), ("P3", 0, "A"), ("P4", 15, "A"))
    s = sales(spark, ("P1", 10, DAY), ("P2", 0, DAY), ("P3", 5, DAY), ("P4", 2, DAY))
    got = {r.product_code: r for r in inv.analyze_inventory(s, i).collect()}
    assert set(got) == {"P1", "P3", "P4"}
    assert got["P1"].coverage_days == 2.0 and got["P1"].status == S.LOW_STOCK
    assert got["P3"].status == S.OUT_OF_STOCK and got["P3"].recommended_order == 150.0
    assert got["P4"].coverage_days == 7.5 and got["P4"].status == S.NORMAL
    assert got["P1"].abc_classification == "B" and got["P1"].recommendations == "إعادة طلب - يكفي 2 يوم"


def test_results_come_ordered_and_killed_rows_have_no_order(spark):
    i = inventory(spark, ("a", 5, "A"), ("b", 0, "A"), ("c", 9999, "A"), ("d", 40, "A"), ("e", 4, "A"), ("e", 90, "B"))
    s = sales(spark, ("a", 10, DAY), ("b", 1, DAY), ("d", 1, DAY), ("e", 2, DAY))
    got = inv.analyze_inventory(s, i).collect()
    keys = [(r.priority_score, r.coverage_days, r.product_code, r.branch_code) for r in got]
    assert keys == sorted(keys)
    for r in got:
        if r.Stock_Is_Sufficient or r.is_stagnant:
            assert r.expected_demand is None and r.recommended_order is None
    # rates are per product: both branches of "e" see the same sales
    assert {r.branch_code: r.daily_sales for r in got if r.product_code == "e"} == {"A": 2.0, "B": 2.0}


def test_missing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="product_code"):
        inv.analyze_inventory(spark.createDataFrame([(1,)], "wrong_column int"), inventory(spark, ("a", 1, "A")))


def test_optional_columns_default_to_dash(spark):
    r = inv.analyze_inventory(sales(spark, ("a", 1, DAY)), inventory(spark, ("a", 1, "A"))).first()
    assert (r.item_category1, r.item_category2, r.supplier_name) == ("-", "-", "-")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("pqrst"), st.integers(-2, 60), st.sampled_from("AB")), min_size=1,
                max_size=8, unique_by=lambda t: (t[0], t[2])),
       st.lists(st.tuples(st.sampled_from("pqrstu"), st.integers(0, 30), st.integers(0, 20)), max_size=8))
def test_analysis_invariants(spark, stock, sold):
    i = inventory(spark, *stock)
    s = sales(spark, *[(c, q, DAY + dt.timedelta(days=n)) for c, q, n in sold])
    got = inv.analyze_inventory(s, i).collect()
    top, active = {}, {c for c, q, _ in sold if q > 0}
    for c, n, _ in stock:
        top[c] = max(n, top.get(c, -math.inf))
    kept = [t for t in stock if not sold or top[t[0]] != 0 or t[0] in active]
    assert len(got) == len(kept)
    for r in got:
        assert r.status in S.STATUS_PRIORITY and r.priority_score == S.STATUS_PRIORITY[r.status]
        assert r.recommended_order is None or r.recommended_order >= 0
        total = sum(q for c, q, _ in sold if c == r.product_code)
        assert r.quantity_sold == total
        if total == 0:
            assert r.coverage_days == 9999


def test_inactive_rule(spark):
    i = inventory(spark, ("zero", 0, "A"), ("zero", 0, "B"), ("half", 0, "A"), ("half", 3, "B"), ("minus", -1, "A"),
                  ("sold", 0, "A"), (None, 0, "A"))
    s = sales(spark, ("sold", 1, DAY), ("zero", 0, DAY), ("orphan", 4, DAY))
    kept_s, kept_i = activity.drop_inactive(s, i)
    assert {r.product_code for r in kept_i.collect()} == {"half", "minus", "sold", None}
    assert {r.product_code for r in kept_s.collect()} == {"sold"}


def test_empty_tables_filter_nothing(spark):
    i, s = inventory(spark, ("zero", 0, "A")), sales(spark, ("x", 0, DAY))
    assert activity.drop_inactive_inventory(s.limit(0), i).count() == 1
    assert activity.drop_inactive_sales(s, i.limit(0)).count() == 1
    assert inv.analyze_inventory(s.limit(0), i).count() == 1


def test_sales_without_quantity_column_count_as_activity(spark):
    i = inventory(spark, ("a", 0, "A"), ("b", 0, "A"))
    s = spark.createDataFrame([("a", "x")], "product_code string, note string")
    assert [r.product_code for r in activity.inactive_products(s, i).collect()] == ["b"]


def test_referential_diff_and_stats(spark):
    i = inventory(spark, ("a", 0, "A"), ("b", 5, "A"))
    s = sales(spark, ("b", 1, DAY), ("ghost", 1, DAY))
    kept_s, kept_i = activity.drop_inactive(s, i)
    assert rows(activity.referential_diff(s, i, kept_s, kept_i)) == [
        ("a", "removed_inventory_product"), ("ghost", "removed_sales_product")]
    r = activity.activity_filter_stats(s, i).first()
    assert (r.items_filtered, r.total_items_before, r.total_items_after) == (1, 2, 1)
    assert (r.sales_records_before, r.sales_records_after, r.filtering_percentage) == (2, 1, 50.0)
    assert r.severity == "WARNING"


def test_pareto_ties_and_products_without_sales(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 30.0), ("c", 15.0), ("d", 5.0), ("e", 0.0), ("f", None)],
                               "product_code string, quantity_sold double")
    got = {r.product_code: r.abc_classification for r in inv.pareto_abc(df).collect()}
    assert got == {"a": "A", "b": "A", "c": "B", "d": "C", "e": "C", "f": "C"}


def test_alert_bands_names_and_limit(spark):
    edges = [("n", -3), ("z", 0), ("o", 1), ("v", 5), ("l", 6), ("m", 15), ("r", 16), ("s", 25), ("t", 26)]
    i = spark.createDataFrame([(c, "x" * 31 if c == "z" else "", n, "A") for c, n in edges], INV)
    s = sales(spark, *[(c, 1, DAY) for c, _ in edges])
    got = alerts.inventory_alerts(i, s, limit=1000).collect()
    assert [(r.product_code, r.priority) for r in got] == [
        ("n", 1), ("z", 1), ("o", 2), ("v", 2), ("l", 3), ("m", 3), ("r", 4), ("s", 4)]
    assert got[1].product_name == "x" * 27 + "..." and got[0].product_name == S.NO_NAME
    assert alerts.inventory_alerts(i, s, limit=2).count() == 2
    summary = alerts.alert_summary(alerts.inventory_alerts(i, s, limit=None)).first()
    assert tuple(summary) == (8, 2, 2, 2, 2)
    with pytest.raises(ValueError):
        alerts.inventory_alerts(i, s, limit=0)


def test_dirty_stock_counts_as_none(spark):
    df = spark.createDataFrame([("12.9",), ("-4",), ("n/a",), (None,), ("NaN",)], "x string")
    assert [r[0] for r in df.select(S.clean_stock(F.col("x"))).collect()] == [12, 0, 0, 0, 0]


def test_standard_names_and_numbers(spark):
    df = spark.createDataFrame([("1", "x", "2024-01-01", "abc")], "`Item code` string, Location string, Date string, quantity string")
    out = clean.standardize(df, "sales")
    assert out.columns == ["product_code", "branch_code", "sale_date", "quantity_sold"]
    assert out.first().quantity_sold == 0.0
    stock = clean.standardize(spark.createDataFrame([("1", "7", "2.5")], "item_code string, quantity string, `Inventory_value/unit` string"), "inventory")
    assert tuple(stock.first()) == ("1", 7.0, 2.5) and stock.columns[2] == "inventory_value"


def test_table_check_and_dates(spark):
    df = spark.createDataFrame([("a", "2024-01-05", "3"), (None, "never", "x")], "product_code string, sale_date string, quantity_sold string")
    got = {r.column_name: r for r in clean.check_table(df, "sales").collect()}
    assert not got["price"].is_present and got["product_code"].null_count == 1
    assert got["sale_date"].unreadable_count == 1 and got["quantity_sold"].unreadable_count == 1
    kept = clean.filter_dates(df, "2024-01-05", "2024-01-05").collect()
    assert [r.product_code for r in kept] == ["a"]


def test_parameters_are_checked():
    for bad in ({"min_coverage": 0}, {"forecast_days": 366}, {"min_coverage": 30, "max_coverage": 30}, {"safety_stock": -1},
                {"min_coverage": 2.5}):
        with pytest.raises(ValueError):
            AnalysisParams(**bad)
    with pytest.raises(ValueError):
        check_date_range("2024-02-01", "2024-01-01")
    assert check_limit(1000) == 1000
