"""A spread of registered queries against DuckDB on the smallest tables; ALL_QUERIES=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
SPREAD = ["inventory_analysis", "inventory_analysis_window", "active_sales", "activity_filter_stats", "referential_diff",
          "pareto_analysis", "inventory_alerts_all", "notifications", "dashboard_kpis", "supplier_distribution",
          "transfer_proposals", "daily_features", "forecast_summary", "forecast_actions", "pii_classification",
          "pseudonymize", "query_intent", "repeat_hit_rate", "upload_stats", "user_export_stats", "concurrency_peaks",
          "alert_suppression", "stream_upload_stats", "report_findings", "retention_report"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SPREAD


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    problem, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 140


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(1).count() == 1
