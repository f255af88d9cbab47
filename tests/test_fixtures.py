"""How the driver's tables are dealt out before they grow."""

import pytest
from pyspark.sql import functions as F

from branchlight.plans import fixtures as fx


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, n = str(tmp_path_factory.mktemp("tables")), 400

    def put(name, ids, **columns):
        kinds = [c.rsplit(" ", 1) for c in fx.TABLE_SCHEMAS[name].split(", ")]
        rows = spark.range(ids).select(*[columns.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds])
        rows.coalesce(1).write.parquet(f"{d}/{name}.parquet")

    i = F.col("id")
    put("region", 2, r_regionkey=i, r_name=F.concat(F.lit("R"), i))
    put("nation", 2, n_nationkey=i, n_regionkey=i)
    put("customer", 10, c_custkey=i, c_nationkey=i % 2)
    put("supplier", 5, s_suppkey=i, s_name=F.concat(F.lit("S"), i))
    put("part", n, p_partkey=i, p_name=F.lit("n"), p_retailprice=F.lit(1.0))
    put("orders", n, o_orderkey=i, o_custkey=i % 10)
    put("lineitem", 3 * n, l_orderkey=i % n, l_partkey=i, l_quantity=F.lit(1.0), l_extendedprice=F.lit(2.0), l_discount=F.lit(0.5),
        l_shipdate=F.lit("2024-01-01"))
    return d


def per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_parts_are_dealt_out_before_they_unfold(spark, tables, monkeypatch):
    """F15, F19"""
    whole = sorted(map(str, fx.inventory(spark, tables).collect()))
    monkeypatch.setattr(fx, "PARTS_EACH", 20)
    dealt = fx.inventory(spark, tables)
    assert sorted(map(str, dealt.collect())) == whole and len(whole) == 800
    assert max(per_task(dealt)) <= 120


def test_lines_meet_their_orders_in_tasks_of_bounded_rows(spark, tables, monkeypatch):
    """F9, F15"""
    whole = sorted(map(str, fx.sales(spark, tables).collect()))
    monkeypatch.setattr(fx, "LINES_EACH", 60)
    dealt = fx.sales(spark, tables)
    assert sorted(map(str, dealt.collect())) == whole and len(whole) == 1200
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert max(per_task(dealt)) <= 180
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
