import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from branchlight.operators import reports as rp
from branchlight.schemas import SALES_SCHEMA
from branchlight.sources import files, reports


def test_branch_uploads_from_partition_and_plain_folders(spark, tmp_path):
    for style in ("branch_code=", ""):
        for b in ("N", "S"):
            folder = tmp_path / (style or "plain") / f"{style}{b}"
            folder.mkdir(parents=True)
            (folder / "a.csv").write_text("product_code,sale_date,quantity_sold,revenue,discount\np,2024-01-01,2,3.5,0\n")
        got = files.read_branch_uploads(spark, str(tmp_path / (style or "plain")), "csv", SALES_SCHEMA)
        assert sorted((r.branch_code, r.quantity_sold) for r in got.collect()) == [("N", 2.0), ("S", 2.0)]
    with pytest.raises(ValueError):
        files.read_branch_uploads(spark, str(tmp_path), "xlsx")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
@pytest.mark.parametrize("style", ["branch_code=", ""])
def test_branch_uploads_without_a_schema(spark, tmp_path, fmt, style):
    for b in ("N 1", "S"):
        rows = spark.createDataFrame([("p", "2")], "product_code string, quantity string").coalesce(1)
        writer = rows.write.option("header", True) if fmt == "csv" else rows.write
        writer.format(fmt).save(str(tmp_path / "up" / f"{style}{b}"))
    got = files.read_branch_uploads(spark, str(tmp_path / "up"), fmt)
    assert sorted((r.branch_code, r.product_code, str(r.quantity)) for r in got.collect()) == [("N 1", "p", "2"), ("S", "p", "2")]


def test_snapshots_keep_versions_and_prune(spark, tmp_path):
    root = str(tmp_path / "store")
    for stamp, value in (("2024-01-01", 1), ("2024-01-02", 2)):
        df = spark.createDataFrame([("p", "N", value), ("p", "S", value)], "product_code string, branch_code string, v int")
        files.write_snapshot(df, root, "branch_data", "sales_df", stamp)
    files.write_snapshot(spark.createDataFrame([("p", 9)], "product_code string, v int"), root, "branch_data", "sales_df", "2024-01-03", "N")
    newest = files.read_snapshot(spark, root, "branch_data", "sales_df")
    assert sorted((r.branch_code, r.v) for r in newest.collect()) == [("N", 9), ("S", 2)]
    assert files.read_snapshot(spark, root, "branch_data", "sales_df", latest_only=False).count() == 5
    one = files.read_snapshot(spark, root, "branch_data", "sales_df", "S")
    assert [r.v for r in one.collect()] == [2]


def test_calendar(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("event_name,start_date,end_date\nFair,2024-01-01,2024-01-02\n")
    assert files.read_events_calendar(spark, str(path)).first().start_date.day == 1
    assert files.read_events_calendar(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "events.txt").write_text("x")
    with pytest.raises(ValueError):
        files.read_events_calendar(spark, str(tmp_path / "events.txt"))


def test_logs_from_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"timestamp": "2024-01-01T00:00:00", "event": "x"}\n{broken\n')
    assert files.read_jsonl_log(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "a.log").write_text("2024-01-01 10:00:00,123 - app - ERROR - boom\nplain\n")
    assert files.read_text_log(spark, str(tmp_path / "a.log")).first().severity == "ERROR"


def test_forecast_export_is_split(spark):
    back = {v: k for k, v in files.FORECAST_HEADERS.items()}
    df = spark.createDataFrame([("p", "2024-01-01", 3.0, None), ("p", "2024-01-02", None, 4.0)],
                               f"`{back['product_code']}` string, `{back['sale_date']}` string, `{back['quantity_sold']}` double, "
                               f"`{back['predicted_quantity_sold']}` double")
    past, ahead = files.read_forecast_export(df)
    assert past.count() == 1 and ahead.first().predicted_quantity_sold == 4.0


def fullest(pattern):
    """The part file that holds rows; empty partitions may leave files beside it."""
    return max(glob.glob(str(pattern)), key=os.path.getsize)


def test_csv_report(spark, tmp_path):
    df = spark.createDataFrame([("p", None, 1.5)], "product_code string, supplier_name string, daily_sales double")
    reports.write_report_csv(df, str(tmp_path / "out"))
    part = fullest(tmp_path / "out" / "part-*.csv")
    raw = open(part, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf")
    lines = raw.decode("utf-8-sig").splitlines()
    assert lines[0].split(",")[1] == reports.ARABIC_HEADERS["supplier_name"] and lines[1] == "p,,1.5"


def test_json_report(spark, tmp_path):
    df = spark.createDataFrame([("p", float("nan"))], "product_code string, v double")
    reports.write_report_json(df, str(tmp_path / "out"), "u", "inventory", "2024-01-01T00:00:00")
    meta = json.loads(open(fullest(tmp_path / "out/metadata/part-*.json")).read())
    assert meta["total_records"] == 1 and meta["columns"] == ["product_code", "v"]
    assert json.loads(open(fullest(tmp_path / "out/records/part-*.json")).readline()) == {"product_code": "p", "v": None}
    reports.write_report_tables({"main": df, "none": df.limit(0)}, str(tmp_path / "sheets"))
    assert spark.read.parquet(str(tmp_path / "sheets")).filter(F.col("report") == "main").count() == 1


def test_findings_and_reductions(spark):
    s = spark.createDataFrame([(1000.0,), (500.0,), (200.0,)], "revenue double").select(F.col("revenue").cast("decimal(18,4)"))
    i = spark.createDataFrame([("a", 50), ("b", 5), ("c", 0)], "product_code string, Last_on_hand long")
    m = rp.report_metrics(s, i).withColumn("data_quality_score", rp.data_quality_score(s, i).scalar())
    r = rp.report_findings(m).first()
    assert (r.total_products, r.low_stock_items, r.out_of_stock_items, r.total_revenue) == (3, 2, 1, 1700.0)
    assert r.patterns == [rp.PATTERN_HIGH_LOW] and r.confidence_score == 90
    assert rp.data_quality_score(s.limit(0), i).first()[0] == 80
    big = spark.createDataFrame([(n, n % 7) for n in range(50)], "id long, v long")
    first = rp.reduce_rows(big, 10, "sample", ["id"]).collect()
    assert first == rp.reduce_rows(big.repartition(3), 10, "sample", ["id"]).collect() and len(first) == 10
    assert rp.essential_columns(spark.createDataFrame([(1, 2)], "item_code int, x int")).columns == ["item_code"]
    out = rp.partial_export(i, 1, ["product_code"]).collect()
    assert [x.Last_on_hand for x in out] == ["50", rp.SUM_PREFIX + "55.00"]
