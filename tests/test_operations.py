import datetime as dt
import math
import random
import time

from pyspark.sql import functions as F

from branchlight.operators import batches, monitor, oplog, versions
from branchlight.session import staged
from branchlight.streaming import alerts as sa, operations as so
from branchlight.streaming.run import drain, drain_to_the_end, shared_folder

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def greedy(times, quiet):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + quiet:
            out.append(t)
    return out


def alert_log(spark):
    rnd = random.Random(9)
    data = [("hot", rnd.randint(0, 30_000)) for _ in range(900)] + [("rare", n * 4_000) for n in range(6)]
    return data, spark.createDataFrame([(k, at(s)) for k, s in data], "alert_type string, ts timestamp_ntz")


def test_suppression_equals_the_sequential_rule(spark):
    data, df = alert_log(spark)
    for rows in (1_000_000, 60, 7):
        got = monitor.suppress_repeat_alerts(df, 300, range_rows=rows).collect()
        assert len(got) == len(set(got))
        for kind in ("hot", "rare"):
            want = greedy([s for k, s in data if k == kind], 300)
            assert sorted(r.emitted_at for r in got if r.alert_type == kind) == [at(s) for s in want]
    assert monitor.suppress_repeat_alerts(df.filter("false"), 300).collect() == []


def test_one_type_with_all_alerts_is_spread(spark, monkeypatch):
    """Ranges are cut by rows: no task takes a type whole, also where a range is shorter than the quiet time."""
    written = []
    monkeypatch.setattr(monitor, "staged", lambda df: (written.append(staged(df)), written[-1])[1])
    df = spark.range(4_000).select(F.lit("hot").alias("alert_type"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = monitor.suppress_repeat_alerts(df, 300, range_rows=200).collect()
    assert len(got) == math.ceil(4_000 / 300)
    links = next(w for w in written if "range" in w.columns)
    sizes = [r["count"] for r in links.groupBy("range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 500


def files(spark, df, parts):
    """The rows in time order as several files, so that a stream meets them in several triggers."""
    folder = shared_folder(spark, "input")
    for i, ids in enumerate(parts):
        df.filter(ids).coalesce(1).write.parquet(f"{folder}/f{i}")
    return folder


def by_time(df, column, cuts):
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        c = F.lit(True)
        if low is not None:
            c &= F.col(column) >= F.lit(at(low)).cast("timestamp_ntz")
        if high is not None:
            c &= F.col(column) < F.lit(at(high)).cast("timestamp_ntz")
        out.append(c)
    return out


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_streamed_suppression_equals_the_stored_one(spark):
    _, df = alert_log(spark)
    folder = files(spark, df, by_time(df, "ts", [9_000, 18_000]))
    got = drain_to_the_end(stream(spark, folder, df.schema), lambda rows: sa.stream_suppress_repeats(rows, 300), "ts")
    want = monitor.suppress_repeat_alerts(df, 300)
    assert sorted((r.alert_type, r.emitted_at.replace(tzinfo=None)) for r in got.select(
        "alert_type", F.col("emitted_at").cast("timestamp_ntz").alias("emitted_at")).collect()) == sorted(
        (r.alert_type, r.emitted_at) for r in want.collect())


def test_stuck_operations_on_both_sides(spark):
    starts = [(1, 0), (2, 100), (3, 200), (4, 5_000)]
    ends = [(1, 50), (2, 100 + 700), (4, 5_100)]
    later = [(9, 20_000), (9, 20_001)]
    s = spark.createDataFrame([(i, at(t)) for i, t in starts], "op_id long, started timestamp_ntz")
    e = spark.createDataFrame([(i, at(t)) for i, t in ends], "op_id long, finished timestamp_ntz")
    batch = monitor.stuck_operations(s, e, str(at(30_000)), 600)
    assert sorted(r.op_id for r in batch.collect()) == [2, 3]
    log = spark.createDataFrame([(i, "start", at(t)) for i, t in starts] + [(i, "finish", at(t)) for i, t in ends]
                                + [(i, "start" if n == 0 else "finish", at(t)) for n, (i, t) in enumerate(later)],
                                "op_id long, phase string, ts timestamp_ntz")
    folder = files(spark, log, by_time(log, "ts", [400, 10_000]))
    got = drain(so.stream_stuck_operations(stream(spark, folder, log.schema), 600))
    assert sorted(r.op_id for r in got.collect()) == [2, 3]


def test_stream_expiry_is_each_records_own(spark):
    df = spark.createDataFrame([("a", at(0)), ("a", at(10)), ("b", at(20))], "key string, ts timestamp_ntz")
    folder = files(spark, df, [F.lit(True)])
    got = drain(so.stream_expire(stream(spark, folder, df.schema), "1 hour", as_of=str(at(3605))))
    assert sorted((r.key, r.ts) for r in got.collect()) == [("a", at(10)), ("b", at(20))]


def test_upsert_stream_keeps_the_newest_version(spark):
    df = spark.createDataFrame([("a", at(0), 1), ("b", at(1), 2), ("a", at(50), 3)], "key string, ts timestamp_ntz, v int")
    folder = files(spark, df, by_time(df, "ts", [10]))
    target = shared_folder(spark, "table")
    so.upsert_stream(stream(spark, folder, df.schema), target, ["key"], "ts", shared_folder(spark, "state")).awaitTermination()
    assert sorted((r.key, r.v) for r in so.read_generation(spark, target, max(so.generations(spark, target))).collect()) == [("a", 3), ("b", 2)]


def test_versions(spark):
    up = spark.createDataFrame([(1, "u", "m", "N", "f", at(0), 5), (2, "u", "m", "N", "g", at(0), 6), (3, "u", "m", None, "h", at(9), 7)],
                               "doc_id long, username string, module string, branch_name string, original_filename string, "
                               "upload_timestamp timestamp_ntz, file_size long")
    assert [r.doc_id for r in versions.latest_upload_per_branch(up).collect()] == [2]
    assert [r.doc_id for r in versions.drop_branch(up, "u", "N").collect()] == [3]
    asked = spark.createDataFrame([("s", 1), ("i", 0), ("x", 77)], "data_type string, data_id long")
    assert {r.data_type: r.verdict for r in versions.check_ownership(asked, up, "v").collect()} == {
        "s": "denied", "i": "invalid", "x": "missing"}


def test_latency_uses_index_percentiles(spark):
    df = spark.createDataFrame([("op", i, at(i), float(i)) for i in range(150)],
                               "operation string, op_id long, started timestamp_ntz, duration_s double")
    r = oplog.latency_percentiles(df).first()
    assert (r.total_calls, r.min_duration, r.p50_duration, r.p95_duration, r.p99_duration) == (100, 50.0, 100.0, 145.0, 149.0)


def test_broken_log_lines_are_dropped(spark):
    lines = spark.createDataFrame([('{"timestamp": "2024-01-01T00:00:00", "event": "upload_start", "username": "u", "filename": "f", "file_size_mb": 4}',),
                                   ('{"timestamp": "2024-01-01T00:01:00", "event": "upload_success", "username": "u", "filename": "f", "processing_time_ms": 10}',),
                                   ('{"timestamp": "2024-',), ("not json",), ('{"event": "no time"}',)], "value string")
    log = oplog.parse_jsonl(lines)
    assert log.count() == 2
    r = oplog.upload_stats(log).first()
    assert (r.total_uploads, r.successful_uploads, r.success_rate, r.average_file_size_mb) == (1, 1, 100.0, 4.0)


def test_text_log(spark):
    lines = spark.createDataFrame([("2024-01-01 10:00:00,123 - app - ERROR - f:1 - x",), ("2024-01-01 09:00:00,000 - app - INFO - y",),
                                   ("  Traceback",)], "value string")
    got = oplog.recent_errors(lines, "2024-01-01 12:00:00", 24, 50).collect()
    assert [r.severity for r in got] == ["ERROR", "WARNING"]


def test_failing_chunks_are_reported(spark):
    df = spark.range(100).repartition(2)

    def work(chunk):
        if (chunk["id"] == 13).any():
            raise ValueError("bad luck")
        return len(chunk)

    exact = batches.map_batches(spark.range(0, 25_000, 1, 1), len, 20_000)
    assert sorted(r["items"] for r in exact.collect()) == [5_000, 20_000]
    ledger = batches.map_batches(df, work, 10)
    assert ledger.filter("NOT ok").first().error == "ValueError: bad luck"
    r = batches.batch_report(ledger).first()
    assert (r.total_items, r.processed_items, r.failed_items, r.success_rate) == (100, 90, 10, 90.0)
    assert [r.double for r in batches.map_rows(spark.range(3), lambda f: f.assign(double=f["id"] * 2), "id long, double long")
            .orderBy("id").collect()] == [0, 2, 4]


def test_an_end_read_before_its_start_counts(spark):
    folder = shared_folder(spark, "in")
    shape = "op_id long, phase string, ts string"
    for k, rows in enumerate(([(1, "finish", "2024-01-01 10:02:00")], [(1, "start", "2024-01-01 10:00:00"), (2, "start", "2024-01-01 10:00:00")],
                              [(3, "start", "2024-01-01 12:00:00")], [(4, "start", "2024-01-01 14:00:00")])):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    rows = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    late = drain(so.stream_stuck_operations(rows, 600)).collect()
    assert [r.op_id for r in late if r.op_id < 3] == [2]


def test_upsert_keeps_what_the_target_holds(spark):
    folder, target = shared_folder(spark, "in"), shared_folder(spark, "target")
    shape = "key string, v int, ts string"
    spark.createDataFrame([("old", 1, "2024-01-01"), ("a", 1, "2024-01-01")], shape).write.parquet(f"{target}/generation=0")
    spark.createDataFrame([("a", 2, "2024-01-02")], shape).write.parquet(folder)
    rows = lambda: spark.readStream.schema(shape).parquet(folder)
    for state in ("one", "one", "two"):
        so.upsert_stream(rows(), target, ["key"], "ts", f"{target}-{state}").awaitTermination()
        newest = so.read_generation(spark, target, max(so.generations(spark, target)))
        assert sorted((r.key, r.v) for r in newest.collect()) == [("a", 2), ("old", 1)]
    assert {r.v for r in so.read_generation(spark, target, 0).collect()} == {1}


def test_rate_over_a_minute_border(spark):
    at = ["2024-01-01 10:00:%02d" % s for s in range(50, 60)] + ["2024-01-01 10:01:05", "2024-01-01 10:01:11", "2024-01-01 10:02:05"]
    requests = spark.createDataFrame([("u", t) for t in at], "username string, ts string")
    got = monitor.rate_violations(requests, 10, 60).collect()
    # All twelve lie within a minute, on both sides of its border; the last one sees only one other.
    assert sorted((r.ts, r.requests) for r in got) == [("2024-01-01 10:01:05", 11), ("2024-01-01 10:01:11", 12)]
