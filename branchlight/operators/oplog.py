"""Statistics over operation logs, metrics and exports. Cut-offs are counted back from an explicit ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_even, ratio
from ..schemas import UPLOAD_LOG_SCHEMA

UPLOAD_EVENTS = ("upload_start", "upload_success", "upload_failure")
SLOW_UPLOAD_MS, SLOW_QUERY_MS, LARGE_FILE_MB = 10_000, 1_000, 10
SLOW_OPERATION_S, HIGH_MEMORY_MB, SLOW_DATABASE_S = 5.0, 100.0, 5.0


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def hours_before(as_of: str, hours: int) -> Column:
    return moment(as_of) - F.make_dt_interval(hours=F.lit(hours))


# --- reading lines --------------------------------------------------------------------------------

def parse_jsonl(lines: DataFrame, as_of: str | None = None, hours: int | None = None, column: str = "value",
                schema: T.StructType = UPLOAD_LOG_SCHEMA) -> DataFrame:
    """JSON lines as typed rows; lines that are not JSON or carry no readable time are dropped."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    # Unfolded as a one-element array: later filters then act on the parsed row instead of parsing the line again.
    rows = lines.select(F.inline(F.array(parsed))).filter("_corrupt_record IS NULL").drop("_corrupt_record")
    rows = rows.withColumn("timestamp", F.col("timestamp").try_cast("timestamp_ntz")).filter("timestamp IS NOT NULL")
    return rows if hours is None else rows.filter(F.col("timestamp") >= hours_before(as_of, hours))


TEXT_STAMP = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),(\d{3}) - "


def parse_text_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``time - logger - LEVEL - ...`` lines with their time and severity; other lines are dropped."""
    line = F.trim(F.col(column))
    stamp = F.concat(F.regexp_extract(line, TEXT_STAMP, 1), F.lit("."), F.regexp_extract(line, TEXT_STAMP, 2))
    return lines.select(stamp.try_cast("timestamp_ntz").alias("timestamp"), line.alias("message"),
                        F.when(F.contains(line, F.lit("ERROR")), "ERROR").otherwise("WARNING").alias("severity")) \
        .filter("timestamp IS NOT NULL")


def recent_errors(lines: DataFrame, as_of: str, hours: int = 24, limit: int = 50, column: str = "value") -> DataFrame:
    return (parse_text_log(lines, column).filter(F.col("timestamp") >= hours_before(as_of, hours))
            .orderBy(F.desc("timestamp"), "message").limit(limit))


# --- uploads --------------------------------------------------------------------------------------

def pair_upload_events(log: DataFrame) -> DataFrame:
    """One row per (user, file) with the last start, success and failure event."""
    return _sessions(log.filter(F.col("event").isin(*UPLOAD_EVENTS)))


def _sessions(log: DataFrame, *extra: Column) -> DataFrame:
    def last(event: str, *fields: str) -> Column:
        cell = F.struct("timestamp", *fields)
        return F.max(F.when(F.col("event") == event, cell)).alias(event)

    sessions = log.groupBy("username", "filename").agg(
        last("upload_start", "file_size_mb"), last("upload_success", "processing_time_ms", "branch_name"),
        last("upload_failure", "error_type"), *extra)
    kept = [c for c in sessions.columns if c not in UPLOAD_EVENTS]
    return sessions.select(
        *kept, F.col("upload_start.timestamp").alias("started_at"),
        F.col("upload_start.file_size_mb").alias("file_size_mb"),
        F.col("upload_success.timestamp").alias("succeeded_at"),
        F.col("upload_success.processing_time_ms").alias("processing_time_ms"),
        F.col("upload_success.branch_name").alias("branch_name"),
        F.col("upload_failure.timestamp").alias("failed_at"), F.col("upload_failure.error_type").alias("error_type"))


def upload_stats(log: DataFrame) -> DataFrame:
    """Totals, success rate and averages over paired uploads, and the number of warning lines, in one pass."""
    upload = F.count_if(F.col("event").isin(*UPLOAD_EVENTS)).alias("_lines")
    warned = F.count_if(F.col("level") == "WARNING").alias("_warned")
    ok, bad = F.col("succeeded_at").isNotNull(), F.col("succeeded_at").isNull() & F.col("failed_at").isNotNull()

    def positive(c: str) -> Column:
        return F.sum(F.when(ok & (F.col(c) > 0), F.col(c)))

    wins = F.count_if(ok)
    n = F.count_if(F.col("_lines") > 0)
    return _sessions(log, upload, warned).agg(
        n.alias("total_uploads"), wins.alias("successful_uploads"),
        F.count_if(bad).alias("failed_uploads"),
        ratio(wins * 100, n, 0.0).alias("success_rate"),
        ratio(positive("file_size_mb"), wins, 0.0).alias("average_file_size_mb"),
        ratio(positive("processing_time_ms"), wins, 0.0).alias("average_processing_time_ms"),
        F.coalesce(F.sum("_warned"), F.lit(0)).alias("performance_warnings"))


def _uploads_by(log: DataFrame, column: str, kept: str) -> DataFrame:
    return pair_upload_events(log).filter(kept).groupBy(F.coalesce(column, F.lit("unknown")).alias(column)) \
        .agg(F.count(F.lit(1)).alias("uploads"))


def uploads_by_user(log: DataFrame) -> DataFrame:
    return _uploads_by(log, "username", "succeeded_at IS NOT NULL")


def uploads_by_branch(log: DataFrame) -> DataFrame:
    return _uploads_by(log, "branch_name", "succeeded_at IS NOT NULL")


def upload_errors_by_type(log: DataFrame) -> DataFrame:
    return _uploads_by(log, "error_type", "succeeded_at IS NULL AND failed_at IS NOT NULL")


def performance_trends(log: DataFrame) -> DataFrame:
    """Upload, query and file-size figures of performance lines, as one row."""
    up, db = F.col("event") == "upload_performance", F.col("event") == "database_performance"

    def of(kind: Column, c: str) -> Column:
        return F.when(kind & (F.col(c) > 0), F.col(c))

    t, q, s = of(up, "processing_time_ms"), of(db, "query_time_ms"), of(up, "file_size_mb")
    return log.agg(
        F.coalesce(F.avg(t), F.lit(0.0)).alias("average_processing_time_ms"),
        F.coalesce(F.max(t), F.lit(0.0)).alias("max_processing_time_ms"), F.min(t).alias("min_processing_time_ms"),
        F.count_if(t > SLOW_UPLOAD_MS).alias("slow_uploads_count"), F.count(t).alias("total_uploads"),
        F.coalesce(F.avg(q), F.lit(0.0)).alias("average_query_time_ms"),
        F.count_if(q > SLOW_QUERY_MS).alias("slow_queries_count"), F.count(q).alias("total_operations"),
        F.coalesce(F.avg(s), F.lit(0.0)).alias("average_file_size_mb"),
        F.count_if(s > LARGE_FILE_MB).alias("large_files_count"), F.count(s).alias("total_files"))


def hourly_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("timestamp").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def performance_advice(trends: DataFrame) -> DataFrame:
    """The rules that fire on a trends row, one row per piece of advice."""
    t, q, s = F.col("average_processing_time_ms"), F.col("average_query_time_ms"), F.col("average_file_size_mb")
    slow = F.col("slow_uploads_count") / F.nullif("total_uploads", F.lit(0))

    def ms(c: Column) -> Column:
        return half_even(c).cast("bigint").cast("string")

    rules = [
        (t > 5000, "performance", "warning",
         F.concat(F.lit("Average upload processing time is high ("), ms(t),
                  F.lit("ms). Consider optimizing Excel processing.")), "Investigate Excel processing bottlenecks"),
        (slow > 0.2, "performance", "warning",
         F.concat("slow_uploads_count", F.lit(" out of "), "total_uploads",
                  F.lit(" uploads were slow (>10s). Check for large files or system load.")),
         "Monitor system resources during peak usage"),
        (q > 500, "database", "warning",
         F.concat(F.lit("Average database query time is high ("), ms(q), F.lit("ms). Consider database optimization.")),
         "Review database indexes and query optimization"),
        (s > 15, "storage", "info",
         F.concat(F.lit("Average file size is large ("), F.format_number(half_even(s, 1), 1),
                  F.lit("MB). Monitor storage usage.")), "Consider implementing file size limits or compression")]
    cells = [F.when(c, F.struct(F.lit(k).alias("type"), F.lit(v).alias("severity"), m.alias("message"),
                                F.lit(a).alias("action"))) for c, k, v, m, a in rules]
    return trends.select(F.explode(F.filter(F.array(*cells), lambda r: r.isNotNull())).alias("_r")).select("_r.*")


def throughput(log: DataFrame) -> DataFrame:
    """Records per second and level of database lines, level of upload lines."""
    total_s = (F.coalesce("query_time_ms", F.lit(0.0)) + F.coalesce("transaction_time_ms", F.lit(0.0))) / 1000
    heavy = (F.col("file_size_mb") > LARGE_FILE_MB) & (F.col("processing_time_ms") > SLOW_UPLOAD_MS)
    db = F.col("event") == "database_performance"
    return log.filter(F.col("event").isin("database_performance", "upload_performance")).withColumns({
        "records_per_second": F.when(db, half_even(ratio(F.col("records_processed"), total_s, 0.0), 1)),
        "log_level": F.when(db & (total_s > SLOW_DATABASE_S), "WARNING")
        .when(~db & F.coalesce(heavy, F.lit(False)), "WARNING").otherwise("INFO")})


# --- operation metrics ----------------------------------------------------------------------------

def _recent(metrics: DataFrame, as_of: str, hours: int) -> DataFrame:
    return metrics.filter(F.col("started") >= hours_before(as_of, hours))


def operation_summary(metrics: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    n = F.count(F.lit(1))
    return _recent(metrics, as_of, hours).agg(
        n.alias("total_operations"), F.coalesce(F.avg("duration_s"), F.lit(0.0)).alias("average_duration"),
        ratio(F.count_if("success") * 100, n, 0.0).alias("success_rate"),
        F.count_if(F.col("duration_s") > SLOW_OPERATION_S).alias("slow_operations"),
        F.count_if(F.col("memory_mb") > HIGH_MEMORY_MB).alias("high_memory_operations"))


def operation_by_type(metrics: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    n = F.count(F.lit(1))
    return _recent(metrics, as_of, hours).groupBy("operation").agg(
        n.alias("count"), F.avg("duration_s").alias("average_duration"),
        ratio(F.count_if("success") * 100, n, 0.0).alias("success_rate"), F.sum("data_size").alias("total_data_size"))


def latest_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows per key. Spark keeps only ``n`` rows per key and task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")


def latency_percentiles(metrics: DataFrame, last_n: int = 100) -> DataFrame:
    """Exact figures over the last calls of every operation; percentile p is element ``int(n * p)`` of the sorted calls."""
    calls = latest_rows(metrics, ["operation"], ["started", "op_id"], last_n)
    per = calls.groupBy("operation").agg(
        F.sort_array(F.collect_list("duration_s")).alias("_d"), F.count("duration_s").alias("total_calls"),
        F.avg("duration_s").alias("avg_duration"), F.min("duration_s").alias("min_duration"),
        F.max("duration_s").alias("max_duration"), F.max("started").alias("last_call"))

    def at(p: float) -> Column:
        return F.element_at("_d", (F.floor(F.col("total_calls") * p) + 1).cast("int"))

    return per.withColumns({"p50_duration": at(0.5), "p95_duration": at(0.95), "p99_duration": at(0.99)}).drop("_d")


def query_log_stats(queries: DataFrame, cache: DataFrame, metrics: DataFrame, as_of: str) -> DataFrame:
    """Totals and last-day counts of queries and metrics, mean query time, active cache entries."""
    day = hours_before(as_of, 24)
    q = queries.agg(F.count(F.lit(1)).alias("total_queries"), F.count_if(F.col("ts") > day).alias("queries_last_24h"),
                    F.coalesce(half_even(F.avg("duration_s"), 3), F.lit(0.0)).alias("avg_processing_time"))
    c = cache.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expires_at") > moment(as_of)).alias("live")))
    m = metrics.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col("started") > day).alias("day")))
    rows = q.withColumns({"_c": c.scalar(), "_m": m.scalar()})
    return rows.select("total_queries", "queries_last_24h", "avg_processing_time",
                       F.col("_c.n").alias("cache_entries"), F.col("_c.live").alias("active_cache_entries"),
                       F.col("_m.n").alias("performance_metrics"), F.col("_m.day").alias("metrics_last_24h"))


# --- exports --------------------------------------------------------------------------------------

def _known(ops: DataFrame, as_of: str) -> DataFrame:
    """The state of every operation at ``as_of``: not started ones unseen, later ends unknown."""
    now = moment(as_of)
    return ops.filter(F.col("started") <= now).withColumn(
        "finished", F.when(F.col("finished") <= now, F.col("finished")))


def user_export_stats(ops: DataFrame, as_of: str, hours: int = 24, errors: int = 5) -> DataFrame:
    """Per user: active and completed operations, averages over successes, counts per format, last errors."""
    seen = _known(ops, as_of)
    done = F.col("finished") > hours_before(as_of, hours)
    ok = done & F.col("success")

    def mean_ok(c: str) -> Column:
        return F.coalesce(F.avg(F.when(ok, F.col(c))), F.lit(0.0))

    total = F.count_if(done)
    stats = seen.groupBy("username").agg(
        F.count_if(F.col("finished").isNull()).alias("active_operations"), total.alias("total_operations"),
        F.count_if(ok).alias("successful_operations"), F.count_if(done & ~F.col("success")).alias("failed_operations"),
        ratio(F.count_if(ok), total, 1.0).alias("success_rate"), mean_ok("duration_s").alias("average_duration_seconds"),
        mean_ok("memory_mb").alias("average_memory_mb"),
        F.coalesce(F.sum(F.when(ok, F.col("file_size_bytes"))), F.lit(0)).alias("total_file_size_bytes"))
    finished = seen.filter(done)
    formats = finished.groupBy("username", "format").agg(F.count(F.lit(1)).alias("_n")).groupBy("username").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("format", "_n")))).alias("format_breakdown"))
    failed = latest_rows(finished.filter("NOT success AND error_message IS NOT NULL AND error_message <> ''"),
                         ["username"], ["finished", "op_id"], errors)
    recent = failed.groupBy("username").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("finished", "op_id", "error_message"))),
        lambda e: e["error_message"]).alias("recent_errors"))
    return stats.filter("active_operations > 0 OR total_operations > 0").join(formats, "username", "left") \
        .join(recent, "username", "left")


def export_status(ops: DataFrame, as_of: str) -> DataFrame:
    """Active operations in all and by type, and how the last hour's completed ones went."""
    seen = _known(ops, as_of)
    done, active = F.col("finished") > hours_before(as_of, 1), F.col("finished").isNull()
    per_type = seen.groupBy("operation").agg(
        F.count_if(active).alias("a"), F.count_if(done).alias("d"), F.count_if(done & F.col("success")).alias("s"),
        F.sum(F.when(done & F.col("success") & (F.col("duration_s") > 0), F.col("duration_s"))).alias("t"),
        F.count_if(done & F.col("success") & (F.col("duration_s") > 0)).alias("tn"))
    by_type = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("a") > 0, F.struct("operation", "a")))))
    return per_type.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("active_count"), by_type.alias("active_by_type"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("recent_completed_count"),
        ratio(F.sum("s"), F.sum("d"), 1.0).alias("success_rate"),
        ratio(F.sum("t"), F.sum("tn"), 0.0).alias("average_duration_seconds"))


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Named fields of a JSON text column as typed columns; unreadable JSON yields nulls."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    rows = df.withColumn("_j", F.from_json(column, schema))
    return rows.withColumns({n: F.col(f"_j.{n}").try_cast(kind) for n, kind in fields.items()}).drop("_j")


def history(log: DataFrame, where: dict[str, str], order: list[str], n: int = 50) -> DataFrame:
    """The newest ``n`` rows that match, e.g. one user's queries or one metric's values."""
    for column, value in where.items():
        log = log.filter(F.col(column) == value)
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)
