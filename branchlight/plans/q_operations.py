"""Logs, metrics, exports, monitoring and streams over the driver's event table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..operators import batches, monitor, oplog, versions
from ..sources import tables
from ..streaming import alerts as s_alerts, concurrency as s_conc, operations as s_ops, ordered
from ..streaming.run import drain, drain_to_the_end, drain_windows, shared_folder
from . import fixtures as fx
from .fixtures import AS_OF, with_ctes
from .q_inventory import _BANDS
from .registry import he, register

# Log lines made from events: each type of event becomes one kind of line.
_KIND = {"view": "upload_start", "purchase": "upload_success", "error": "upload_failure",
         "click": "upload_performance", "signup": "database_performance"}
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_LOG = f""", log AS (SELECT event_id, ts AS timestamp,
  CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 40 THEN 'WARNING' ELSE 'INFO' END AS level,
  CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _KIND.items())} END AS event,
  'u' || user_id AS username, 'B' || ({_K} % 7) AS branch_name, 'file_' || ({_K} % 10) || '.csv' AS filename,
  CASE WHEN event_type IN ('view', 'click') THEN CAST({_K} AS DOUBLE) / 4 END AS file_size_mb,
  CASE WHEN event_type IN ('purchase', 'click') THEN round(value * 300) END AS processing_time_ms,
  CASE WHEN event_type = 'signup' THEN round(value * 40) END AS query_time_ms,
  CASE WHEN event_type = 'signup' THEN round(value * 10) END AS transaction_time_ms,
  CASE WHEN event_type = 'signup' THEN {_K} * 100 END AS records_processed,
  CASE WHEN event_type = 'error' THEN 'type_' || ({_K} % 3) END AS error_type
  FROM events WHERE user_id % 25 <> 3)"""
# Lines of users 3, 28, 53 ... arrive cut short, which is what a reader of such logs has to live with.


def log_lines(spark, d):
    """Raw JSON lines, some of them broken."""
    kind, k, v = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint"), F.col("value")
    name = None
    for a, b in _KIND.items():
        name = F.when(kind == a, b) if name is None else name.when(kind == a, b)
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.when(kind == "error", "ERROR").when(v > 40, "WARNING").otherwise("INFO").alias("level"),
        name.alias("event"), F.concat(F.lit("u"), "user_id").alias("username"),
        F.concat(F.lit("B"), k % 7).alias("branch_name"), F.concat(F.lit("file_"), k % 10, F.lit(".csv")).alias("filename"),
        F.when(kind.isin("view", "click"), k / 4).alias("file_size_mb"),
        F.when(kind.isin("purchase", "click"), F.round(v * 300)).alias("processing_time_ms"),
        F.when(kind == "signup", F.round(v * 40)).alias("query_time_ms"),
        F.when(kind == "signup", F.round(v * 10)).alias("transaction_time_ms"),
        F.when(kind == "signup", k * 100).alias("records_processed"),
        F.when(kind == "error", F.concat(F.lit("type_"), k % 3)).alias("error_type")))
    return fx.raw(spark, d, "events").select(
        F.when(F.col("user_id") % 25 == 3, F.substring(line, 1, 30)).otherwise(line).alias("value"))


def log(spark, d, hours=None):
    return oplog.parse_jsonl(log_lines(spark, d), AS_OF, hours)


def _since(hours: int) -> str:
    return f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL {hours} HOUR"


def _events_only(body: str) -> str:
    return "WITH " + body.strip().lstrip(",").strip()


@register("log_scan", _events_only(_LOG + f"""
SELECT CAST(timestamp AS VARCHAR) AS timestamp, level, event, username, filename, file_size_mb, processing_time_ms, error_type
FROM log WHERE {_since(168)}"""))
def _(spark, d):
    return log(spark, d, 168).select("timestamp", "level", "event", "username", "filename", "file_size_mb",
                                     "processing_time_ms", "error_type")


def _text_lines(spark, d):
    e = fx.raw(spark, d, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(","), F.date_format("ts", "SSS"))
    line = F.concat(stamp, F.lit(" - app.uploads - "), F.when(F.col("event_type") == "error", "ERROR").otherwise("WARNING"),
                    F.lit(" - handle:"), F.col("event_id"), F.lit(" - user "), F.col("user_id"))
    return e.select(F.when(F.col("user_id") % 25 == 3, F.lit("  File \"x.py\", line 3")).otherwise(line).alias("value"))


@register("recent_errors", f"""
SELECT CAST(date_trunc('millisecond', ts) AS VARCHAR) AS timestamp,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || substr(strftime(ts, '%f'), 1, 3) || ' - app.uploads - ' ||
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARNING' END || ' - handle:' || event_id || ' - user ' || user_id AS message,
  CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'WARNING' END AS severity
FROM events WHERE user_id % 25 <> 3 AND date_trunc('millisecond', ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
ORDER BY 1 DESC, 2 LIMIT 50""")
def _(spark, d):
    return oplog.recent_errors(_text_lines(spark, d), AS_OF, 24, 50)


_PAIRED = _LOG + f""", paired AS (SELECT username, filename,
  max(timestamp) FILTER (event = 'upload_start') AS started_at, arg_max(file_size_mb, timestamp) FILTER (event = 'upload_start') AS file_size_mb,
  max(timestamp) FILTER (event = 'upload_success') AS succeeded_at,
  arg_max(processing_time_ms, timestamp) FILTER (event = 'upload_success') AS processing_time_ms,
  arg_max(branch_name, timestamp) FILTER (event = 'upload_success') AS branch_name,
  max(timestamp) FILTER (event = 'upload_failure') AS failed_at, arg_max(error_type, timestamp) FILTER (event = 'upload_failure') AS error_type
  FROM log WHERE {_since(168)} AND event IN ('upload_start', 'upload_success', 'upload_failure') GROUP BY 1, 2)"""


@register("upload_sessions", _events_only(_PAIRED + """
SELECT username, filename, CAST(started_at AS VARCHAR) AS started_at, file_size_mb, CAST(succeeded_at AS VARCHAR) AS succeeded_at,
  processing_time_ms, branch_name, CAST(failed_at AS VARCHAR) AS failed_at, error_type FROM paired"""))
def _(spark, d):
    return oplog.pair_upload_events(log(spark, d, 168))


_POS = "coalesce(sum(CASE WHEN succeeded_at IS NOT NULL AND {c} > 0 THEN {c} END) / count(succeeded_at), 0)"


@register("upload_stats", _events_only(_PAIRED + f"""
SELECT count(*) AS total_uploads, count(succeeded_at) AS successful_uploads,
  count(*) FILTER (succeeded_at IS NULL AND failed_at IS NOT NULL) AS failed_uploads,
  {he('count(succeeded_at) * 100 / count(*)', 6)} AS success_rate, {he(_POS.format(c='file_size_mb'), 6)} AS average_file_size_mb,
  {he(_POS.format(c='processing_time_ms'), 6)} AS average_processing_time_ms,
  (SELECT count(*) FROM log WHERE {_since(168)} AND level = 'WARNING') AS performance_warnings FROM paired"""))
def _(spark, d):
    out = oplog.upload_stats(log(spark, d, 168))
    return out.withColumns({c: half_even(F.col(c), 6) for c in (
        "success_rate", "average_file_size_mb", "average_processing_time_ms")})


for _name, _fn, _col, _where in (
        ("uploads_by_user", oplog.uploads_by_user, "username", "succeeded_at IS NOT NULL"),
        ("uploads_by_branch", oplog.uploads_by_branch, "branch_name", "succeeded_at IS NOT NULL"),
        ("upload_errors_by_type", oplog.upload_errors_by_type, "error_type", "succeeded_at IS NULL AND failed_at IS NOT NULL")):
    register(_name, _events_only(_PAIRED + f"""
SELECT coalesce({_col}, 'unknown') AS {_col}, count(*) AS uploads FROM paired WHERE {_where} GROUP BY 1"""))(
        lambda spark, d, fn=_fn: fn(log(spark, d, 168)))


def _only(kind: str, c: str) -> str:
    return f"CASE WHEN event = '{kind}' AND {c} > 0 THEN {c} END"


_T, _Q, _S = (_only("upload_performance", "processing_time_ms"), _only("database_performance", "query_time_ms"),
              _only("upload_performance", "file_size_mb"))
_TRENDS = _LOG + f""", trends AS (SELECT coalesce(avg({_T}), 0) AS average_processing_time_ms, coalesce(max({_T}), 0) AS max_processing_time_ms,
  min({_T}) AS min_processing_time_ms, count(*) FILTER ({_T} > 10000) AS slow_uploads_count, count({_T}) AS total_uploads,
  coalesce(avg({_Q}), 0) AS average_query_time_ms, count(*) FILTER ({_Q} > 1000) AS slow_queries_count, count({_Q}) AS total_operations,
  coalesce(avg({_S}), 0) AS average_file_size_mb, count(*) FILTER ({_S} > 10) AS large_files_count, count({_S}) AS total_files
  FROM log WHERE {_since(720)})"""


@register("performance_trends", _events_only(_TRENDS + f"""
SELECT * REPLACE ({', '.join(f"{he(c, 6)} AS {c}" for c in ('average_processing_time_ms', 'average_query_time_ms', 'average_file_size_mb'))}) FROM trends"""))
def _(spark, d):
    out = oplog.performance_trends(log(spark, d, 720))
    return out.withColumns({c: half_even(F.col(c), 6) for c in (
        "average_processing_time_ms", "average_query_time_ms", "average_file_size_mb")})


@register("hourly_distribution", _events_only(_LOG + f"""
SELECT CAST(hour(timestamp) AS INTEGER) AS hour, count(*) AS events FROM log WHERE {_since(168)} GROUP BY 1"""))
def _(spark, d):
    return oplog.hourly_distribution(log(spark, d, 168))


@register("performance_advice", _events_only(_TRENDS + f"""
SELECT 'performance' AS type, 'warning' AS severity, 'Average upload processing time is high (' || CAST({he('average_processing_time_ms')} AS BIGINT)
  || 'ms). Consider optimizing Excel processing.' AS message, 'Investigate Excel processing bottlenecks' AS action FROM trends WHERE average_processing_time_ms > 5000
UNION ALL SELECT 'performance', 'warning', slow_uploads_count || ' out of ' || total_uploads || ' uploads were slow (>10s). Check for large files or system load.',
  'Monitor system resources during peak usage' FROM trends WHERE total_uploads > 0 AND slow_uploads_count / total_uploads > 0.2
UNION ALL SELECT 'database', 'warning', 'Average database query time is high (' || CAST({he('average_query_time_ms')} AS BIGINT) || 'ms). Consider database optimization.',
  'Review database indexes and query optimization' FROM trends WHERE average_query_time_ms > 500
UNION ALL SELECT 'storage', 'info', 'Average file size is large (' || format('{{:.1f}}', {he('average_file_size_mb', 1)}) || 'MB). Monitor storage usage.',
  'Consider implementing file size limits or compression' FROM trends WHERE average_file_size_mb > 15"""))
def _(spark, d):
    return oplog.performance_advice(oplog.performance_trends(log(spark, d, 720)))


@register("log_throughput", _events_only(_LOG + f""", t AS (SELECT *, (coalesce(query_time_ms, 0) + coalesce(transaction_time_ms, 0)) / 1000 AS s FROM log)
SELECT CAST(timestamp AS VARCHAR) AS timestamp, username, event, CASE WHEN event = 'database_performance' THEN
    {he('CASE WHEN s > 0 THEN records_processed / s ELSE 0 END', 1)} END AS records_per_second,
  CASE WHEN event = 'database_performance' AND s > 5 THEN 'WARNING'
       WHEN event = 'upload_performance' AND file_size_mb > 10 AND processing_time_ms > 10000 THEN 'WARNING' ELSE 'INFO' END AS log_level
FROM t WHERE event IN ('database_performance', 'upload_performance')"""))
def _(spark, d):
    return oplog.throughput(log(spark, d)).select("timestamp", "username", "event", "records_per_second", "log_level")


@register("json_fields", f"SELECT event_id, {_K} AS k, TRY_CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events")
def _(spark, d):
    return oplog.json_fields(fx.raw(spark, d, "events").select("event_id", "props"), "props",
                             {"k": "bigint", "missing": "double"}).drop("props")


# --- metrics and exports --------------------------------------------------------------------------

def _metrics(spark, d):
    return fx.ops(spark, d).withColumns({"memory_mb": F.col("size_mb") * 2.0, "data_size": F.col("size_mb")})


_DAY = f"started >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR"


@register("operation_summary", with_ctes("ops", f"""
SELECT count(*) AS total_operations, {he('coalesce(avg(duration_s), 0)', 6)} AS average_duration,
  {he('count(*) FILTER (success) * 100 / count(*)', 6)} AS success_rate, count(*) FILTER (duration_s > 5) AS slow_operations,
  count(*) FILTER (size_mb * 2.0 > 100) AS high_memory_operations FROM ops WHERE {_DAY}"""))
def _(spark, d):
    return oplog.operation_summary(_metrics(spark, d), AS_OF).withColumns({
        c: half_even(F.col(c), 6) for c in ("average_duration", "success_rate")})


@register("operation_by_type", with_ctes("ops", f"""
SELECT operation, count(*) AS count, {he('avg(duration_s)', 6)} AS average_duration,
  {he('count(*) FILTER (success) * 100 / count(*)', 6)} AS success_rate, CAST(sum(size_mb) AS BIGINT) AS total_data_size
FROM ops WHERE {_DAY} GROUP BY 1"""))
def _(spark, d):
    return oplog.operation_by_type(_metrics(spark, d), AS_OF).withColumns({
        c: half_even(F.col(c), 6) for c in ("average_duration", "success_rate")})


@register("latency_percentiles", with_ctes("ops", f"""
, last100 AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY started DESC, op_id DESC) AS rn FROM ops),
l AS (SELECT operation, list(duration_s ORDER BY duration_s) AS x, count(*) AS n, avg(duration_s) AS a, max(started) AS m FROM last100 WHERE rn <= 100 GROUP BY 1)
SELECT operation, n AS total_calls, {he('a', 6)} AS avg_duration, x[1] AS min_duration, x[n] AS max_duration, CAST(m AS VARCHAR) AS last_call,
  x[CAST(1 + floor(n * 0.5) AS BIGINT)] AS p50_duration, x[CAST(1 + floor(n * 0.95) AS BIGINT)] AS p95_duration,
  x[CAST(1 + floor(n * 0.99) AS BIGINT)] AS p99_duration FROM l"""))
def _(spark, d):
    return oplog.latency_percentiles(_metrics(spark, d)).withColumn("avg_duration", half_even(F.col("avg_duration"), 6))


@register("query_log_stats", with_ctes("query_log ops uploads", f"""
SELECT (SELECT count(*) FROM query_log) AS total_queries,
  (SELECT count(*) FROM query_log WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS queries_last_24h,
  (SELECT {he('avg(duration_s)', 3)} FROM query_log) AS avg_processing_time, (SELECT count(*) FROM uploads) AS cache_entries,
  (SELECT count(*) FROM uploads WHERE upload_timestamp + INTERVAL 30 DAY > TIMESTAMP '{AS_OF}' + INTERVAL 20 DAY) AS active_cache_entries,
  (SELECT count(*) FROM ops) AS performance_metrics,
  (SELECT count(*) FROM ops WHERE started > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS metrics_last_24h"""))
def _(spark, d):
    cache = fx.uploads(spark, d).select(
        (F.col("upload_timestamp") + F.make_dt_interval(F.lit(10))).alias("expires_at"))
    return oplog.query_log_stats(fx.query_log(spark, d), cache, fx.ops(spark, d), AS_OF)


_NOW = "2024-01-30 22:15:00"
_EXPORTS = f""", ex AS (SELECT op_id, username, operation, started, CASE WHEN finished <= TIMESTAMP '{_NOW}' THEN finished END AS finished, duration_s,
   success, size_mb * 2.0::DOUBLE AS memory_mb, size_mb * 1024 AS file_size_bytes, CASE size_mb % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'xlsx' END AS format,
   CASE WHEN NOT success AND size_mb % 5 <> 0 THEN 'err_' || size_mb END AS error_message
  FROM ops WHERE started <= TIMESTAMP '{_NOW}'),
fin AS (SELECT * FROM ex WHERE finished > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR)"""


def exports(spark, d):
    k = F.col("size_mb")
    return fx.ops(spark, d).withColumns({
        "memory_mb": k * 2.0, "file_size_bytes": k * 1024,
        "format": F.when(k % 3 == 0, "csv").when(k % 3 == 1, "json").otherwise("xlsx"),
        "error_message": F.when(~F.col("success") & (k % 5 != 0), F.concat(F.lit("err_"), k))})


@register("user_export_stats", with_ctes("ops", _EXPORTS + f"""
, st AS (SELECT username, count(*) FILTER (finished IS NULL) AS active_operations,
   count(*) FILTER (finished > TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR) AS total_operations FROM ex GROUP BY 1),
ok AS (SELECT username, count(*) AS n, avg(duration_s) AS a, avg(memory_mb) AS m, sum(file_size_bytes) AS b FROM fin WHERE success GROUP BY 1),
fm AS (SELECT username, string_agg(format || '=' || n, ',' ORDER BY format) AS f FROM (SELECT username, format, count(*) AS n FROM fin GROUP BY 1, 2) GROUP BY 1),
er AS (SELECT username, string_agg(error_message, ' | ' ORDER BY finished, op_id) AS e FROM (SELECT *, row_number() OVER (PARTITION BY username ORDER BY finished DESC, op_id DESC) AS rn
   FROM fin WHERE NOT success AND error_message IS NOT NULL) WHERE rn <= 5 GROUP BY 1)
SELECT st.username, active_operations, total_operations, coalesce(n, 0) AS successful_operations, total_operations - coalesce(n, 0) AS failed_operations,
  {he('CASE WHEN total_operations > 0 THEN coalesce(n, 0) / total_operations ELSE 1 END', 6)} AS success_rate, {he('coalesce(a, 0)', 6)} AS average_duration_seconds,
  {he('coalesce(m, 0)', 6)} AS average_memory_mb, CAST(coalesce(b, 0) AS BIGINT) AS total_file_size_bytes, f AS format_breakdown, e AS recent_errors
FROM st LEFT JOIN ok ON ok.username = st.username LEFT JOIN fm ON fm.username = st.username LEFT JOIN er ON er.username = st.username
WHERE active_operations > 0 OR total_operations > 0"""))
def _(spark, d):
    out = oplog.user_export_stats(exports(spark, d), _NOW)
    return out.withColumns({
        **{c: half_even(F.col(c), 6) for c in ("success_rate", "average_duration_seconds", "average_memory_mb")},
        "format_breakdown": F.array_join(F.transform(F.map_entries("format_breakdown"), lambda e: F.concat(
            e["key"], F.lit("="), e["value"])), ",")})


@register("export_status", with_ctes("ops", _EXPORTS + f"""
, hr AS (SELECT * FROM ex WHERE finished > TIMESTAMP '{_NOW}' - INTERVAL 1 HOUR)
SELECT (SELECT count(*) FROM ex WHERE finished IS NULL) AS active_count,
  (SELECT string_agg(operation || '=' || n, ',' ORDER BY operation) FROM (SELECT operation, count(*) AS n FROM ex WHERE finished IS NULL GROUP BY 1)) AS active_by_type,
  (SELECT count(*) FROM hr) AS recent_completed_count, (SELECT {he('coalesce(count(*) FILTER (success) / nullif(count(*), 0), 1)', 6)} FROM hr) AS success_rate,
  (SELECT {he('coalesce(avg(duration_s), 0)', 6)} FROM hr WHERE success) AS average_duration_seconds"""))
def _(spark, d):
    out = oplog.export_status(exports(spark, d), _NOW)
    by_type = F.array_join(F.transform(F.map_entries("active_by_type"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), ",")
    return out.withColumns({"active_by_type": F.nullif(by_type, F.lit("")),
                            **{c: half_even(F.col(c), 6) for c in ("success_rate", "average_duration_seconds")}})


@register("query_history", with_ctes("query_log", """
SELECT query_id, CAST(ts AS VARCHAR) AS ts, query FROM query_log WHERE username = '17' ORDER BY ts DESC, query_id DESC LIMIT 50"""))
def _(spark, d):
    return oplog.history(fx.query_log(spark, d), {"username": "17"}, ["ts", "query_id"]).select("query_id", "ts", "query")


@register("metric_history", with_ctes("ops", """
SELECT op_id, CAST(started AS VARCHAR) AS started, duration_s FROM ops WHERE operation = 'view' ORDER BY started DESC, op_id DESC LIMIT 50"""))
def _(spark, d):
    return oplog.history(fx.ops(spark, d), {"operation": "view"}, ["started", "op_id"]).select("op_id", "started", "duration_s")


# --- monitoring -----------------------------------------------------------------------------------

_RATE = """
SELECT e.user_id::VARCHAR AS username, CAST(e.ts AS VARCHAR) AS ts, count(*) AS requests
FROM events e JOIN events p ON p.user_id = e.user_id AND p.ts > e.ts - INTERVAL 1 HOUR AND p.ts <= e.ts
GROUP BY e.event_id, e.user_id, e.ts HAVING count(*) > 2"""


@register("rate_violations", _RATE)
def _(spark, d):
    return monitor.rate_violations(fx.query_log(spark, d), 2, 3600)


@register("rate_windows", """
SELECT CAST(user_id AS VARCHAR) AS username, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start,
  CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS VARCHAR) AS window_end, count(*) AS requests
FROM events GROUP BY 1, 2, 3 HAVING count(*) > 2""")
def _(spark, d):
    return monitor.rate_windows(fx.query_log(spark, d), 2, "1 hour")


_PEAKS = with_ctes("ops", """
, e AS (SELECT started AS t, 1 AS step FROM ops UNION ALL SELECT finished, -1 FROM ops),
n AS (SELECT t, sum(step) AS step FROM e GROUP BY 1),
r AS (SELECT t, CAST(sum(step) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS active FROM n)
SELECT CAST(t AS VARCHAR) AS moment, active FROM r WHERE active >= 3""")


@register("concurrency_peaks", _PEAKS)
def _(spark, d):
    return monitor.concurrency_peaks(fx.ops(spark, d), 3)


@register("stuck_operations", with_ctes("ops", f"""
SELECT op_id, username, CAST(started AS VARCHAR) AS started, CAST(started + INTERVAL 300 SECOND AS VARCHAR) AS deadline
FROM ops WHERE NOT finished <= started + INTERVAL 300 SECOND AND started + INTERVAL 300 SECOND < TIMESTAMP '{AS_OF}'"""))
def _(spark, d):
    o = fx.ops(spark, d)
    return monitor.stuck_operations(o.select("op_id", "username", "started"), o.select("op_id", "finished"), AS_OF, 300)


@register("resource_alerts", """
SELECT event_id, m AS metric, value, CASE m WHEN 'cpu' THEN 'high_system_cpu' WHEN 'memory' THEN 'high_system_memory' ELSE 'high_disk_usage' END AS alert_type,
  90.0::DOUBLE AS threshold FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'cpu' WHEN 'purchase' THEN 'cpu' WHEN 'error' THEN 'disk' ELSE 'memory' END AS m, value FROM events)
WHERE m IS NOT NULL AND value > 90""")
def _(spark, d):
    kind = F.col("event_type")
    readings = fx.raw(spark, d, "events").select("event_id", F.when(kind.isin("view", "purchase"), "cpu").when(
        kind == "error", "disk").otherwise("memory").alias("metric"), "value")
    return monitor.resource_alerts(readings)


_SUPPRESSED = """
WITH RECURSIVE r AS (SELECT event_type, min(ts) AS ts FROM events GROUP BY 1
  UNION ALL SELECT r.event_type, min(e.ts) FROM r JOIN events e ON e.event_type = r.event_type AND e.ts >= r.ts + INTERVAL 5 MINUTE
  GROUP BY r.event_type, r.ts)
SELECT event_type AS alert_type, CAST(ts AS VARCHAR) AS emitted_at FROM r"""


@register("alert_suppression", _SUPPRESSED)
def _(spark, d):
    return monitor.suppress_repeat_alerts(fx.raw(spark, d, "events"), 300, kind="event_type")


# --- streams, drained -----------------------------------------------------------------------------

def _stream(spark, d, name):
    # One-file glob: the file source takes a folder or a pattern.
    return spark.readStream.schema(fx.TABLE_SCHEMAS[name]).parquet(f"{d.rstrip('/')}/{name[:-1]}[{name[-1]}].parquet")


@register("stream_stock_alerts", f"""
SELECT product_code, product_name, branch_code, stock AS current_stock, label AS alert_status, style AS status_class, priority, '{AS_OF}' AS last_updated
FROM (SELECT CAST(p_partkey AS VARCHAR) AS product_code, p_name AS product_name, 'HQ' AS branch_code, greatest(p_partkey * 37 % 97 - 2, 0) AS stock FROM part)
JOIN {_BANDS} ON stock BETWEEN lo AND hi""")
def _(spark, d):
    updates = _stream(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("product_code"), F.col("p_name").alias("product_name"),
        F.lit("HQ").alias("branch_code"), (F.col("p_partkey") * 37 % 97 - 2).alias("Last_on_hand"))
    return drain(s_alerts.stream_stock_alerts(updates, AS_OF))


@register("stream_upload_stats", f"""
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start, count(*) FILTER (event_type = 'purchase') AS successful,
  count(*) FILTER (event_type = 'error') AS failed, {he("avg(round(value * 300)) FILTER (event_type = 'purchase')", 4)} AS average_processing_time_ms
FROM events WHERE event_type IN ('purchase', 'error') GROUP BY date_trunc('hour', ts)""")
def _(spark, d):
    kind = F.col("event_type")
    rows = _stream(spark, d, "events").select(
        F.col("ts").alias("timestamp"), F.when(kind == "purchase", "upload_success").when(kind == "error", "upload_failure")
        .alias("event"), F.round(F.col("value") * 300).alias("processing_time_ms"))
    out = drain_windows(s_ops.stream_upload_stats(rows))
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"),
                            "average_processing_time_ms": half_even(F.col("average_processing_time_ms"), 4)})


@register("stream_rate_windows", """
SELECT CAST(user_id AS VARCHAR) AS username, CAST(date_trunc('hour', ts) AS VARCHAR) AS window_start,
  CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS VARCHAR) AS window_end, count(*) AS requests
FROM events GROUP BY user_id, date_trunc('hour', ts)
HAVING count(*) > 2""")
def _(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("username"), "ts")
    out = drain_windows(s_ops.stream_rate_windows(rows, 2, "1 hour", "1 hour"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@register("stream_rate_violations", _RATE)
def _(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("username"), "ts")
    out = drain_to_the_end(rows, lambda r: ordered.stream_rate_violations(r, 2, 3600, slot_seconds=60), "ts")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("stream_alert_suppression", _SUPPRESSED)
def _(spark, d):
    rows = _stream(spark, d, "events").select("event_type", "ts")
    out = drain_to_the_end(rows, lambda r: ordered.stream_suppress_repeats(r, 300, kind="event_type", slot_seconds=300), "ts")
    return out.withColumn("emitted_at", F.col("emitted_at").cast("timestamp_ntz"))


@register("stream_expirations", """
SELECT CAST(user_id AS VARCHAR) AS username, CAST(ts AS VARCHAR) AS ts, CAST(ts + INTERVAL 6 HOUR AS VARCHAR) AS expired_at
FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS renewed FROM (SELECT DISTINCT user_id, ts FROM events))
WHERE renewed IS NULL OR renewed > ts + INTERVAL 6 HOUR""")
def _(spark, d):
    rows = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("username"), "ts")
    out = drain_to_the_end(rows, lambda r: ordered.stream_expirations(r, ["username"], 6 * 3600), "ts")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "expired_at")})


@register("stream_concurrency_peaks", _PEAKS)
def _(spark, d):
    length = F.expr("make_dt_interval(0, 0, 0, cast(value as decimal(18,6)))")
    edges = _stream(spark, d, "events").select(F.explode(F.array(
        F.struct(F.col("ts").cast("timestamp").alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("ts") + length).cast("timestamp").alias("at"), F.lit(-1).alias("step")))).alias("e")).select("e.*")
    target = shared_folder(spark, "peaks")

    def run(rows, folder):
        s_conc.stream_concurrency_peaks(rows, target, f"{folder}/state", 3, slot="1 hour").awaitTermination()
        return s_conc.read_peaks(spark, target)

    out = drain_to_the_end(edges, lambda r: r, "at", run=run)
    return out.withColumn("moment", F.col("moment").cast("timestamp_ntz"))


# --- user functions -------------------------------------------------------------------------------

def _chunk_total(chunk):
    if (chunk["value"] > 400).any():
        raise ValueError("reading out of range")
    return round(float(chunk["value"].sum()), 2)


@register("map_batches_stats")
def _(spark, d):
    return batches.batch_report(batches.map_batches(fx.raw(spark, d, "events").select("event_id", "value"), _chunk_total, 50))


# --- versions -------------------------------------------------------------------------------------

_UP = "doc_id, username, branch_name, original_filename, CAST(upload_timestamp AS VARCHAR) AS upload_timestamp, file_size"


@register("latest_upload_per_branch", with_ctes("uploads", f"""
SELECT {_UP} FROM (SELECT *, row_number() OVER (PARTITION BY branch_name ORDER BY upload_timestamp DESC, doc_id DESC) AS rn FROM uploads) WHERE rn = 1"""))
def _(spark, d):
    return versions.latest_upload_per_branch(fx.uploads(spark, d)).drop("module")


@register("upload_history", with_ctes("uploads", """
SELECT doc_id, original_filename, CAST(upload_timestamp AS VARCHAR) AS upload_timestamp, file_size FROM uploads
WHERE username = '17' AND module = 'module_1' ORDER BY upload_timestamp DESC, doc_id DESC LIMIT 10"""))
def _(spark, d):
    return versions.upload_history(fx.uploads(spark, d), "17", "module_1", 10)


def _snaps(spark, d):
    return fx.raw(spark, d, "events").select(F.col("event_type").alias("branch_code"), F.date_trunc("day", "ts").cast(
        "timestamp_ntz").alias("snapshot_ts"), F.col("event_id").alias("row_id"), "value")


_SNAPS = "(SELECT event_type AS branch_code, CAST(date_trunc('day', ts) AS TIMESTAMP) AS snapshot_ts, event_id AS row_id, value FROM events)"


@register("branch_scan_latest", f"""
SELECT branch_code, CAST(snapshot_ts AS VARCHAR) AS snapshot_ts, row_id, value FROM {_SNAPS} s
WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM {_SNAPS} t WHERE t.branch_code = s.branch_code)""")
def _(spark, d):
    return versions.branch_scan(_snaps(spark, d))


@register("branch_scan_history", f"""
SELECT branch_code, CAST(snapshot_ts AS VARCHAR) AS snapshot_ts, row_id, value FROM {_SNAPS} WHERE branch_code = 'view'""")
def _(spark, d):
    return versions.branch_scan(_snaps(spark, d), "view", latest_only=False)


@register("union_branches", """
SELECT event_id, user_id, value, NULL AS event_type FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, user_id, NULL, event_type FROM events WHERE event_type <> 'view'""")
def _(spark, d):
    e = fx.raw(spark, d, "events")
    return versions.union_branches([e.filter("event_type = 'view'").select("event_id", "user_id", "value"),
                                    e.filter("event_type <> 'view'").select("event_id", "user_id", "event_type")])


_DELETED = with_ctes("uploads", f"""
SELECT {_UP} FROM uploads WHERE NOT (username = '17' AND branch_name = 'view')""")


@register("branch_deleted", _DELETED)
def _(spark, d):
    return versions.drop_branch(fx.uploads(spark, d), "17", "view").drop("module")


@register("branch_deleted_table", _DELETED)
def _(spark, d):
    path = shared_folder(spark, "uploads")
    uploads = fx.uploads(spark, d).drop("module")
    # Owners are many: buckets by their number of rows, not a folder for each owner and branch.
    tables.create(uploads, path, ["username"], buckets=max(16, math.ceil(uploads.count() / 500_000)))
    versions.delete_branch(spark, path, "17", "view")
    return tables.read(spark, path, tables.version(spark, path)).drop("_bucket")


@register("stream_upsert_latest", """
SELECT user_id, event_type, CAST(ts AS VARCHAR) AS ts, event_id, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    rows = _stream(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    target = shared_folder(spark, "latest")
    s_ops.upsert_stream(rows, target, ["user_id", "event_type"], "ts", f"{target}-state", buckets=16).awaitTermination()
    return s_ops.read_generation(spark, target, max(s_ops.generations(spark, target)))


@register("upsert_latest", """
WITH v AS (SELECT user_id, event_type, ts, event_id, value, CASE WHEN value > 50 THEN 1 ELSE 0 END AS side FROM events)
SELECT user_id, event_type, CAST(ts AS VARCHAR) AS ts, event_id, value FROM
  (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, side DESC) AS rn FROM v) WHERE rn = 1""")
def _(spark, d):
    e = fx.raw(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return versions.upsert(e.filter("value <= 50"), e.filter("value > 50"), ["user_id", "event_type"], "ts")


_REQ = "SELECT event_type AS data_type, CASE WHEN event_id % 11 = 0 THEN -event_id ELSE event_id * 2 END AS data_id FROM events"


@register("ownership_check", with_ctes("uploads", f"""
SELECT data_type, data_id, CASE WHEN data_id <= 0 THEN 'invalid' WHEN doc_id IS NULL THEN 'missing' WHEN username <> '17' THEN 'denied' ELSE 'ok' END AS verdict
FROM ({_REQ}) LEFT JOIN uploads ON doc_id = data_id"""))
def _(spark, d):
    i = F.col("event_id")
    asked = fx.raw(spark, d, "events").select(F.col("event_type").alias("data_type"),
                                              F.when(i % 11 == 0, -i).otherwise(i * 2).alias("data_id"))
    return versions.check_ownership(asked, fx.uploads(spark, d), "17")


@register("data_access_check", with_ctes("uploads", f"""
, known AS (SELECT DISTINCT username FROM uploads WHERE branch_name IS NOT NULL),
r AS (SELECT event_id AS request_id, CASE WHEN event_id % 13 = 0 THEN 'guest' ELSE CAST(user_id AS VARCHAR) END AS username,
  CASE event_type WHEN 'view' THEN ['inventory_data', 'sales_data'] WHEN 'click' THEN ['sales_data', 'payroll_data'] ELSE ['alert_data'] END AS requested FROM events)
SELECT request_id, r.username, array_to_string(requested, ' | ') AS requested, known.username IS NOT NULL AND
  len(list_filter(requested, lambda x: NOT list_contains([{', '.join(f"'{t}'" for t in versions.ALLOWED_DATA_TYPES)}], x))) = 0 AS allowed
FROM r LEFT JOIN known ON known.username = r.username"""))
def _(spark, d):
    kind = F.col("event_type")

    def types(*names):
        return F.array(*[F.lit(n) for n in names])

    asked = fx.raw(spark, d, "events").select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 13 == 0, "guest").otherwise(
            F.col("user_id").cast("string")).alias("username"),
        F.when(kind == "view", types("inventory_data", "sales_data")).when(kind == "click", types(
            "sales_data", "payroll_data")).otherwise(types("alert_data")).alias("requested"))
    return versions.data_access_check(asked, fx.uploads(spark, d)).select("request_id", "username", "requested", "allowed")
