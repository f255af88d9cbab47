"""Privacy operators over tables of text, and privacy, consent and retention reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import privacy as P
from ..functions import questions as Q
from .scan import running


def pii_counts(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in P.pattern_counts(F.col(column)).items()])


def classify_sensitivity(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    counts = pii_counts(df, column, keep)
    verdict = P.sensitivity({n: F.col(n) for n, _, _, _ in P.PATTERNS})
    return counts.select(*keep, *[c.alias(n) for n, c in verdict.items()])


def _text_values(field: T.StructField, c: Column) -> Column | None:
    """All text inside a column as an array, through arrays, maps and structs."""
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return F.array(c)
    if isinstance(kind, T.ArrayType):
        item = T.StructField("item", kind.elementType)
        if isinstance(kind.elementType, T.StringType):
            return c
        if _text_values(item, F.lit(None)) is None:
            return None
        return F.flatten(F.transform(c, lambda x: _text_values(item, x)))
    if isinstance(kind, T.MapType):
        return _text_values(T.StructField("values", T.ArrayType(kind.valueType)), F.map_values(c))
    if isinstance(kind, T.StructType):
        parts = [_text_values(f, c[f.name]) for f in kind.fields]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    return None


def _holds(kind: str, pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(P.worth_trying(kind, text) & text.rlike(P.any_case(pattern)), F.lit(False))


def classify_record(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Verdict over every text inside the named columns of a row, nested ones included.

    ``detected_patterns`` counts (text, pattern) finds, as if the finds of all parts were listed together."""
    parts = [_text_values(df.schema[c], F.col(c)) for c in columns]
    rows = df.select(*keep, F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts
                                       if p is not None]).alias("_texts"))
    hits = {n: F.size(F.filter("_texts", _holds(n, p))) for n, p, _, _ in P.PATTERNS}
    rows = rows.select(*keep, *[c.alias(n) for n, c in hits.items()])
    names = [n for n, _, _, _ in P.PATTERNS]
    verdict = P.sensitivity({n: F.col(n) for n in names})
    verdict["detected_patterns"] = sum((F.col(n) for n in names), F.lit(0))
    return rows.select(*keep, *[c.alias(n) for n, c in verdict.items()])


def mask_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, P.masked(F.col(column)))


def _steps(df: DataFrame, column: str) -> DataFrame:
    """The text after each pattern's replacement, with the finds of every pattern beside it.

    One projection per pattern: each step reads the text of the step before, so it is worked out once."""
    rows = df.withColumn("_text", F.col(column))
    for kind, pattern, _, _ in P.PATTERNS:
        rows = rows.withColumn(f"_f_{kind}", P.matches(kind, pattern, F.col("_text")))
        rows = rows.withColumn("_text", P.replaced(kind, F.col(f"_f_{kind}"), F.col("_text")))
    return rows


def pseudonymize(df: DataFrame, column: str) -> DataFrame:
    steps = _steps(df, column)
    return steps.withColumn(column, F.col("_text")).select(*df.columns)


def _entry(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(kind).alias("pattern"), F.sha2(m, 256).alias("original_digest"),
                              P.pseudonym(kind, m).alias("pseudonym"))


def pseudonym_map(df: DataFrame, column: str) -> DataFrame:
    """Distinct (pattern, digest of the original, pseudonym); the originals themselves are not kept."""
    steps = _steps(df, column)
    cells = F.concat(*[F.transform(f"_f_{kind}", _entry(kind)) for kind, _, _, _ in P.PATTERNS])
    return steps.select(F.explode(cells).alias("_m")).select("_m.*").distinct()


def redact_columns(df: DataFrame) -> DataFrame:
    """Columns with a telling name are redacted whole, other text where it looks like personal data."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if P.name_is_sensitive(field.name):
            c = F.lit(P.REDACTED)
        elif isinstance(field.dataType, T.StringType):
            c = F.when(P.looks_personal(c), P.REDACTED).otherwise(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def record_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """SHA-256 of the row as JSON with sorted keys; nulls are written out."""
    names = sorted(columns or df.columns)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.withColumn("record_hash", F.sha2(body, 256))


# --- questions and prompts ------------------------------------------------------------------------

def query_intent(df: DataFrame, column: str) -> DataFrame:
    rows = df.withColumn("_i", Q.intent(F.col(column)))
    return rows.withColumns({"query_type": F.coalesce("_i.intent", F.lit(Q.GENERAL)),
                             "confidence": F.coalesce("_i.score", F.lit(0.0))}).drop("_i")


def query_parameters(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(Q.parameters(F.col(column)))


def prompt_cost(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Estimated cost per group, from whole character counts so that the total does not depend on row order."""
    total = F.sum(F.length(column)) / 4 * Q.INPUT_PRICE + F.count(F.lit(1)) * (Q.RESPONSE_LENGTH / 4 * Q.OUTPUT_PRICE)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("prompts"), total.alias("estimated_cost"))


def prompt_cacheable(df: DataFrame, column: str) -> DataFrame:
    reason = Q.cache_reason(F.col(column))
    return df.withColumn("reason", reason).withColumn("is_cacheable", F.col("reason") == Q.REASON_FINE)


def repeat_hits(log: DataFrame, keys: Sequence[str], ttl_seconds: int, ts: str = "ts", tie: str = "query_id") -> DataFrame:
    """Each access with the gap to the previous one of its key and whether a cache of that age would have served it."""
    rows = running(log.dropna(subset=[*keys, ts]), [ts, tie], keys, previous={"_before": F.col(ts)})
    gap = F.timestamp_diff("MICROSECOND", F.col("_before"), F.col(ts))
    return rows.withColumn("is_hit", F.coalesce(gap <= ttl_seconds * 1_000_000, F.lit(False))).drop("_before")


def repeat_hit_rate(log: DataFrame, keys: Sequence[str], ttl_seconds: int = 86_400, ts: str = "ts",
                    tie: str = "query_id") -> DataFrame:
    rows = repeat_hits(log, keys, ttl_seconds, ts, tie)
    return rows.agg(F.count_if("is_hit").alias("hits"), F.count_if(~F.col("is_hit")).alias("misses"),
                    (F.count_if("is_hit") / F.count(F.lit(1)) * 100).alias("hit_rate"))


# --- consent, processing and retention ------------------------------------------------------------

def consent_valid(requests: DataFrame, consents: DataFrame, as_of: str) -> DataFrame:
    """Requests (user, data type) with a flag: some active, unexpired consent of the user lists the type."""
    now = F.lit(as_of).cast("timestamp_ntz")
    live = consents.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    granted = live.select(F.col("username").alias("_u"), F.explode("data_types").alias("_t")).distinct()
    hit = (F.col("username") == F.col("_u")) & (F.col("data_type") == F.col("_t"))
    return requests.join(granted, hit, "left").withColumn("consent_valid", F.col("_u").isNotNull()).drop("_u", "_t")


def _between(column: str, start: str, end: str) -> Column:
    return F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def processing_report(log: DataFrame, start: str, end: str) -> DataFrame:
    return log.filter(_between("processed_at", start, end)).groupBy("operation_type", "data_classification").agg(
        F.count(F.lit(1)).alias("total_operations"), F.count_if("anonymization_applied").alias("anonymized_operations"),
        F.count_if("consent_verified").alias("consent_verified_operations"))


def classification_report(classified: DataFrame) -> DataFrame:
    return classified.groupBy("classification", "privacy_level").agg(F.count(F.lit(1)).alias("count"))


def consent_report(consents: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return consents.filter(_between("granted_at", start, end)).groupBy("consent_type").agg(
        F.count(F.lit(1)).alias("active_consents"), F.count_if(F.col("expires_at") < now).alias("expired_consents"))


@dataclass(frozen=True)
class RetentionPolicy:
    data_type: str
    retention_days: int
    auto_delete: bool = True
    archive_before_delete: bool = False


# The default policies.
DEFAULT_POLICIES = [
    RetentionPolicy("ai_audit_log", 365, True, True), RetentionPolicy("ai_cache", 30, True, False),
    RetentionPolicy("query_history", 90, True, True), RetentionPolicy("performance_metrics", 180, True, False),
    RetentionPolicy("anonymization_mapping", 7, True, False), RetentionPolicy("data_classification", 30, True, False),
    RetentionPolicy("user_consent", 2555, False, True)]


def expired(df: DataFrame, policy: RetentionPolicy, as_of: str, ts: str) -> Column:
    """A row's own expiry decides where the table has one, else its timestamp plus the policy's days."""
    now = F.lit(as_of).cast("timestamp_ntz")
    if "expires_at" in df.columns:
        return F.coalesce(F.col("expires_at") < now, F.lit(False))
    return F.coalesce(F.col(ts) < now - F.make_dt_interval(F.lit(policy.retention_days)), F.lit(False))


def purge_expired(df: DataFrame, policy: RetentionPolicy, as_of: str, ts: str = "ts") -> DataFrame:
    """Rows that stay; a policy without automatic deletion keeps everything."""
    return df if not policy.auto_delete else df.filter(~expired(df, policy, as_of, ts))


def purge_table(spark: SparkSession, path: str, policy: RetentionPolicy, as_of: str, archive: str, ts: str = "ts",
                month: str = "month") -> None:
    """Delete what ``purge_expired`` drops from a stored table (``sources.tables``) that is partitioned by ``month`` (yyyy-MM of
    ``ts``), and remove it from the disk.

    Months before the one in which the policy's time ends are dropped unread and later ones left alone; only the month in
    between is written anew. Where the policy says so, the rows go to ``archive`` first. A policy without automatic
    deletion changes nothing. Rows with an expiry of their own are looked for in every month."""
    from ..sources import tables

    if not policy.auto_delete:
        return
    end = (datetime.fromisoformat(as_of) - timedelta(days=policy.retention_days)).strftime("%Y-%m")
    rows = tables.read(spark, path, tables.version(spark, path))

    def whole(values: dict) -> bool | None:
        if "expires_at" in rows.columns or values[month] == end:
            return None
        return values[month] is not None and values[month] < end

    tables.delete_rows(spark, path, expired(rows, policy, as_of, ts), whole, archive if policy.archive_before_delete else None)
    tables.vacuum(spark, path)


def retention_report(tables: Mapping[str, DataFrame], policies: Sequence[RetentionPolicy], as_of: str,
                     ts: str = "ts") -> DataFrame:
    """Total and expired rows per policy; a policy without a table reports none."""
    out = None
    for p in policies:
        head = [F.lit(p.data_type).alias("data_type"), F.lit(p.retention_days).alias("retention_days"),
                F.lit(p.auto_delete).alias("auto_delete"), F.lit(p.archive_before_delete).alias("archive_before_delete")]
        df = tables.get(p.data_type)
        if df is None:
            some = next(iter(tables.values()))
            counts = some.limit(0).agg(F.count(F.lit(1)).alias("total_records"), F.count(F.lit(1)).alias("expired_records"))
        else:
            counts = df.agg(F.count(F.lit(1)).alias("total_records"),
                            F.count_if(expired(df, p, as_of, ts)).alias("expired_records"))
        part = counts.select(*head, "total_records", "expired_records")
        out = part if out is None else out.unionAll(part)
    return out
