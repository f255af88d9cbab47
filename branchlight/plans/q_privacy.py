"""Text privacy, questions, prompts, consent and retention over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import privacy as PV, questions as Q
from ..functions.numeric import half_even
from ..operators import privacy as op
from ..sources import tables
from ..streaming.run import shared_folder
from . import fixtures as fx
from .fixtures import AS_OF, with_ctes
from .registry import he, register


def _texts(spark, d):
    return fx.raw(spark, d, "documents").select("doc_id", "text")


def _q(text: str) -> str:
    return text.replace("'", "''")


def _count(col: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({col}, '{_q(pattern)}', 0, 'i')) AS INTEGER)"


_COUNTS = ", ".join(f"{_count('text', p)} AS {n}" for n, p, _, _ in PV.PATTERNS)


@register("pii_counts", f"SELECT doc_id, {_COUNTS} FROM documents")
def _(spark, d):
    return op.pii_counts(_texts(spark, d), "text", ["doc_id"])


def _names(*kinds: str) -> str:
    return " OR ".join(f"{n} > 0" for n, _, k, _ in PV.PATTERNS if k in kinds)


def _verdict(number: str) -> str:
    restricted = " OR ".join(f"{n} > 0" for n, _, _, lv in PV.PATTERNS if lv == "restricted")
    return f"""CASE WHEN {_names('pii', 'financial')} THEN '{PV.CLASS_PII}' WHEN {_names('business')} THEN '{PV.CLASS_BUSINESS}'
       WHEN {_names('operational')} THEN '{PV.CLASS_OPERATIONAL}' ELSE '{PV.CLASS_PUBLIC}' END AS classification,
  CASE WHEN {restricted} THEN 'restricted' WHEN email > 0 OR phone > 0 THEN 'confidential' WHEN ip_address > 0 THEN 'internal'
       ELSE 'public' END AS privacy_level,
  CAST({number} AS INTEGER) AS detected_patterns, {number} > 0 AS requires_anonymization"""


_SOME = "(" + " + ".join(f"CAST({n} > 0 AS INTEGER)" for n, _, _, _ in PV.PATTERNS) + ")"
_CLASSIFIED = f"(SELECT doc_id, {_verdict(_SOME)} FROM (SELECT doc_id, {_COUNTS} FROM documents))"


@register("pii_classification", f"SELECT * FROM {_CLASSIFIED}")
def classified(spark, d):
    return op.classify_sensitivity(_texts(spark, d), "text", ["doc_id"])


_PARTS = "list_concat(string_split(text, chr(10)), [source, lang])"
_HITS = ", ".join(
    f"len(list_filter(parts, lambda t: regexp_matches(t, '{_q(p)}', 'i'))) AS {n}" for n, p, _, _ in PV.PATTERNS)


@register("record_classification", f"""
SELECT doc_id, {_verdict('(' + ' + '.join(n for n, _, _, _ in PV.PATTERNS) + ')')}
FROM (SELECT doc_id, {_HITS} FROM (SELECT doc_id, {_PARTS} AS parts FROM documents))""")
def _(spark, d):
    rows = fx.raw(spark, d, "documents").select(
        "doc_id", F.split("text", "\n").alias("lines"), F.struct("source", "lang").alias("origin"))
    return op.classify_record(rows, ["lines", "origin"], ["doc_id"])


def _masked(col: str) -> str:
    for pattern, tag in PV.MASKS:
        col = f"regexp_replace({col}, '{_q(pattern)}', '{tag}', 'g')"
    return col


@register("mask_text", f"""
SELECT conv_id AS id, turn AS part, {_masked('text')} AS text FROM conversations
UNION ALL SELECT doc_id, -1, {_masked('text')} FROM documents""")
def _(spark, d):
    talk = fx.raw(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    docs = _texts(spark, d).select("doc_id", F.lit(-1).cast("bigint"), "text")
    return op.mask_text(talk.unionAll(docs), "text")


_N = "CAST(('0x' || substr(md5(m), 1, 8)) AS BIGINT)"
_PSEUDO = {
    "email": f"'user' || CAST({_N} % 1000 AS VARCHAR) || '@' || split_part(m, '@', 2)",
    "phone": f"'555-' || lpad(CAST({_N} % 900 + 100 AS VARCHAR), 3, '0') || '-' || lpad(CAST({_N} % 9000 + 1000 AS VARCHAR), 4, '0')",
    "credit_card": "'****-****-****-' || right(m, 4)",
    "ssn": "'***-**-' || right(m, 4)",
    "ip_address": f"'192.168.' || CAST({_N} % 256 AS VARCHAR) || '.' || CAST({_N} % 256 AS VARCHAR)",
}
_OTHER = f"'ANON_' || lpad(CAST({_N} % 10000 AS VARCHAR), 4, '0')"


def _fold() -> str:
    """The oracle of the step-wise replacement: per pattern the distinct finds in order, then one replacement each."""
    steps, before = [], "(SELECT doc_id, text AS t FROM documents)"
    for i, (kind, pattern, _, _) in enumerate(PV.PATTERNS):
        pseudo = _PSEUDO.get(kind, _OTHER)
        steps.append(f"""s{i} AS (SELECT doc_id, f{i}, list_reduce(list_concat([t0], f{i}), lambda acc, m: replace(acc, m, {pseudo})) AS t
  FROM (SELECT doc_id, t0, list_filter(x, lambda v, j: list_position(x, v) = j) AS f{i}
        FROM (SELECT doc_id, t AS t0, regexp_extract_all(t, '{_q(pattern)}', 0, 'i') AS x FROM {before})))""")
        before = f"s{i}"
    return "WITH " + ",\n".join(steps)


_MAP = " UNION ".join(
    f"SELECT '{kind}' AS pattern, sha256(m) AS original_digest, {_PSEUDO.get(kind, _OTHER)} AS pseudonym "
    f"FROM (SELECT unnest(f{i}) AS m FROM s{i})" for i, (kind, _, _, _) in enumerate(PV.PATTERNS))


@register("pseudonymize", f"{_fold()} SELECT doc_id, t AS text FROM s{len(PV.PATTERNS) - 1}")
def _(spark, d):
    return op.pseudonymize(_texts(spark, d), "text")


@register("pseudonym_map", f"{_fold()} {_MAP}")
def _(spark, d):
    return op.pseudonym_map(_texts(spark, d), "text")


_INV = "product_code, branch_code, product_name, item_category1, supplier_name, supplier_code, Last_on_hand"


@register("redact_columns", with_ctes("inventory", f"""
SELECT product_code, branch_code, '[REDACTED]' AS product_name, item_category1, '[REDACTED]' AS supplier_name,
  '[REDACTED]' AS supplier_code, Last_on_hand FROM inventory"""))
def _(spark, d):
    return op.redact_columns(fx.inventory(spark, d).select(*_INV.split(", ")))


@register("redact_text", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{PV.LOOSE_EMAIL}') OR length(regexp_replace(text, '\\D', '', 'g')) >= 9
  THEN '[REDACTED]' ELSE text END AS text, lang, source, n_chars FROM documents""")
def _(spark, d):
    return op.redact_columns(fx.raw(spark, d, "documents"))


@register("record_hash", """
SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS record_hash
FROM events""")
def _(spark, d):
    return op.record_hash(fx.raw(spark, d, "events").select("event_id", "event_type", "user_id")).select(
        "event_id", "record_hash")


# --- P9-P13 ---------------------------------------------------------------------------------------

def _intent_sql() -> str:
    cells, order = [], 0
    for name, phrases in Q.INTENTS.items():
        for p in phrases:
            cells.append(f"""SELECT query_id, {order} AS ord, '{name}' AS intent,
  (length(regexp_extract(q, '{p}')) / length(q) * 0.7::DOUBLE + (1.0::DOUBLE - (strpos(q, regexp_extract(q, '{p}')) - 1) / length(q)) * 0.3::DOUBLE) * 100 AS score
  FROM qs WHERE regexp_matches(q, '{p}')""")
            order += 1
    return f""", qs AS (SELECT query_id, lower(trim(query)) AS q, query FROM query_log),
hits AS ({' UNION ALL '.join(cells)}),
best AS (SELECT query_id, intent, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rn FROM hits)
SELECT qs.query_id, query, coalesce(intent, 'general') AS query_type, {he('coalesce(score, 0)', 6)} AS confidence
FROM qs LEFT JOIN best ON best.query_id = qs.query_id AND rn = 1"""


# A sixth event type does not exist, so every twentieth user asks something no phrase covers.
@register("query_intent", with_ctes("query_log", _intent_sql().replace(
    "lower(trim(query)) AS q, query FROM query_log",
    "lower(trim(query)) AS q, query FROM (SELECT query_id, CASE WHEN username LIKE '%9' THEN 'good morning, branch' ELSE query END AS query FROM query_log)")))
def _(spark, d):
    log = fx.query_log(spark, d).select("query_id", F.when(
        F.col("username").endswith("9"), "good morning, branch").otherwise(F.col("query")).alias("query"))
    return op.query_intent(log, "query").withColumn("confidence", half_even(F.col("confidence"), 6))


def _named(pattern: str) -> str:
    pattern = pattern.replace("؀-ۿ", "\\x{0600}-\\x{06FF}")
    return f"CASE WHEN regexp_matches(q, '{pattern}') THEN trim(regexp_extract(q, '{pattern}', 1)) END"


def _has(words) -> str:
    return " OR ".join(f"contains(q, '{w}')" for w in words)


@register("query_parameters", with_ctes("query_log", f"""
SELECT query_id, {_named(Q.ITEM)} AS item_name, {_named(Q.BRANCH)} AS branch_name,
  array_to_string(regexp_extract_all(q, '{Q.NUMBER}'), ' | ') AS numbers,
  CASE WHEN {_has(Q.RECENT_WORDS)} THEN 'recent' WHEN {_has(Q.EXTENDED_WORDS)} THEN 'extended' END AS time_period
FROM (SELECT query_id, lower(trim(query)) AS q FROM query_log)"""))
def _(spark, d):
    return op.query_parameters(fx.query_log(spark, d).select("query_id", "query"), "query").drop("query")


@register("prompt_cost", f"""
SELECT role, count(*) AS prompts, {he('sum(length(text)) / 4 * 0.000075::DOUBLE + count(*) * 0.0375::DOUBLE', 6)} AS estimated_cost
FROM conversations GROUP BY role""")
def _(spark, d):
    return op.prompt_cost(fx.raw(spark, d, "conversations"), "text", ["role"]).withColumn(
        "estimated_cost", half_even(F.col("estimated_cost"), 6))


def _reason(col: str) -> str:
    cases = " ".join("WHEN contains(lower({c}), '{w}') THEN 'Contains dynamic keyword: ''{w}'''".format(c=col, w=w)
                     for w in Q.DYNAMIC_WORDS)
    return f"CASE {cases} WHEN length(trim({col})) < 10 THEN '{Q.REASON_SHORT}' ELSE '{Q.REASON_FINE}' END"


@register("prompt_cacheable", with_ctes("query_log", f"""
, p AS (SELECT 'q' || query_id AS id, query AS text FROM query_log
  UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'd' || doc_id, lang FROM documents),
r AS (SELECT id, {_reason('text')} AS reason FROM p)
SELECT id, reason, reason = '{Q.REASON_FINE}' AS is_cacheable FROM r"""))
def _(spark, d):
    asked = fx.query_log(spark, d).select(F.concat(F.lit("q"), "query_id").alias("id"), F.col("query").alias("text"))
    talk = fx.raw(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"), "text")
    tiny = fx.raw(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id"), "lang")
    return op.prompt_cacheable(asked.unionAll(talk).unionAll(tiny), "text").drop("text")


@register("repeat_hit_rate", with_ctes("query_log", f"""
, g AS (SELECT ts - lag(ts) OVER (PARTITION BY username, query ORDER BY ts, query_id) AS gap FROM query_log)
SELECT count(*) FILTER (gap <= INTERVAL 24 HOUR) AS hits, count(*) - count(*) FILTER (gap <= INTERVAL 24 HOUR) AS misses,
  {he('count(*) FILTER (gap <= INTERVAL 24 HOUR) / count(*) * 100', 6)} AS hit_rate FROM g"""))
def _(spark, d):
    out = op.repeat_hit_rate(fx.query_log(spark, d), ["username", "query"])
    return out.withColumn("hit_rate", half_even(F.col("hit_rate"), 6))


# --- consent, processing log, retention -----------------------------------------------------------

# Every event gives a consent: to two data types, valid for as many hours as the event's value.
_CONSENTS = """SELECT CAST(user_id AS VARCHAR) AS username, 'consent_' || (user_id % 4) AS consent_type,
   [CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END, 'purchase'] AS data_types, ts AS granted_at,
   CASE WHEN user_id % 10 = 0 THEN NULL ELSE ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT) * 3600) END AS expires_at,
   event_id % 7 <> 0 AS is_active FROM events"""


def consents(spark, d):
    e = fx.raw(spark, d, "events")
    until = F.expr("ts + make_dt_interval(0, 0, 0, cast(round(value, 2) as decimal(12,2)) * 3600)")
    return e.select(
        F.col("user_id").cast("string").alias("username"), F.concat(F.lit("consent_"), F.col("user_id") % 4).alias("consent_type"),
        F.array(F.when(F.col("event_id") % 2 == 0, "view").otherwise("click"), F.lit("purchase")).alias("data_types"),
        F.col("ts").alias("granted_at"), F.when(F.col("user_id") % 10 != 0, until).alias("expires_at"),
        (F.col("event_id") % 7 != 0).alias("is_active"))


@register("consent_check", f"""
WITH c AS ({_CONSENTS}),
live AS (SELECT DISTINCT username, unnest(data_types) AS t FROM c WHERE is_active AND (expires_at IS NULL OR expires_at > TIMESTAMP '{AS_OF}'))
SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS username, event_type AS data_type, live.t IS NOT NULL AS consent_valid
FROM events LEFT JOIN live ON live.username = CAST(user_id AS VARCHAR) AND live.t = event_type""")
def _(spark, d):
    asked = fx.raw(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("username"),
                                              F.col("event_type").alias("data_type"))
    return op.consent_valid(asked, consents(spark, d), AS_OF)


@register("processing_report", """
SELECT event_type AS operation_type, 'class_' || (user_id % 3) AS data_classification, count(*) AS total_operations,
  count(*) FILTER (value > 30) AS anonymized_operations, count(*) FILTER (event_id % 2 = 0) AS consent_verified_operations
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1, 2""")
def _(spark, d):
    log = fx.raw(spark, d, "events").select(
        F.col("event_type").alias("operation_type"), F.concat(F.lit("class_"), F.col("user_id") % 3).alias("data_classification"),
        (F.col("value") > 30).alias("anonymization_applied"), (F.col("event_id") % 2 == 0).alias("consent_verified"),
        F.col("ts").alias("processed_at"))
    return op.processing_report(log, "2024-01-05 00:00:00", "2024-01-25 00:00:00")


@register("classification_report",
          f"SELECT classification, privacy_level, count(*) AS count FROM {_CLASSIFIED} GROUP BY 1, 2")
def _(spark, d):
    return op.classification_report(classified(spark, d))


@register("consent_report", f"""
SELECT consent_type, count(*) AS active_consents, count(*) FILTER (expires_at < TIMESTAMP '{AS_OF}') AS expired_consents
FROM ({_CONSENTS}) WHERE granted_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{AS_OF}' GROUP BY 1""")
def _(spark, d):
    return op.consent_report(consents(spark, d), "2024-01-01 00:00:00", AS_OF, AS_OF)


_POLICIES = [op.RetentionPolicy("query_history", 5, True, True), op.RetentionPolicy("performance_metrics", 20),
             op.RetentionPolicy("user_consent", 2555, False, True), op.RetentionPolicy("ai_audit_log", 365, True, True)]


def _totals(p, body: str) -> str:
    return (f"SELECT '{p.data_type}' AS data_type, {p.retention_days} AS retention_days, {str(p.auto_delete).lower()} AS auto_delete, "
            f"{str(p.archive_before_delete).lower()} AS archive_before_delete, {body}")


def _aged(days: int) -> str:
    return f"count(*) AS total_records, count(*) FILTER (ts < TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY) AS expired_records FROM events"


@register("retention_report", " UNION ALL ".join([
    _totals(_POLICIES[0], _aged(5)), _totals(_POLICIES[1], _aged(20)),
    _totals(_POLICIES[2], f"count(*), count(*) FILTER (expires_at < TIMESTAMP '{AS_OF}') FROM ({_CONSENTS})"),
    _totals(_POLICIES[3], "0, 0")]))
def _(spark, d):
    e = fx.raw(spark, d, "events")
    return op.retention_report({"query_history": e, "performance_metrics": e, "user_consent": consents(spark, d)},
                               _POLICIES, AS_OF)


@register("retention_survivors", f"""
SELECT 'query_history' AS data_type, event_id AS id FROM events WHERE NOT ts < TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY
UNION ALL SELECT 'user_consent', event_id FROM events""")
def _(spark, d):
    e = fx.raw(spark, d, "events")
    kept = op.purge_expired(e, _POLICIES[0], AS_OF).select(F.lit("query_history").alias("data_type"), F.col("event_id").alias("id"))
    never = op.purge_expired(e, _POLICIES[2], AS_OF)
    return kept.unionAll(never.select(F.lit("user_consent"), "event_id"))


@register("retention_purged_table", f"""
SELECT event_id, event_type, CAST(ts AS VARCHAR) AS ts FROM events WHERE NOT ts < TIMESTAMP '{AS_OF}' - INTERVAL 5 DAY""")
def _(spark, d):
    path = shared_folder(spark, "history")
    rows = fx.raw(spark, d, "events").select("event_id", "event_type", "ts", F.date_format("ts", "yyyy-MM").alias("month"))
    tables.create(rows, path, ["month"])
    op.purge_table(spark, path, _POLICIES[0], AS_OF, f"{path}-archive")
    return tables.read(spark, path, tables.version(spark, path)).drop("month")
