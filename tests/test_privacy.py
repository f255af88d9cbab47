import re

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from branchlight.functions import privacy as P
from branchlight.operators import privacy as op

SAMPLE = ("Mail anna@example.com or call 555-123-4567, id 123-45-6789, card 4111111111111111, host 192.168.1.100, "
          "key " + "ab12" * 9 + ", account 123456789012")


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def test_counts_and_verdict(spark):
    r = op.pii_counts(texts(spark, SAMPLE), "text", ["doc_id"]).first()
    assert (r.email, r.phone, r.ssn, r.credit_card, r.ip_address, r.api_key) == (1, 1, 1, 1, 1, 1)
    got = op.classify_sensitivity(texts(spark, SAMPLE, "host 10.0.0.1", "x" * 32, "nothing"), "text", ["doc_id"]) \
        .orderBy("doc_id").collect()
    assert [(r.classification, r.privacy_level) for r in got] == [
        (P.CLASS_PII, "restricted"), (P.CLASS_OPERATIONAL, "internal"), (P.CLASS_BUSINESS, "restricted"),
        (P.CLASS_PUBLIC, "public")]


def test_the_cheap_tests_never_hide_a_match(spark):
    plain = [F.regexp_count("text", F.lit(P.any_case(p))).alias(n) for n, p, _, _ in P.PATTERNS]
    df = texts(spark, SAMPLE, "٠١٢٣٤٥٦٧٨٩", "a@b.co", "", "word " * 50, "A1234567")
    assert df.select(*plain).collect() == op.pii_counts(df, "text", []).collect()


def test_masks(spark):
    out = op.mask_text(texts(spark, SAMPLE), "text").first().text
    for tag in ("[EMAIL]", "[PHONE]", "[CARD]", "[API_KEY]"):
        assert tag in out


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.from_regex(r"[a-z]{3,8}@[a-z]{3,6}\.(com|org)", fullmatch=True), min_size=1, max_size=4, unique=True),
       st.lists(st.from_regex(r"[2-9][0-9]{2}-[0-9]{3}-[0-9]{4}", fullmatch=True), max_size=3, unique=True))
def test_no_original_survives_and_pseudonyms_are_stable(spark, mails, phones):
    body = " and ".join(mails + phones)
    got = [r.text for r in op.pseudonymize(texts(spark, body, "again " + body), "text").orderBy("doc_id").collect()]
    for original in mails + phones:
        if not re.fullmatch(r"user\d+@.*|555-.*", original):
            assert original not in got[0]
    assert got[1] == "again " + got[0]


def test_nested_records(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('note', 'write to anna@example.com', 'n', 3) AS a, "
                   "map('x', array('10.0.0.1', 'plain')) AS b, array(named_struct('t', '123-45-6789')) AS c")
    r = op.classify_record(df, ["a", "b", "c"], ["id"]).first()
    assert r.classification == P.CLASS_PII and r.privacy_level == "restricted" and r.requires_anonymization
    quiet = op.classify_record(df.select("id", F.array(F.lit("hi")).alias("a")), ["a"], ["id"]).first()
    assert quiet.detected_patterns == 0 and quiet.classification == P.CLASS_PUBLIC


def test_redaction_by_name_and_value(spark):
    df = spark.createDataFrame([("Bob", "call 12 34 56 78 90", 5, None)], "customer_name string, note string, n int, free string")
    assert tuple(op.redact_columns(df).first()) == (P.REDACTED, P.REDACTED, 5, None)


def test_questions(spark):
    df = texts(spark, "How much STOCK of item widget 12 in today", "good morning", "low stock", "sales trend for branch north this month")
    got = op.query_parameters(op.query_intent(df, "text"), "text").orderBy("doc_id").collect()
    assert [r.query_type for r in got] == ["stock_levels", "general", "alerts", "sales_trends"]
    assert got[0].item_name == "widget 12 in today" and got[0].numbers == [12] and got[0].time_period == "recent"
    assert got[3].branch_name == "north this month" and got[3].time_period == "extended"
    assert got[2].confidence == 100.0 and got[1].confidence == 0.0


def test_cacheability(spark):
    got = [r.reason for r in op.prompt_cacheable(texts(spark, "what is new now", "short", "explain the coverage rule"), "text")
           .orderBy("doc_id").collect()]
    assert got == ["Contains dynamic keyword: 'now'", "Prompt too short (< 10 chars)", "Suitable for caching"]


def test_retention(spark):
    df = spark.sql("SELECT * FROM VALUES (1, timestamp_ntz'2024-01-01'), (2, timestamp_ntz'2024-01-30') t(id, ts)")
    gone, kept = op.RetentionPolicy("x", 10), op.RetentionPolicy("y", 10, auto_delete=False)
    assert [r.id for r in op.purge_expired(df, gone, "2024-01-31").collect()] == [2]
    assert op.purge_expired(df, kept, "2024-01-31").count() == 2
    report = {r.data_type: (r.total_records, r.expired_records) for r in op.retention_report(
        {"x": df}, [gone, kept], "2024-01-31").collect()}
    assert report == {"x": (2, 1), "y": (0, 0)}
