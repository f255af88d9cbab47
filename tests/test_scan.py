import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from branchlight.operators import scan
from branchlight.operators.scan import running
from branchlight.session import staged


def brute(data, keyed):
    out, state = {}, {}
    for k, at, v in sorted(data):
        s = state.setdefault(k if keyed else 0, {"n": 0, "sum": 0, "last": None, "prev": None})
        s["n"] += 1
        s["sum"] += v or 0
        s["last"] = v if v is not None else s["last"]
        out[(k, at)] = (s["n"], s["sum"], s["last"], s["prev"])
        s["prev"] = at
    return out


def check(spark, data, keyed, ranges):
    df = spark.createDataFrame(data, "k string, at long, v long")
    got = running(df, ["k", "at"] if not keyed else ["at"], ["k"] if keyed else [], ranges=ranges, row_number="n",
                  sums={"total": F.coalesce("v", F.lit(0))}, last_known={"known": F.col("v")},
                  previous={"before": F.col("at")})
    assert {(r.k, r.at): (r.n, r.total, r.known, r.before) for r in got.collect()} == brute(data, keyed)


def test_hot_key_is_split_over_ranges_and_stays_exact(spark):
    rnd = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", i, rnd.choice([None, 1, 5, -2])) for i in range(400)]
    check(spark, data, keyed=True, ranges=7)
    check(spark, data, keyed=False, ranges=5)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.integers(0, 60)),
                       st.one_of(st.none(), st.integers(-9, 9)), min_size=1, max_size=40), st.booleans())
def test_random_tables(spark, cells, keyed):
    check(spark, [(k, at, v) for (k, at), v in cells.items()], keyed, 4)


def test_ranges_follow_the_rows(spark, monkeypatch):
    """A hundred times the rows give more ranges, not larger ones, also where one key has all rows."""
    monkeypatch.setattr(scan, "ROWS", 500)
    written = []
    monkeypatch.setattr(scan, "staged", lambda df: (written.append(staged(df)), written[-1])[1])
    for n in (300, 30_000):
        df = spark.range(n).withColumn("k", F.lit("one"))
        out = scan.running(df, ["id"], ["k"], sums={"total": F.lit(1)}, row_number="at")
        assert out.filter("total <> id + 1 OR at <> id + 1").count() == 0 and out.count() == n
        ranged = next(w for w in reversed(written) if "_range" in w.columns)
        assert max(r["count"] for r in ranged.groupBy("_range").count().collect()) <= 1_500
    assert ranged.select("_range").distinct().count() >= 20
