"""Tables that change by whole partitions: what a change touches, interrupted and concurrent changes, deletion, upserts."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from branchlight.operators import privacy, versions
from branchlight.sources import tables
from branchlight.streaming import operations as so
from branchlight.streaming.run import shared_folder

SHAPE = "username string, branch_name string, v int"
ROWS = [("u", "N", 1), ("u", "N", 2), ("u", "S", 3), ("w", "N", 4), (None, "N", 5), ("u", None, 6), ("ü/=:*", "N", 7)]


def content(spark, path, at=None):
    rows = tables.read(spark, path, at or tables.version(spark, path)).collect()
    return sorted((tuple(r) for r in rows), key=str)


def table(spark):
    path = shared_folder(spark, "table")
    tables.create(spark.createDataFrame(ROWS, SHAPE), path, ["username", "branch_name"])
    return path


def stamps(spark, path):
    local = path.removeprefix("file:")
    return {f: os.stat(f"{local}/data/{f}").st_mtime_ns for f in tables.files(spark, path)}


def test_deleting_a_branch_touches_only_its_folders(spark):
    path = table(spark)
    before = stamps(spark, path)
    own = {f for p in tables.version(spark, path).parts.values() if p["values"] == {"username": "u", "branch_name": "N"}
           for f in before if f.startswith(p["folders"][0].removeprefix("data/"))}
    versions.delete_branch(spark, path, "u", "N")
    after = stamps(spark, path)
    assert own and after == {f: t for f, t in before.items() if f not in own}
    assert content(spark, path) == sorted((r for r in ROWS if r[:2] != ("u", "N")), key=str)
    versions.delete_branch(spark, path, "u")
    assert content(spark, path) == sorted((r for r in ROWS if r[0] != "u"), key=str)
    versions.delete_branch(spark, path, "nobody")
    assert content(spark, path) == sorted((r for r in ROWS if r[0] != "u"), key=str)


def test_deleting_a_branch_of_a_table_in_buckets_rewrites_the_owners(spark):
    """Many owners make a bounded number of folders, and a deletion writes only one of them anew."""
    path = shared_folder(spark, "table")
    rows = ROWS + [(f"o{i}", b, i) for i in range(200) for b in "NS"]
    tables.create(spark.createDataFrame(rows, SHAPE), path, ["username"], buckets=8)
    assert len(tables.version(spark, path).parts) == 8

    def plain():
        return sorted((r[:3] for r in content(spark, path)), key=str)

    before = stamps(spark, path)
    versions.delete_branch(spark, path, "u", "N")
    after = stamps(spark, path)
    assert plain() == sorted((r for r in rows if r[:2] != ("u", "N")), key=str)
    assert len({f.split("/")[1] for f in before.keys() - after.keys()}) == 1 and all(before.get(f, t) == t for f, t in after.items())
    versions.delete_branch(spark, path, "u")
    versions.delete_branch(spark, path, "nobody")
    assert plain() == sorted((r for r in rows if r[0] != "u"), key=str)
    with pytest.raises(ValueError):
        versions.delete_branch(spark, path, "u", owner_column="branch_name")


def test_an_interrupted_change_leaves_the_table(spark, monkeypatch):
    path = table(spark)
    before = tables.files(spark, path)

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(tables, "commit", stop)
        with pytest.raises(KeyboardInterrupt):
            tables.delete_rows(spark, path, F.col("v") == 2)
    assert content(spark, path) == sorted(ROWS, key=str) and tables.numbers(spark, path) == [0]
    assert tables.files(spark, path) > before
    tables.vacuum(spark, path)
    assert tables.files(spark, path) == before


def test_deleting_rows_rewrites_only_partitions_that_hold_them(spark):
    path = table(spark)
    old = tables.version(spark, path)
    new = tables.delete_rows(spark, path, F.col("v").isin(2, 4), archive=f"{path}-archive")
    changed = {str(v["values"]) for p, v in old.parts.items() if new.parts.get(p) != v}
    assert changed == {str({"username": "u", "branch_name": "N"}), str({"username": "w", "branch_name": "N"})}
    assert content(spark, path) == sorted((r for r in ROWS if r[2] not in (2, 4)), key=str)
    assert content(spark, path, old) == sorted(ROWS, key=str)  # until it is vacuumed
    assert sorted(r.v for r in spark.read.parquet(f"{path}-archive/version=1").collect()) == [2, 4]
    tables.delete_rows(spark, path, F.lit(None).cast("boolean"))
    tables.delete_rows(spark, path, F.lit(True), whole=lambda values: values["branch_name"] is not None)
    assert content(spark, path) == [("u", None, 6)]


def test_two_writers_from_one_version_cant_both_commit(spark):
    path = table(spark)
    base = tables.version(spark, path)
    one = tables._next(base, list(base.parts)[:1], {})
    tables.commit(spark, path, one)
    with pytest.raises(tables.ConcurrentChange):
        tables.commit(spark, path, tables._next(base, list(base.parts)[1:], {}))
    assert tables.version(spark, path) == one


def test_retention_deletes_by_month(spark):
    at = lambda d: dt.datetime(2024, *d)
    rows = [(1, at((1, 5))), (2, at((2, 10))), (3, at((2, 20))), (4, at((3, 1))), (5, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz").withColumn("month", F.date_format("ts", "yyyy-MM"))
    for archived in (True, False):
        path = shared_folder(spark, "history")
        tables.create(df, path, ["month"])
        march = {f for p in tables.version(spark, path).parts.values() if p["values"]["month"] not in ("2024-01", "2024-02") for f in p["folders"]}
        policy = privacy.RetentionPolicy("x", 30, True, archived)
        privacy.purge_table(spark, path, policy, "2024-03-16 00:00:00", f"{path}-archive")
        assert [r[0] for r in content(spark, path)] == [3, 4, 5] == sorted(
            r.id for r in privacy.purge_expired(df, policy, "2024-03-16 00:00:00").collect())
        assert march <= {f for p in tables.version(spark, path).parts.values() for f in p["folders"]}
        assert len(tables.files(spark, path)) == 3  # the deleted rows have left the disk
        assert os.path.exists(f"{path}-archive".removeprefix("file:")) == archived
    privacy.purge_table(spark, path, privacy.RetentionPolicy("x", 1, False), "2030-01-01", "")
    assert [r[0] for r in content(spark, path)] == [3, 4, 5]


def test_a_change_of_one_key_writes_one_bucket(spark):
    path = shared_folder(spark, "keyed")
    shape = "key long, v int, ts int"
    upsert = lambda rows, **k: tables.upsert(spark.createDataFrame(rows, shape), path, ["key"], "ts", buckets=8, **k)
    first = upsert([(i, 0, 0) for i in range(100)], stream="s", batch=0)
    assert len(first.parts) == 8
    files = tables.files(spark, path)
    second = upsert([(7, 1, 5), (7, 9, 3)], stream="s", batch=1)
    assert len([p for p in first.parts if first.parts[p] != second.parts[p]]) == 1
    assert len({f.split("/")[0] for f in tables.files(spark, path) - files}) == 1
    assert {r[:2] for r in content(spark, path) if r[1]} == {(7, 1)} and len(content(spark, path)) == 100
    # A batch that is repeated changes nothing; an older version of a key doesn't either.
    assert upsert([(7, 5, 50)], stream="s", batch=1) == second
    upsert([(7, 8, 4), (500, 2, 0)], stream="other", batch=0)
    assert {r[:2] for r in content(spark, path) if r[1]} == {(7, 1), (500, 2)}
    assert tables.version(spark, path).notes == {"s": 1, "other": 0}
    tables.vacuum(spark, path)
    assert len(content(spark, path)) == 101 and len(tables.numbers(spark, path)) == 1


def test_upsert_stream_over_several_triggers(spark):
    folder, target = shared_folder(spark, "in"), shared_folder(spark, "target")
    shape = "key string, v int, ts int"
    for n in range(3):
        spark.createDataFrame([(k, n, n) for k in "abc"[: n + 1]], shape).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(folder)
    so.upsert_stream(stream, target, ["key"], "ts", f"{target}-state", buckets=4).awaitTermination()
    done = so.generations(spark, target)
    assert sorted(done) == [0, 1, 2] and [b for _, b in done.values()] == [0, 1, 2]
    assert sorted(tuple(r) for r in so.read_generation(spark, target, 2).collect()) == [(k, 2, 2) for k in "abc"]
    assert sorted(tuple(r) for r in so.read_generation(spark, target, 0).collect()) == [("a", 0, 0)]
