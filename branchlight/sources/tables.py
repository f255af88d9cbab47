"""Partitioned tables that change by whole partitions, with every change committed at once.

A table is a folder. ``data/<change>/_part=<p>/`` holds Parquet files of one partition as one change wrote them, and
``manifest/<number>.json`` lists the folders that make up one version. A change writes new folders for the partitions it
touches, then its manifest by a rename that fails if the number is taken. Readers therefore see the version before or the version
after, whatever is interrupted; of two writers that start from the same version one fails and has changed nothing; and
partitions that a change doesn't touch are neither read nor written. Driver and manifest hold one entry per partition.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import versions


class ConcurrentChange(RuntimeError):
    """Another writer has committed since this change's version was read."""


@dataclass(frozen=True)
class Version:
    """One version: partition columns, and each partition's values and folders. ``notes`` has the last batch of each stream
    that writes to the table, ``buckets`` the number of a keyed table's partitions, ``keys`` the columns whose hash picks them if
    the table was made by ``create``."""

    number: int
    schema: str
    by: list[str]
    parts: dict[str, dict]
    notes: dict[str, int] = field(default_factory=dict)
    writer: list | None = None
    buckets: int | None = None
    keys: list[str] | None = None


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    return jvm, root, root.getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, ascending."""
    jvm, root, fs = _fs(spark, path)
    found = fs.globStatus(jvm.Path(root, "manifest/*.json")) or []
    return sorted(int(f.getPath().getName().removesuffix(".json")) for f in found)


def version(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """A version, the newest without a number; None if there is none."""
    if number is None:
        there = numbers(spark, path)
        if not there:
            return None
        number = there[-1]
    return Version(**json.loads(spark.read.text(f"{path}/manifest/{number:010d}.json", wholetext=True).first().value))


def read(spark: SparkSession, path: str, at: Version | None, parts: Sequence[str] | None = None) -> DataFrame:
    """The rows of a version, of all partitions or only of ``parts``; no other folder is opened."""
    folders = [f"{path}/{f}" for p in (at.parts if parts is None else parts) if p in at.parts for f in at.parts[p]["folders"]]
    schema = T.StructType.fromJson(json.loads(at.schema))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def part_of(by: Sequence[str]) -> Column:
    """The partition of a row: a hash of its partition columns' values, null among them."""
    return F.md5(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))


def write_parts(rows: DataFrame, path: str, by: Sequence[str]) -> dict[str, dict]:
    """Write ``rows`` below a new folder of the table, by partition; nobody sees them before a commit."""
    spark = rows.sparkSession
    name = f"data/{uuid.uuid4().hex}"
    # Few files for each partition, while a large one is still written by many tasks.
    rows.withColumn("_part", part_of(by)).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/{name}")
    stored = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_part", T.StringType())])).parquet(f"{path}/{name}")
    found = stored.select("_part", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("v")).distinct().collect()
    return {r._part: {"values": json.loads(r.v), "folders": [f"{name}/_part={r._part}"]} for r in found}


def commit(spark: SparkSession, path: str, new: Version) -> Version:
    """Make ``new`` a version of the table, or raise ConcurrentChange if its number is taken."""
    jvm, root, fs = _fs(spark, path)
    draft, final = jvm.Path(root, f"draft/{uuid.uuid4().hex}.json"), jvm.Path(root, f"manifest/{new.number:010d}.json")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(new.__dict__, ensure_ascii=False).encode()))
    out.close()
    context = jvm.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(),
                                             spark._jsc.hadoopConfiguration())
    never = spark._sc._gateway.new_array(getattr(jvm, "Options$Rename"), 1)
    never[0] = getattr(jvm, "Options$Rename").NONE
    try:
        context.rename(draft, final, never)
    except Exception as e:
        fs.delete(draft, False)
        if number_taken(spark, path, new.number):
            raise ConcurrentChange(f"version {new.number} of {path} is there already") from e
        raise
    return new


def number_taken(spark: SparkSession, path: str, number: int) -> bool:
    jvm, root, fs = _fs(spark, path)
    return fs.exists(jvm.Path(root, f"manifest/{number:010d}.json"))


def create(rows: DataFrame, path: str, by: Sequence[str], buckets: int | None = None) -> Version:
    """Write ``rows`` as the first version of a new table, partitioned by the columns ``by``.

    Columns of many values would make as many folders: with ``buckets``, rows are put into that many partitions by a hash of ``by``."""
    spark = rows.sparkSession
    if buckets:
        rows = _bucketed(rows, by, buckets)
        parts = write_parts(rows, path, ["_bucket"])
        return commit(spark, path, Version(0, rows.schema.json(), ["_bucket"], parts, buckets=buckets, keys=list(by)))
    parts = write_parts(rows, path, by)
    return commit(spark, path, Version(0, rows.schema.json(), list(by), parts))


def _next(old: Version, gone: Sequence[str], new: dict[str, dict], **notes) -> Version:
    parts = {p: v for p, v in old.parts.items() if p not in set(gone)} | new
    return Version(old.number + 1, old.schema, old.by, parts, buckets=old.buckets, keys=old.keys, **({"notes": old.notes} | notes))


def drop_parts(spark: SparkSession, path: str, gone: Callable[[dict], bool]) -> Version:
    """Delete the partitions whose values ``gone`` accepts, without reading or writing a row of the table."""
    old = version(spark, path)
    return commit(spark, path, _next(old, [p for p, v in old.parts.items() if gone(v["values"])], {}))


def delete_rows(spark: SparkSession, path: str, gone: Column, whole: Callable[[dict], bool | None] = lambda _: None,
                archive: str | None = None) -> Version:
    """Delete the rows that ``gone`` selects (not those for which it is null).

    ``whole`` says of a partition's values whether all its rows go (True: dropped unread), none (False: left alone) or
    some (None). Of the last, only partitions that hold such rows are written anew, without them. With ``archive`` the
    rows are first written there, in a folder named by the version that deletes them."""
    old = version(spark, path)
    said = {p: whole(v["values"]) for p, v in old.parts.items()}
    open_, all_ = [p for p, s in said.items() if s is None], [p for p, s in said.items() if s]
    going = F.coalesce(gone, F.lit(False))
    touched = [r._part for r in read(spark, path, old, open_).where(going).select(part_of(old.by).alias("_part")).distinct().collect()]
    if archive:
        lost = read(spark, path, old, all_).unionByName(read(spark, path, old, touched).where(going))
        lost.write.mode("overwrite").parquet(f"{archive}/version={old.number + 1}")
    kept = write_parts(read(spark, path, old, touched).where(~going), path, old.by) if touched else {}
    return commit(spark, path, _next(old, all_ + touched, kept))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the ``keep`` newest versions and the folders that none of these lists: the deleted rows leave the disk.

    Changes that are under way lose what they have written, so let none run."""
    jvm, root, fs = _fs(spark, path)
    there = numbers(spark, path)
    used = {f for n in there[-keep:] for v in version(spark, path, n).parts.values() for f in v["folders"]}
    for n in there[:-keep]:
        fs.delete(jvm.Path(root, f"manifest/{n:010d}.json"), False)
    for change in fs.globStatus(jvm.Path(root, "data/*")) or []:
        name = f"data/{change.getPath().getName()}"
        folders = [f"{name}/{f.getPath().getName()}" for f in fs.globStatus(jvm.Path(change.getPath(), "_part=*")) or []]
        if not used.intersection(folders):
            fs.delete(change.getPath(), True)
            continue
        for folder in folders:
            if folder not in used:
                fs.delete(jvm.Path(root, folder), True)
    for draft in fs.globStatus(jvm.Path(root, "draft/*")) or []:
        fs.delete(draft.getPath(), False)


def files(spark: SparkSession, path: str) -> set[str]:
    """The data files below a table, of all versions."""
    jvm, root, fs = _fs(spark, path)
    return {f.getPath().toString().split("/data/", 1)[1] for f in fs.globStatus(jvm.Path(root, "data/*/*/*.parquet")) or []}


# --- keyed tables ------------------------------------------------------------------------------------------------------------


def _bucketed(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def bucket_of(spark: SparkSession, at: Version, values: Sequence) -> int:
    """The bucket that holds the rows with these values of the table's keys."""
    schema = T.StructType.fromJson(json.loads(at.schema))
    row = spark.range(1).select(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(at.keys, values)])
    return _bucketed(row, at.keys, at.buckets).first()["_bucket"]


def upsert(changes: DataFrame, path: str, keys: Sequence[str], newest_by: str, buckets: int = 64,
           stream: str | None = None, batch: int = -1, first: Callable[[], tuple[int, DataFrame | None]] = lambda: (-1, None)
           ) -> Version:
    """Bring a keyed table to the newest version of every key, writing only the key buckets that ``changes`` touch.

    Versions are ordered by ``newest_by``. A batch of a stream that the table has taken already changes nothing. A table that
    isn't there is made, with ``buckets`` buckets, from what ``first`` gives: the number before its first version, and rows."""
    spark = changes.sparkSession
    newest = versions.latest_per_key(changes, list(keys), [newest_by])
    old = version(spark, path)
    if old and stream is not None and old.notes.get(stream, -1) >= batch:
        return old
    notes = {"notes": (old.notes if old else {}) | ({stream: batch} if stream is not None else {}),
             "writer": [stream, batch] if stream is not None else None}
    if old is None:
        number, rows = first()
        rows = newest if rows is None else versions.upsert(rows, newest, list(keys), newest_by)
        whole = _bucketed(rows, keys, buckets)
        parts = write_parts(whole, path, ["_bucket"])
        return commit(spark, path, Version(number + 1, whole.schema.json(), ["_bucket"], parts, buckets=buckets, **notes))
    rows = _bucketed(newest, keys, old.buckets)
    hit = [r._part for r in rows.select(part_of(["_bucket"]).alias("_part")).distinct().collect()]
    if not hit:
        return commit(spark, path, _next(old, [], {}, **notes))
    base = read(spark, path, old, hit).drop("_bucket")
    merged = _bucketed(versions.upsert(base, newest, list(keys), newest_by), keys, old.buckets)
    return commit(spark, path, _next(old, hit, write_parts(merged, path, ["_bucket"]), **notes))
