"""Newest-version rules over uploads, snapshots and keyed tables.

Latest-per-key is taken with an aggregate over a struct: each task first reduces its own rows, so a key
that holds a large part of the table sends one row per task instead of being sorted in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of every key; ``order`` lists the columns that decide, most important first."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def latest_upload_per_branch(uploads: DataFrame, user: str | None = None) -> DataFrame:
    if user is not None:
        uploads = uploads.filter(F.col("username") == user)
    return latest_per_key(uploads.filter("branch_name IS NOT NULL AND branch_name <> ''"), ["branch_name"],
                          ["upload_timestamp", "doc_id"])


def upload_history(uploads: DataFrame, user: str, module: str, n: int = 10) -> DataFrame:
    return (uploads.filter((F.col("username") == user) & (F.col("module") == module))
            .orderBy(F.desc("upload_timestamp"), F.desc("doc_id")).limit(n)
            .select("doc_id", "original_filename", "upload_timestamp", "file_size"))


def branch_scan(rows: DataFrame, branch: str | None = None, latest_only: bool = True,
                snapshot: str = "snapshot_ts", branch_column: str = "branch_code") -> DataFrame:
    """Rows of the newest snapshot of one or every branch, or of all snapshots when ``latest_only`` is off."""
    if branch not in (None, "", "all"):
        rows = rows.filter(F.col(branch_column) == branch)
    if not latest_only:
        return rows
    newest = rows.groupBy(branch_column).agg(F.max(snapshot).alias(snapshot))
    return rows.join(newest, [branch_column, snapshot], "left_semi")


def union_branches(frames: Sequence[DataFrame]) -> DataFrame:
    """Branch tables under each other; a column one of them lacks becomes null there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_products(frames: Sequence[DataFrame], column: str = "product_code") -> DataFrame:
    out = None
    for df in frames:
        part = df.select(column).distinct()
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def drop_branch(df: DataFrame, owner: str, branch: str | None = None, owner_column: str = "username",
                branch_column: str = "branch_name") -> DataFrame:
    """Survivors after deleting one branch (or everything) of an owner."""
    hit = F.col(owner_column) == owner
    if branch is not None:
        hit &= F.col(branch_column) == branch
    return df.filter(~F.coalesce(hit, F.lit(False)))


def delete_branch(spark: SparkSession, path: str, owner: str, branch: str | None = None, owner_column: str = "username",
                  branch_column: str = "branch_name") -> None:
    """Delete one branch (or everything) of an owner from a stored table (``sources.tables``).

    Of a table partitioned by both columns the branch's folders leave it in one commit and then the disk; no row is read, and no
    other folder touched. Of a table in buckets by owner only the owner's bucket is read, and written anew without the rows."""
    from ..sources import tables

    old = tables.version(spark, path)
    if old.keys is not None:
        if old.keys != [owner_column]:
            raise ValueError(f"the buckets of {path} are by {old.keys}, not by {owner_column}")
        own = tables.bucket_of(spark, old, [owner])
        gone = F.col(owner_column) == owner
        if branch is not None:
            gone &= F.col(branch_column) == branch
        tables.delete_rows(spark, path, gone, lambda values: None if values["_bucket"] == own else False)
        tables.vacuum(spark, path)
        return
    tables.drop_parts(spark, path, lambda values: values[owner_column] == owner
                      and (branch is None or values[branch_column] == branch))
    tables.vacuum(spark, path)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Insert or replace by key: the highest version wins, a change beats a base row of equal version."""
    both = base.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    return latest_per_key(both, keys, [version, "_side"]).drop("_side")


def check_ownership(requests: DataFrame, catalog: DataFrame, user: str) -> DataFrame:
    """Verdict per requested snapshot id: invalid, missing, denied or ok."""
    owners = catalog.select(F.col("doc_id").alias("_id"), F.col("username").alias("_owner"))
    return requests.join(owners, F.col("data_id") == F.col("_id"), "left").select(
        "data_type", "data_id",
        F.when(F.col("data_id").isNull() | (F.col("data_id") <= 0), "invalid")
        .when(F.col("_id").isNull(), "missing").when(F.col("_owner") != user, "denied").otherwise("ok").alias("verdict"))


# Data types any user with a branch may ask for.
ALLOWED_DATA_TYPES = ["inventory_data", "stock_quantities", "branch_data", "sales_data", "revenue_data",
                      "historical_data", "alert_data"]


def data_access_check(requests: DataFrame, branches: DataFrame) -> DataFrame:
    """Allowed when the user has a branch and asks only for listed data types."""
    known = branches.filter("branch_name IS NOT NULL").select("username").distinct().withColumn("_known", F.lit(True))
    extra = F.array_except("requested", F.array(*[F.lit(t) for t in ALLOWED_DATA_TYPES]))
    return requests.join(known, "username", "left").withColumn(
        "allowed", F.coalesce("_known", F.lit(False)) & (F.size(extra) == 0)).drop("_known")
