"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

Texts are reduced to SHA-256 digests in one pass; only digests and ids go on. Digests are dealt into lanes by their hash, and
each lane's frequent ones are found by a Misra-Gries summary (Spark's mergeable frequent-item sketch), whose state
is bounded however many digests there are. The candidates are counted exactly; those with more than a stated share of all
rows are the winners, at most 1 / share of them, and are broadcast: their rows are decided where they lie. All other
digests are small by then and meet in an ordinary shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, written

#: Lanes of digests; fewer than the 128 keys up to which Spark keeps such summaries in a hash table.
LANES = 100
#: Counters of a lane's summary.
TRACKED = 512


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _marked(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, digest, key, tie, uid, ...) of every row, written once: ``uid`` tells rows apart that are equal throughout."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"),
                       F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("uid"), *more)
    return written(rows.withColumn("key", F.xxhash64("digest")), "digests")


def frequent(rows: DataFrame, lanes: int = LANES, tracked: int = TRACKED) -> DataFrame:
    """``key`` of the digests that the lanes' Misra-Gries summaries hold with more than one row, at most lanes * tracked."""
    lane = F.pmod("key", F.lit(lanes)).alias("lane")
    held = rows.select(lane, "key").groupBy("lane").agg(F.expr(f"approx_top_k(key, {tracked}, {tracked})").alias("top"))
    return held.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("key"))


def winners(rows: DataFrame, share: float) -> DataFrame:
    """(digest, keep_id, group_size, keep_uid) of the frequent digests that really have more than ``share`` of the rows."""
    found = F.broadcast(written(frequent(rows), "frequent"))
    least = max(1, int(share * rows.count()))
    counted = written(rows.join(found, "key", "left_semi").groupBy("digest")
                      .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                      .where(F.col("group_size") > least), "winners")
    first = (rows.join(F.broadcast(counted), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
             .groupBy("digest").agg(F.max_by("uid", "tie").alias("keep_uid")))
    return written(counted.join(F.broadcast(first), "digest"), "winning-rows")


def _first():
    """The row of a digest that stays comes first."""
    return Window.partitionBy("digest").orderBy(F.col("doc_id").desc_nulls_last(), F.desc("tie"), "uid")


def exact_duplicates(docs: DataFrame, share: float = 1e-4, rows_each: int = 500_000) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``, dropped rows too.

    Texts are equal if they are identical after lower-casing A-Z; null is the empty text. Equality is that of SHA-256 digests.
    Of equal texts the row with the largest doc_id stays, null ids last: ``keep_id`` is that id (null if the group has none)
    and ``kept`` is true for exactly one row of each group, also where rows repeat an id (then the one whose text hash
    is largest) or are equal throughout. Columns other than doc_id and text are not read, so their names don't matter.
    An empty table gives an empty result.

    Digests with more than ``share`` of all rows are decided by a broadcast of at most 1 / ``share`` rows; the others are
    shuffled to partitions of about ``rows_each`` rows. The result doesn't depend on which way a digest takes.
    """
    rows = _marked(docs)
    heavy = F.broadcast(winners(rows, share))
    group = Window.partitionBy("digest")
    columns = ["doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")]
    mapped = rows.join(heavy, "digest").withColumn("kept", F.col("uid") == F.col("keep_uid"))
    dealt = (rows.join(heavy, "digest", "left_anti").repartition(partitions_for(rows, rows_each), "digest")
             .withColumns({"kept": F.row_number().over(_first()) == 1, "keep_id": F.max("doc_id").over(group),
                           "group_size": F.count(F.lit(1)).over(group)}))
    return mapped.select(*columns).unionByName(dealt.select(*columns))


def one_of_each(docs: DataFrame, share: float = 1e-4, rows_each: int = 500_000) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns.

    Rows of frequent texts are dropped where they lie; of the others each task hands on at most one row of a digest."""
    # Rows travel as one column, so that their names can't clash with others.
    rows = _marked(docs, F.struct("*").alias("row"))
    heavy = F.broadcast(winners(rows, share))
    mapped = rows.join(heavy, "digest").where(F.col("uid") == F.col("keep_uid"))
    dealt = rows.join(heavy, "digest", "left_anti").withColumn("n", F.row_number().over(_first())).where("n = 1")
    return mapped.select("row.*").unionByName(dealt.select("row.*"))
