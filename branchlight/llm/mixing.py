"""Mixing sources to target weights by hash thresholds found in histograms, without sorting documents.

Every document has a 48-bit hash. A source's documents are taken whole times, and once more where their hash is
below the source's threshold. The threshold is found in rounds of 12 bits: sizes are summed by source and hash bucket, the
bucket in which the budget is reached is the boundary, and the next round looks into the boundary bucket alone. Thresholds
are nested: a smaller budget takes a subset of the documents of a larger one. Rows that repeat whole are numbered, and from
the second on the number is hashed too, so that they are not all taken or all left.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import running
from .shared import small, written

BITS, ROUNDS = 12, 4
#: Source tables up to so many rows are broadcast; larger ones are joined by a shuffle.
MOST_SOURCES = 100_000


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words of a text; 0 for null."""
    return pa.array([len(t.encode("utf-8", "surrogatepass").split()) if t else 0 for t in text.to_pylist()], pa.int64())


def mixing_key(doc_id: Column, text: Column) -> Column:
    """The first 48 bits of the md5 of id and text; nulls count as empty texts."""
    return _hashed(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def _hashed(name: Column) -> Column:
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, BITS * ROUNDS // 4), 16, 10).cast("long")


def repeated_keys(rows: DataFrame) -> DataFrame | None:
    """(source, key) that several of ``rows`` have; None if there are none."""
    found = written(rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source", "key"), "mix-repeats")
    return found if found.limit(1).count() else None


def numbered(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` (source, key, ...) with a key of its own for each of those that repeat: the first keeps the key, the n-th gets the
    hash of key and n. Ranges of rows are numbered by many tasks, also where a single key has most of them."""
    if repeated is None:
        return rows
    these = small(repeated.select(F.col("source").alias("of"), F.col("key").alias("same")), MOST_SOURCES)
    fits = (F.col("key") == F.col("same")) & F.col("source").eqNullSafe(F.col("of"))
    named = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    more = rows.join(these, fits, "left_semi").withColumns({"named": named, "uid": F.monotonically_increasing_id()})
    nth = running(more, ["uid"], ["named", "key"], row_number="nth")
    key = F.when(F.col("nth") > 1, _hashed(F.concat_ws(" ", "key", "nth"))).otherwise(F.col("key"))
    return rows.join(these, fits, "left_anti").unionByName(nth.withColumn("key", key).select(*rows.columns))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) with weights repeating over the sources in code point order, null last.

    Sources share all words by weight; a target stops at ``most`` times its source's size, and what is above is shared by
    the others by weight until none is above. The windows run over one row per source.
    """
    order = F.col("source").asc_nulls_last()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(order)) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = total.withColumn("w", w.cast("long"))
    # From the source that reaches its limit first; weights are whole, so this order has no rounding.
    lcm = 1
    for x in weights:
        lcm *= x
    rise = Window.orderBy((F.col("source_size") * F.expr(f"{lcm} div w")), order)
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    rest_w = F.sum("w").over(everywhere) - F.coalesce(F.sum("w").over(before), F.lit(0))
    step = ranked.withColumns({"left": left, "rest_w": rest_w}).withColumn(
        "capped", F.col("left") * F.col("w") > most * F.col("source_size") * F.col("rest_w"))
    open_ = ~F.col("capped")
    share = step.withColumns({"open_left": F.max(F.when(open_, F.col("left"))).over(everywhere),
                              "open_w": F.max(F.when(open_, F.col("rest_w"))).over(everywhere)})
    return share.select("source", "source_size", F.when(open_, (F.col("w") * F.col("open_left")).cast("double")
                                                        / F.col("open_w").cast("double"))
                        .otherwise((most * F.col("source_size")).cast("double")).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``whole`` times that every document is taken, and ``bound``: those with a hash below it once more.

    ``rows``: source, size, key of every document.
    """
    state = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                               .otherwise(0)).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    state = written(state.withColumns({"prefix": F.lit(0).cast("long"), "below": F.lit(0).cast("long"),
                                       "inside": F.col("source_size")}), "mix-state")
    for done in range(ROUNDS):
        shift = BITS * (ROUNDS - done - 1)
        looked = state.where("budget > 0").select("source", "prefix", "below", "budget")
        hist = (rows.alias("r").join(small(looked, MOST_SOURCES).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
                .where(F.shiftright("key", shift + BITS) == F.col("prefix"))
                .groupBy("s.source", "prefix", "below", "budget", F.shiftright("key", shift).alias("bucket"))
                .agg(F.sum("size").alias("inside")))
        # At most 4096 buckets a source.
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = (hist.withColumn("reached", F.col("below") + F.sum("inside").over(upto)).where("reached >= budget")
                .groupBy(F.col("source").alias("at"))
                .agg(F.min_by(F.struct("bucket", "reached", "inside"), "bucket").alias("e")))
        state = written(state.join(edge, F.col("source").eqNullSafe(F.col("at")), "left").select(
            "source", "source_size", "target", "whole", "budget",
            F.coalesce("e.bucket", "prefix").alias("prefix"),
            F.coalesce(F.col("e.reached") - F.col("e.inside"), "below").alias("below"),
            F.coalesce("e.inside", "inside").alias("inside")), "mix-state")
    # The last bucket is a single hash: taken if that comes nearer to the budget.
    nearer = F.col("below") + F.col("inside") - F.col("budget") < F.col("budget") - F.col("below")
    return state.select("source", "source_size", "target", "whole",
                        F.when(F.col("budget") <= 0, F.lit(0)).otherwise(F.col("prefix") + nearer.cast("long")).alias("bound"))


def copies(whole: Column, key: Column, bound: Column) -> Column:
    return whole + (key < bound).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "source", word_count("text").alias("size"),
                       mixing_key(F.col("doc_id"), F.col("text")).alias("key"))


def _keyed_sizes(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Sizes and keys of every document, written once, and the keys that repeat among the documents' first keys."""
    rows = written(_sized(docs), "mix-sizes")
    repeated = repeated_keys(rows)
    return (rows if repeated is None else written(numbered(rows, repeated), "mix-numbered")), repeated


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document; ``taken`` counts the words of its copies.

    A null text has size 0 (and takes 0 words), null sources are one source that comes last, null ids are kept, and of rows
    that repeat whole as many are taken as the threshold allows. Columns other than doc_id, text and source are not read. The
    result depends on the rows alone.
    """
    rows, _ = _keyed_sizes(docs)
    plan = thresholds(rows, source_targets(rows, weights, most))
    return (rows.alias("r").join(small(plan, MOST_SOURCES).alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * copies(F.col("whole"), F.col("key"), F.col("bound"))).alias("taken")))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken, all columns kept. Nulls as in ``mix``."""
    rows, repeated = _keyed_sizes(docs)
    plan = thresholds(rows, source_targets(rows, weights, most)).withColumnRenamed("source", "of")
    keyed = numbered(docs.select(F.struct("*").alias("row"), "source", mixing_key(F.col("doc_id"), F.col("text")).alias("key")), repeated)
    times = copies(F.col("whole"), F.col("key"), F.col("bound"))
    return (keyed.join(small(plan, MOST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
            .withColumn("times", times).where("times > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*"))
