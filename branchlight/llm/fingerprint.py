"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions alone.

A text is a multiset of paragraphs: runs up to a line end, or up to white space after a punctuation mark other than the comma.
Every paragraph hashes to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, so the order
of paragraphs doesn't matter and paragraphs are inserted or deleted by adding or subtracting their vector. Lanes:

* one counts paragraphs, modulo 2**60;
* SUMS lanes add 60 bits of a hash modulo 2**60: equal sums mean equal multisets but for a vanishing chance;
* 2 * SHIFTS * SIGNS lanes of 30 bits, two to a long, add one bit of a hash modulo 2**30. Twice such a sum less the
  count, taken as a signed number, is a sum of +1 and -1 per paragraph; over many lanes, products of two texts' numbers
  estimate how many paragraphs they share. No such number wraps below 2**30 paragraphs, which take more bytes than a
  string can hold; only fingerprints merged beyond that do.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, small, written

SUMS, SIGNS, SHIFTS = 4, 2, 30
PARAGRAPH_END = r"[\n\r]|\s(?<=[!-+\-./:-@\[-`{-~]\s)"
_WIDE = (1 << 60) - 1
_ONE = 1 | 1 << SHIFTS  # bit 0 of each 30-bit lane
_HIGH = _ONE << SHIFTS - 1
#: Cells of equally many ids (a power of two), and most buckets of neighbours.
CELLS, MOST_BUCKETS = 1024, 1_000_000
#: Rows of a partition of neighbours, about.
ROWS_EACH = 4_000


def _add_lanes(a: Column, bits: Column) -> Column:
    """Lane by lane ``a + bits`` modulo 2**30; no carry leaves its lane."""
    return (a.bitwiseAND(F.lit(_WIDE ^ _HIGH)) + bits).bitwiseXOR(a.bitwiseAND(F.lit(_HIGH)))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the lanes of column ``text`` as array column ``name``; null and texts without paragraphs give zeros."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH_END), lambda p: p != "")
    hashes = {f"{name}_h{i}": F.transform(f"{name}_p", functools.partial(lambda i, p: F.xxhash64(p, F.lit(i)), i))
              for i in range(SUMS + SIGNS)}
    zero = F.lit(0).cast("long")
    sums = [F.aggregate(f"{name}_h{i}", zero, lambda a, h: (a + h.bitwiseAND(F.lit(_WIDE))).bitwiseAND(F.lit(_WIDE)))
            for i in range(SUMS)]
    signs = [F.aggregate(f"{name}_h{SUMS + i}", zero, functools.partial(
        lambda s, a, h: _add_lanes(a, F.shiftright(h, s).bitwiseAND(F.lit(_ONE))), s))
        for i in range(SIGNS) for s in range(SHIFTS)]
    # Steps of their own, so that texts are split and hashed once.
    return (df.withColumn(f"{name}_p", parts).withColumns(hashes)
            .withColumn(name, F.array(F.size(f"{name}_p").cast("long"), *sums, *signs))
            .drop(f"{name}_p", *hashes))


def merged(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    def add(x, y, i):
        wide = (x + y).bitwiseAND(F.lit(_WIDE))
        lanes = _add_lanes(x, y.bitwiseAND(F.lit(_WIDE ^ _HIGH))).bitwiseXOR(y.bitwiseAND(F.lit(_HIGH)))
        return F.when(i <= SUMS, wide).otherwise(lanes)
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(pairs, lambda p, i: add(p["x"], p["y"], i))


def without(a: Column, b: Column) -> Column:
    """The fingerprint of a text's paragraphs less those of a part ``b``: the sum with the lanes' negatives."""
    wide = F.lit(1 << 60)

    def negative(y, i):
        lanes = _add_lanes(y.bitwiseXOR(F.lit(_WIDE)), F.lit(_ONE))
        return F.when(i <= SUMS, (wide - y).bitwiseAND(F.lit(_WIDE))).otherwise(lanes)
    return merged(a, F.transform(b, negative))


def as_text(lanes: Column) -> Column:
    """15 hex digits a lane group."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 15, "0")), "")


def _numbers(lanes: Column) -> Column:
    """The signed numbers of the 30-bit lanes: twice a lane is known modulo 2**31."""
    count = F.element_at(lanes, 1)
    each = F.flatten(F.transform(F.slice(lanes, SUMS + 2, SIGNS * SHIFTS), lambda x: F.array(
        *[F.shiftright(x, SHIFTS * k).bitwiseAND(F.lit((1 << SHIFTS) - 1)) for k in range(2)])))
    half = 1 << SHIFTS
    return F.transform(each, lambda v: (F.pmod(v * 2 - count + half, F.lit(2 * half)) - half).cast("double"))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with ``name``: shared paragraphs as a share of both texts' (0 to 1, an estimate), 1 for equal fingerprints."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    out = df.withColumns({"_x": _numbers(F.col(a)), "_y": _numbers(F.col(b))})
    both = dot("_x", "_x") + dot("_y", "_y")
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(2 * dot("_x", "_y"), both)))
    return out.withColumn(name, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.coalesce(near, F.lit(0.0)))
                          ).drop("_x", "_y")


def id_buckets(docs: DataFrame, tie: Column, rows_each: int = 500) -> Column:
    """An expression that numbers buckets of consecutive rows (by id, then by descending ``tie``), of about ``rows_each`` rows.

    Approximate quantiles of the ids bound CELLS cells of about equally many rows, however uneven the ids are, and each cell
    is cut evenly. An id that fills cells by itself is spread over them by ``tie``, a hash, and so are null ids, whose
    buckets are negative. The number of buckets is bounded whatever the number of rows.
    """
    shares = [i / CELLS for i in range(1, CELLS)]
    low, high, n, nulls, bounds = docs.agg(
        F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count_if(F.col("doc_id").isNull()),
        F.percentile_approx("doc_id", shares, 16 * CELLS)).first()
    rows_each = max(rows_each, math.ceil((n + nulls) / (MOST_BUCKETS - 2 * CELLS)))
    part = F.least(F.lit(1 - 1e-9), tie / F.lit(2.0 ** 64) + 0.5)
    nameless = (F.floor(part * math.ceil(nulls / rows_each)) + 1) * -1
    if low is None:
        return nameless
    inner = F.array(*map(F.lit, bounds))
    edges = F.array(*[F.lit(float(x)) for x in (low, *bounds, high + 1)])

    def reached(fits) -> Column:
        """How many bounds fit, by halving steps."""
        steps = F.array(*[F.lit(CELLS >> i) for i in range(1, CELLS.bit_length())])
        return F.aggregate(steps, F.lit(0), lambda at, s: at + F.when(fits(F.element_at(inner, at + s)), s).otherwise(0))

    upto, below = (reached(fits) for fits in (lambda b: b <= F.col("doc_id"), lambda b: b < F.col("doc_id")))
    start = F.element_at(edges, upto + 1)
    inside = (F.col("doc_id").cast("double") - start) / F.greatest(F.lit(1.0), F.element_at(edges, upto + 2) - start)
    place = F.when(upto - below < 2, upto + F.least(F.lit(1 - 1e-9), inside)).otherwise(
        below + 1 + (1 - 1e-9 - part) * (upto - below - 1))
    cuts = math.ceil(n / (CELLS * rows_each))
    return F.when(F.col("doc_id").isNull(), nameless).otherwise(F.floor(place * cuts)).cast("long")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` (with doc_id) and the ``columns`` of the next row, descending doc_id, as ``next_*``; after the last the first.

    Null ids come last, rows of the same id in the order of the first column's hash. Rows are ordered within buckets of
    consecutive ids; a bucket's first rows also go, as rows that are only looked at, to the bucket before it.
    """
    bucket = id_buckets(docs, F.xxhash64(columns[0]))
    ids = docs.select("doc_id", bucket.alias("bucket"))
    # One row per bucket, and their number is bounded.
    down = Window.orderBy(F.desc("bucket"))
    everywhere = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = written(ids.groupBy("bucket").agg(F.max("doc_id").alias("top")), "buckets").select(
        F.col("bucket").alias("of"),
        "top", F.coalesce(F.lag("bucket").over(down), F.last("bucket").over(everywhere)).alias("also"))
    rows = docs.withColumn("bucket", bucket).join(
        small(tops, MOST_BUCKETS), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")), "left")
    own = F.struct(F.col("bucket").alias("at"), F.lit(False).alias("seen"))
    copy = F.struct(F.col("also").alias("at"), F.lit(True).alias("seen"))
    dealt = rows.withColumn("place", F.explode(F.when(F.col("of").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    # Whole texts travel: so many partitions that each takes a few thousand rows.
    dealt = dealt.withColumn("place_at", F.col("place.at")).repartition(partitions_for(docs, ROWS_EACH), "place_at")
    order = Window.partitionBy("place_at").orderBy("place.seen", F.desc_nulls_last("doc_id"), F.xxhash64(columns[0]))
    return (dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
            .where("NOT place.seen").drop("bucket", "of", "top", "also", "place", "place_at"))


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last third comes from the next document.

    The edited text replaces the last floor(n_chars / 3) code points by the first as many (or all) of the next document in
    descending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null texts are empty; null ids come last in the order; rows repeated whole follow each other; an only document is its own
    next one. Columns other than doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("body"))
    found = with_next(with_fingerprint(rows, "body", "own"), ["body", "own"])
    found = found.withColumn("n_chars", F.char_length("body").cast("long"))
    cut = F.floor(F.col("n_chars") / 3)
    kept = F.substring("body", F.lit(1), (F.col("n_chars") - cut).cast("int"))
    edited = found.withColumn("edited", F.concat(kept, F.substring("next_body", F.lit(1), cut.cast("int")))).select(
        "doc_id", "n_chars", "own", "next_own", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    both = with_fingerprint(edited, "edited", "changed").drop("edited")
    near = likeness(likeness(both, "own", "changed", "near_edited"), "own", "next_own", "near_next")
    return near.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
                       as_text(F.col("changed")).alias("edited_fingerprint"), "near_edited", "near_next")
