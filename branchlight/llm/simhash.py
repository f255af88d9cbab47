"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. Every bit position is given a nonzero vector of radius + 1 bits; each nonzero vector v of
radius + 1 bits makes a mask of the positions whose vector has an odd inner product with v. At most ``radius``
differing positions span at most that many dimensions, so some v is orthogonal to all of them, and under that v's
mask the two fingerprints are equal: every pair within the radius meets in one of the 2**(radius + 1) - 1 tables.

Links are sought between distinct fingerprints only. First, each fingerprint of a bucket is compared with the bucket's
smallest and with the one before it, and the components of these links are found. Then only buckets that still hold several
components are compared in full, in blocks that different tasks take, and only across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import words_of, written

BITS = 64
#: Members of a bucket that one task compares with as many others.
BLOCK = 512


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> bytes:
    """The SimHash of a word sequence, big-endian: bits set in over half of its shingles' XXH64 hashes."""
    from xxhash import xxh64_digest

    if not words:
        return bytes(8)
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stop = np.cumsum(size)
    many = max(1, len(words) - shingle + 1)
    starts = (stop - size)[:many].tolist()
    ends = (stop - 1)[-many:].tolist()
    hashes = np.frombuffer(b"".join([xxh64_digest(text[a:b], seed) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, many, 1 << 14):
        ones += np.unpackbits(hashes[at: at + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > many).tobytes()


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp) of every document; fp holds the fingerprint's bits as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(words_of(t), shingle) for t in batch.column("text").to_pylist()]
            fp = np.frombuffer(b"".join(found), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The masks, as signed longs. Positions take the nonzero vectors in turn, so that masks keep about half the bits."""
    many = (1 << radius + 1) - 1
    vectors = [i % many + 1 for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, many + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _near(a: Column | str, b: Column | str, radius: int) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def similar_classes(classes: DataFrame, radius: int) -> DataFrame:
    """(node, root) for the distinct fingerprints ``classes`` (fp): connected over links of at most ``radius`` bits."""
    masks = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("mask"))
                      for i, m in enumerate(covering_masks(radius))])

    def tabled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("m", F.explode(masks)).withColumns(
            {"t": F.col("m.t"), "key": F.col("fp").bitwiseAND(F.col("m.mask"))}).drop("m")

    bucket = Window.partitionBy("t", "key").orderBy("fp")
    seen = tabled(classes).withColumns({"before": F.lag("fp").over(bucket), "first": F.first("fp").over(bucket)})
    linked = seen.where(F.col("before").isNotNull()).select("fp", F.explode(F.array_distinct(F.array(
        *[F.when(_near("fp", c, radius), F.col(c)) for c in ("before", "first")]))).alias("b")).where("b IS NOT NULL")
    roots = written(components(linked.select(F.col("fp").alias("a"), "b")), "near-roots")

    rows = written(classes.join(roots, F.col("fp") == F.col("node"), "left")
                   .select("fp", F.coalesce("root", "fp").alias("root")), "near-classes")
    mixed = written(tabled(rows).groupBy("t", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"),
                                                         F.count(F.lit(1)).alias("n"))
                    .where("low <> high").select("t", "key", F.ceil(F.col("n") / BLOCK).alias("blocks")), "near-mixed")
    members = written(tabled(rows).join(mixed, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")),
                      "near-members")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = members.select("t", "key", F.col("own").alias("i"), every.alias("j"), F.col("fp").alias("x"), F.col("root").alias("a"))
    right = members.select("t", "key", every.alias("i"), F.col("own").alias("j"), F.col("fp").alias("y"),
                           F.col("root").alias("b"))
    across = left.join(right, ["t", "key", "i", "j"]).where((F.col("a") < F.col("b")) & _near("x", "y", radius))
    more = written(components(across.select("a", "b")), "near-more")
    onward = more.select(F.col("node").alias("root"), F.col("root").alias("end"))
    return rows.join(onward, "root", "left").select(F.col("fp").alias("node"), F.coalesce("end", "root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): documents are connected over fingerprints that differ in at most ``radius`` bits.

    ``component_id`` is the smallest doc_id reachable, its own included. Words are split at ASCII white space and A-Z are
    lower-cased; fewer words than ``shingle`` are one shingle, and texts without words (null too) have fingerprint 0, which links
    like any other. Rows with null ids are kept and link, but name a component only if all its ids are null (null then); repeated
    rows share a component. Columns other than doc_id and text are not read.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = written(similar_classes(classes.select("fp"), radius), "class-roots")
    placed = written(classes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "least"), "placed")
    named = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    ids = written(placed.join(named, "root").select(F.col("fp").alias("of"), "component_id"), "class-components")
    # A common fingerprint's rows are split by adaptive execution: both sides are plain tables.
    return prints.join(ids, F.col("fp") == F.col("of")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of ``docs``, all columns, of each component: of its own rows the one of the smallest doc_id, null ids last.

    Of rows that repeat that id, the first by text is taken. An id that occurs in several components may stay once for each.
    """
    # Rows travel as one column, so that their names can't clash with others.
    rows = written(_with_print(docs.select(F.struct("*").alias("row"), "text"), shingle), "printed-rows")
    classes = written(rows.select("fp").distinct(), "row-classes")
    roots = written(similar_classes(classes, radius), "row-roots")
    return _first_of(rows.join(roots, F.col("fp") == F.col("node")).select("row", "root")).select("row.*")


def _with_print(rows: DataFrame, shingle: int) -> DataFrame:
    """``rows`` (row, text) with the text's fingerprint instead of the text."""
    def run(batches):
        for batch in batches:
            found = b"".join(fingerprint(words_of(t), shingle) for t in batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.frombuffer(found, ">i8").astype(np.int64))],
                                             names=["row", "fp"])

    return rows.mapInArrow(run, rows.select("row", F.lit(0).cast("long").alias("fp")).schema)


def _first_of(rows: DataFrame) -> DataFrame:
    """The ``row`` of each ``root`` that is first by id and text; a task hands on only its own first row of a root."""
    order = Window.partitionBy("root").orderBy(F.col("row.doc_id").cast("long").asc_nulls_last(), F.xxhash64("row.text"), "row.text")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("row")
