"""Token-id files: documents compressed one by one under a shared zstandard dictionary, with an offset index.

A store is a folder with two Parquet tables that Spark writes and commits. ``dictionary`` has one row: the trained
dictionary and its sha256. ``blocks`` has one row per block of consecutive documents in ascending order (nulls first,
ties by text hash): shard, block, first and last id, counts, the place of its first id within the shard, and ``payload``,
the binary block: magic, dictionary sha256, number of documents n, then ids' null flags (n bytes), doc_ids (n int64),
frame offsets (n+1 uint64), token counts (n uint32), and the zstandard frames, each of one document's ids as
little-endian uint32. A single document is reached by its index entry and one frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partitions_for, shared_path, small
from .tokens import encoded

MAGIC = b"TOKBLK01"
#: Shards up to so many are broadcast with their first places; more are joined by a shuffle.
MOST_SHARDS = 1_000_000
_HEAD = struct.Struct("<8s32sI")
_BLOCK = ("shard int, block int, first_doc_id long, last_doc_id long, n_docs int, n_tokens long, start_in_shard long, "
          "payload binary")
_DOC = "doc_id long, start long, n_tokens long, ids binary"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int = 512, sample_ids: int = 8192,
                     size: int = 65536, runs: int = 8) -> bytes:
    """A zstandard dictionary from the serialized ids of at most ``sample_docs`` documents (smallest id hashes), of each
    at most ``sample_ids`` ids: all, or else ``runs`` runs spread evenly from its start to its end. Too few or too uniform samples
    give their plain content as dictionary, none an empty one."""
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id", "left_semi")
            .orderBy(F.xxhash64("doc_id", "text")).limit(sample_docs).select("text"))

    def train(batches):
        import zstandard

        samples = [part for b in batches for x in encoded(tokenizer, b.column("text").to_pylist(), end_id)
                   for part in _spread(x, sample_ids, runs)]
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except (zstandard.ZstdError, ValueError):
            made = b"".join(samples)[-size:]
        yield pa.RecordBatch.from_pydict({"dictionary": pa.array([made], pa.binary())})

    # The sample is bounded by its two parameters, so one task may hold it.
    found = rows.coalesce(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(found[0].dictionary) if found else b""


def _spread(ids: bytes, most: int, runs: int) -> list[bytes]:
    """Serialized ids whole if they are at most ``most``, else ``runs`` equal runs of them, the first at the start, the last at the end."""
    n, each = len(ids) // 4, max(1, most // runs)
    if n <= most:
        return [ids]
    starts = [(n - each) * i // max(1, runs - 1) for i in range(runs)]
    return [ids[4 * a: 4 * (a + each)] for a in starts]


def _compressors(dictionary: bytes):
    import zstandard

    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    # The dictionary's own hash is in every block, so frames need no checksum or dictionary id.
    params = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=False, write_dict_id=False)
    return params, zstandard.ZstdDecompressor(dict_data=known)


def _payload(dictionary: bytes, rows: list[tuple[int | None, int, bytes]]) -> bytes:
    n = len(rows)
    frames = [r[2] for r in rows]
    return b"".join([
        _HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), n),
        np.array([r[0] is None for r in rows], "u1").tobytes(), np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
        np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes(),
        np.array([r[1] for r in rows], "<u4").tobytes(), *frames])


def open_block(payload: bytes, dictionary: bytes):
    """Ids (None for null), token counts and a function from a position to its document's serialized ids."""
    magic, digest, n = _HEAD.unpack_from(payload)
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token block of this dictionary")
    at = _HEAD.size
    nulls = np.frombuffer(payload, "u1", n, at)
    ids = np.frombuffer(payload, "<i8", n, at + n)
    offsets = np.frombuffer(payload, "<u8", n + 1, at + 9 * n).astype(np.int64)
    counts = np.frombuffer(payload, "<u4", n, at + 9 * n + 8 * (n + 1))
    body = at + 9 * n + 8 * (n + 1) + 4 * n
    _, unpack = _compressors(dictionary)
    view = memoryview(payload)

    def document(i: int) -> bytes:
        return unpack.decompress(view[body + offsets[i]: body + offsets[i + 1]], max_output_size=max(1, 4 * int(counts[i])))

    return [None if z else int(d) for z, d in zip(nulls, ids)], counts, document


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_docs: int = 512,
                      block_bytes: int = 4 << 20, shard_docs: int = 50_000) -> None:
    """Encode every whole text and write a store at ``path``.

    A null text is the empty text (its ids are the end id alone); a null doc_id is kept and sorts first; repeated rows are
    all kept; columns other than doc_id and text are not read. An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))],
                          "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    held = spark.sparkContext.broadcast(dictionary)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        pack, _ = _compressors(held.value)
        rows: list[tuple[int | None, int, bytes]] = []
        size = 0

        def full():
            nonlocal block, start, size
            tokens = sum(r[1] for r in rows)
            out = {"shard": shard, "block": block, "first_doc_id": rows[0][0], "last_doc_id": rows[-1][0],
                   "n_docs": len(rows), "n_tokens": tokens, "start_in_shard": start, "payload": _payload(held.value, rows)}
            block, start, size = block + 1, start + tokens, 0
            rows.clear()
            return pa.RecordBatch.from_pylist([out], _arrow_blocks())

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(),
                                   encoded(tokenizer, batch.column("text").to_pylist(), end_id)):
                frame = pack.compress(ids)
                rows.append((doc_id, len(ids) // 4, frame))
                size += len(frame)
                if len(rows) >= block_docs or size >= block_bytes:
                    yield full()
        if rows:
            yield full()

    order = ["doc_id", "_tie"]
    (docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(partitions_for(docs, shard_docs), *order)
     .sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(blocks, _BLOCK).write.parquet(f"{path}/blocks"))


def _arrow_blocks() -> pa.Schema:
    return pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_doc_id", pa.int64()),
                      ("last_doc_id", pa.int64()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()),
                      ("start_in_shard", pa.int64()), ("payload", pa.binary())])


def _open_store(spark: SparkSession, path: str) -> tuple[bytes, DataFrame]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row.dictionary)
    if hashlib.sha256(dictionary).hexdigest() != row.sha256:
        raise ValueError("the stored dictionary doesn't match its hash")
    return dictionary, spark.read.schema(_BLOCK).parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a store, or of the given ids alone.

    ``start`` counts the ids of all documents before. With ``doc_ids`` only blocks whose id range holds one are read
    and only those documents' frames are decompressed.
    """
    dictionary, blocks = _open_store(spark, path)
    held = spark.sparkContext.broadcast(dictionary)
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row per shard, and shards hold tens of thousands of documents each.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if wanted is not None:
        # Blocks lie between the smallest and the largest id asked for; among these, some id must fall in the block's own range.
        asked = F.array(*[F.lit(i).cast("long") for i in wanted]) if wanted else F.array().cast("array<long>")
        within = F.exists(asked, lambda i: (i >= F.coalesce("first_doc_id", i)) & (i <= F.col("last_doc_id")))
        blocks = blocks.where(F.col("last_doc_id") >= wanted[0]).where(within) if wanted else blocks.where("false")
    rows = blocks.join(small(bases, MOST_SHARDS), "shard").select(
        (F.col("base") + F.col("start_in_shard")).alias("start"), "payload")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def documents(batches):
        pick = None if wanted is None else set(wanted)
        for batch in batches:
            for start, payload in zip(batch.column("start").to_pylist(), batch.column("payload")):
                ids, counts, document = open_block(payload.as_buffer().to_pybytes(), held.value)
                starts = start + np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
                at = [i for i in range(len(ids)) if pick is None or ids[i] in pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in at], pa.int64()), pa.array(starts[at], pa.int64()),
                     pa.array(counts[at].astype(np.int64), pa.int64()),
                     pa.array([document(i) for i in at], pa.binary())], schema=schema)

    return rows.mapInArrow(documents, _DOC)


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 1) -> str:
    """Write a store to a new path in the shared folder and return the path."""
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer, end_id)
    return path
