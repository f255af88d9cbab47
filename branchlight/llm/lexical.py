"""Exact ranked lexical search by dense blocked matrix products.

The items' distinct terms are numbered; that compact vocabulary is all that documents are reduced to. One pass over the texts
writes each document's length and its counts of vocabulary terms; a second sums document frequencies. Then each task
turns tiles of documents into dense impact matrices over the vocabulary and multiplies them with the items' weights
by BLAS. Weights enter as limbs of 24 bits and impacts are below 10**6 < 2**20, so that sums over 512 terms stay below 2**53
and every partial product is exact in float64; partial products are added as longs. A task keeps each item's best
scores, ties at the last place settled by id, and hands on at most k of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: The bits of a weight limb, the terms of one product, and the documents and items of a tile.
LIMB, TERMS, DOCUMENTS, ITEMS = 24, 512, 512, 256
#: The cells of a tile's weights or impacts, and those of the weights that are broadcast together.
CELLS, TOGETHER = 1 << 21, 1 << 23
#: Bytes of text that are split into words at once.
SEGMENT = 1 << 20
_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """Lists of the text's terms in order: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERM)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class ItemBlock:
    """Items by number: their ids and the counts of their terms, by the numbers of these in the block's vocabulary."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.counts: list[dict[int, int]] = []
        for _, text in rows:
            counts: Counter[int] = Counter()
            for part in terms(text):
                counts.update([self.vocabulary.setdefault(t, len(self.vocabulary)) for t in part])
            self.counts.append(dict(counts))


def item_blocks(items: DataFrame, most_bytes: int) -> Iterator[ItemBlock]:
    """Blocks of items with about ``most_bytes`` of text each, read from one partition after another."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).toLocalIterator():
        rows.append((r.i, r.t))
        size += len(r.t or "") + 16
        if size >= most_bytes:
            yield ItemBlock(rows)
            rows, size = [], 0
    if rows:
        yield ItemBlock(rows)


def _term_counts(spark: SparkSession, docs: DataFrame, block: ItemBlock) -> DataFrame:
    """(doc_id, n, terms, tf) of each document that has a term of the block: its length in terms, and counts by term number.

    Documents with terms, but none of the block's, are kept for their lengths."""
    held = spark.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value.get
        for batch in batches:
            lengths, found, many = [], [], []
            for text in batch.column("text").to_pylist():
                counts, n = Counter(), 0
                for part in terms(text):
                    n += len(part)
                    counts.update(map(number, part))
                counts.pop(None, None)
                lengths.append(n)
                found.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                many.append(np.fromiter(counts.values(), np.int64, len(counts)))
            at = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (found, many)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists],
                                                 names=["doc_id", "n", "terms", "tf"])

    kind = "doc_id long, n long, terms array<int>, tf array<long>"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)
    return written(rows.where("n > 0"), "term-counts")


def _statistics(counts: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with terms, their terms with repeats, and document frequencies by term number (``size`` of them)."""
    def run(batches):
        df, total = np.zeros(size, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
            lengths = batch.column("n").to_numpy()
            total += [len(lengths), lengths.sum()]
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.concatenate([[-1, -2], some]), pa.int64()),
                                          "n": pa.array(np.concatenate([total, df[some]]), pa.int64())})

    df, total = np.zeros(size, np.int64), {-1: 0, -2: 0}
    for r in (counts.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term")
              .agg(F.sum("n").alias("n")).toLocalIterator()):
        if r.term < 0:
            total[r.term] = r.n
        else:
            df[r.term] = r.n
    return total[-1], total[-2], df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 8 m), below 10**6, with m = 25 + (75 n N) div L of the document."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        m = np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    else:
        m = 25 + 75 * n * documents // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class _Tile:
    """Weights of some items, from number ``first`` on: their terms' numbers, and for each run of TERMS of these the limbs."""

    def __init__(self, counts: list[dict[int, int]], weight: np.ndarray, first: int):
        self.first, self.items = first, len(counts)
        self.used = np.array(sorted({t for c in counts for t in c if weight[t] > 0}), np.int64)
        column = {t: i for i, t in enumerate(self.used.tolist())}
        whole = np.zeros((len(counts), len(self.used)), np.int64)
        for i, c in enumerate(counts):
            for t, many in c.items():
                if t in column:
                    whole[i, column[t]] = many * int(weight[t])
        self.parts = []
        for a in range(0, len(self.used), TERMS):
            for shift in range(0, 63, LIMB):
                limb = (whole[:, a: a + TERMS] >> shift) & ((1 << LIMB) - 1)
                if limb.any():
                    self.parts.append((a, shift, limb.astype(np.float64)))

    def impact_matrices(self, docs: int, term: np.ndarray, at: np.ndarray, impact: np.ndarray):
        """(first document, dense impacts) of the tile's terms by document, in parts of at most CELLS cells."""
        row = np.searchsorted(self.used, term)
        some = np.flatnonzero(self.used[np.minimum(row, len(self.used) - 1)] == term) if len(self.used) else row[:0]
        row, at, impact = row[some], at[some], impact[some]
        step = max(1, CELLS // max(1, len(self.used)))
        for a in range(0, docs, step):
            low, high = np.searchsorted(at, [a, a + step])  # documents come in order
            dense = np.zeros((len(self.used), min(step, docs - a)))
            dense[row[low:high], at[low:high] - a] = impact[low:high]
            yield a, dense

    def scores(self, impact: np.ndarray) -> np.ndarray:
        total = np.zeros((self.items, impact.shape[1]), np.int64)
        for a, shift, limb in self.parts:
            total += (limb @ impact[a: a + limb.shape[1]]).astype(np.int64) << shift
        return total


def _best(k: int, item: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, ...]:
    """The ``k`` first rows of each item by falling score, then rising id, null ids last."""
    order = np.lexsort((ids, null, -score, item))
    item = item[order]
    starts = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    place = np.arange(len(item)) - np.repeat(starts, np.diff(np.append(starts, len(item))))
    order = order[place < k]
    return item[place < k], score[order], ids[order], null[order]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, null, lengths, term numbers, counts, document of each count) of tiles of DOCUMENTS rows at most."""
    for whole in batches:
        for a in range(0, whole.num_rows, DOCUMENTS):
            batch = whole.slice(a, DOCUMENTS)
            ids, lists = batch.column("doc_id"), batch.column("terms")
            size = lists.value_lengths().to_numpy()
            yield (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), batch.column("n").to_numpy(),
                   lists.flatten().to_numpy(), batch.column("tf").flatten().to_numpy(), np.repeat(np.arange(len(size)), size))


def tile_groups(block: ItemBlock, weight: np.ndarray) -> Iterator[list[_Tile]]:
    """The block's tiles, each of at most ITEMS items and CELLS cells, in groups of about TOGETHER cells."""
    group, cells = [], 0
    first = 0
    while first < len(block.counts):
        used: set[int] = set()
        last = first
        while last < len(block.counts) and last - first < ITEMS:
            more = used | block.counts[last].keys()
            if last > first and len(more) * (last - first + 1) > CELLS:
                break
            used, last = more, last + 1
        group.append(_Tile(block.counts[first:last], weight, first))
        cells += len(used) * (last - first)
        first = last
        if cells >= TOGETHER:
            yield group
            group, cells = [], 0
    if group:
        yield group


def _ranked(counts: DataFrame, block: ItemBlock, k: int) -> Iterator[DataFrame]:
    """The rows of the block's items, one plan for each group of tiles."""
    documents, total, df = _statistics(counts, len(block.vocabulary))
    for tiles in tile_groups(block, weights(documents, df)):
        yield _ranked_tiles(counts, tiles, block.ids, documents, total, k)


def _ranked_tiles(counts: DataFrame, tiles: list[_Tile], names: list[int | None], documents: int, total: int, k: int) -> DataFrame:
    held = counts.sparkSession.sparkContext.broadcast((tiles, names))

    def run(batches):
        tiles, names = held.value
        none = np.zeros(0, np.int64)
        best = [(none, none, none, np.zeros(0, bool)) for _ in tiles]
        least = [np.ones(t.items, np.int64) for t in tiles]  # a score below it has no place
        for ids, null, n, term, tf, at in _tiles(batches):
            impact = impacts(tf, n[at], documents, total).astype(np.float64)
            for j, tile in enumerate(tiles):
                for first, dense in tile.impact_matrices(len(ids), term, at, impact):
                    score = tile.scores(dense)
                    item, doc = np.nonzero(score >= least[j][:, None])
                    if len(item):
                        new = (item, score[item, doc], ids[doc + first], null[doc + first])
                        best[j] = _best(k, *(np.concatenate(x) for x in zip(best[j], new)))
                        full = np.bincount(best[j][0], minlength=tile.items) >= k
                        lowest = np.full(tile.items, np.iinfo(np.int64).max)
                        np.minimum.at(lowest, best[j][0], best[j][1])
                        least[j][full] = lowest[full]
        for tile, (item, score, ids, null) in zip(tiles, best):
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item + tile.first, pa.int64()),
                "item_id": pa.array([names[i] for i in (item + tile.first).tolist()], pa.int64()),
                "doc_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(score, pa.int64())})

    found = counts.mapInArrow(run, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents with a score above 0.

    ``docs`` has doc_id and text, ``items`` item_id and text; whole texts count, null is the empty text. Equal scores
    rank by doc_id, null ids last. Rows are documents and items, whatever their ids: a repeated document ranks as often as it
    occurs, and items that share an id (or have none) get a list each. Items without terms, or whose terms occur
    nowhere, get no rows; empty tables give an empty result. Other columns are not read.

    Items go through in blocks of about ``block_bytes`` of text, whose vocabulary is broadcast; a block reads the texts once.
    Its term counts are read once for the statistics and once for each group of tiles.
    """
    spark = docs.sparkSession
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_bytes):
        if block.vocabulary:
            for part in _ranked(_term_counts(spark, docs, block), block, k):
                result = result.unionByName(part)
    return result
