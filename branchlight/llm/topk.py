"""Exact top-k inner products by distributed histogram selection.

Queries go out in blocks of bounded size; every task scores its candidates against the block with one matrix product. The
first round finds for each query a range that holds its k-th value: the largest k-th value of any task and the
largest score. Each further round counts scores in equal bins of that range and keeps the bin in which the count from
the top reaches k, until a bin is one integer. The last round hands out the scores above that value and, of those
equal to it, each task's smallest ids, as many as are missing; a window orders what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_path, written

BINS = 256
_NONE = np.iinfo(np.int64).min


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as floor(scale * x), x as double; whole numbers as doubles, which from 2**53 on are whole anyway."""
    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)
    return F.transform(vector, one)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _modulo(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, modulo 2**64, as longs."""
    rest = np.fmod(x, 2.0 ** 64)
    rest = np.where(rest >= 2.0 ** 63, rest - 2.0 ** 64, rest)
    return np.where(rest < -(2.0 ** 63), rest + 2.0 ** 64, rest).astype(np.int64)


def inner_products(queries: np.ndarray, matrix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Inner products, as longs, of rows of whole numbers held as doubles.

    Those ``wanted`` are exact; OverflowError if one of them doesn't fit a long.
    """
    d = matrix.shape[1]
    bound = float(d) * float(np.abs(queries).max(initial=0)) * float(np.abs(matrix).max(initial=0))
    # Products and sums of these integers are exact below 2**53; above, integers are multiplied.
    if bound < 2.0 ** 53:
        return (queries @ matrix.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        # Long products are right modulo 2**64, so they are the score itself wherever that fits a long.
        score = _modulo(queries) @ _modulo(matrix).T
        if not bound < 2.0 ** 62:
            near, error = queries @ matrix.T, np.abs(queries) @ np.abs(matrix).T * ((d + 2) * 2.0 ** -51)
            for q, c in zip(*np.nonzero(wanted & ~(np.abs(near) + error < 2.0 ** 63))):
                exact = sum(int(x) * int(y) for x, y in zip(queries[q].tolist(), matrix[c].tolist()))
                if not -(1 << 63) <= exact < 1 << 63:
                    raise OverflowError(f"the score {exact} doesn't fit a long")
    return score


class _Block:
    """A block of queries: ids and vectors by dimension, and for each query what is known of its k-th value."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for d in {len(r[1]) for r in rows}:
            at = np.array([i for i, r in enumerate(rows) if len(r[1]) == d])
            self.by_dim[d] = at, np.array([rows[i][1] for i in at], np.float64).reshape(len(at), d)

    def scores(self, batches: Iterator[pa.RecordBatch], cells: int = 1 << 20):
        """(query numbers, candidate ids, scores, which count) of parts of at most about ``cells`` scores.

        A query's own row doesn't count and scores _NONE.
        """
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(size) - size
            for d, (at, queries) in self.by_dim.items():
                own = np.flatnonzero(size == d)
                step = max(1, cells // len(at))
                for a in range(0, len(own), step):
                    some = own[a: a + step]
                    matrix = flat[first[some][:, None] + np.arange(d)]
                    real = self.ids[at][:, None] != ids[some][None, :]
                    score = inner_products(queries, matrix, real)
                    score[~real] = _NONE
                    yield at, ids[some], score, real


def _ranges(held: Broadcast, k: int):
    def run(batches):
        block, n = held.value, len(held.value.ids)
        top, seen = np.full((n, k), _NONE), np.zeros(n, np.int64)
        low = np.full(n, np.iinfo(np.int64).max)
        for at, _, score, real in block.scores(batches):
            both = np.concatenate([top[at], score], axis=1)
            top[at] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            seen[at] += real.sum(1)
            low[at] = np.minimum(low[at], np.where(real, score, np.iinfo(np.int64).max).min(1))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({
            "q": pa.array(some, pa.int64()), "n": pa.array(seen[some]), "low": pa.array(low[some]),
            "kth": pa.array(top.min(1)[some], mask=(seen < k)[some]), "high": pa.array(top.max(1)[some])})

    return run, "q long, n long, low long, kth long, high long"


def _gap(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """high - low, which may be more than a long holds."""
    return (high - low).view(np.uint64)


def _counts(held: Broadcast, low: np.ndarray, high: np.ndarray, width: np.ndarray):
    def run(batches):
        block, n = held.value, len(held.value.ids)
        total = np.zeros(n * BINS, np.int64)
        for at, _, score, real in block.scores(batches):
            q, c = np.nonzero((score >= low[at][:, None]) & (score <= high[at][:, None]) & real)
            bins = _gap(low[at[q]], score[q, c]) // width[at[q]]
            total += np.bincount(at[q] * BINS + bins.astype(np.int64), minlength=n * BINS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"q": pa.array(some // BINS, pa.int64()), "bin": pa.array(some % BINS, pa.int64()),
                                          "n": pa.array(total[some])})

    return run, "q long, bin long, n long"


def _winners(held: Broadcast, value: np.ndarray, missing: np.ndarray):
    def run(batches):
        block, n = held.value, len(held.value.ids)
        ties: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        for at, ids, score, real in block.scores(batches):
            q, c = np.nonzero(score > value[at][:, None])
            yield _rows(at[q], block.ids[at[q]], ids[c], score[q, c])
            same = (score == value[at][:, None]) & real
            for i in np.flatnonzero(same.any(1)):
                own = at[i]
                found = np.concatenate([ties[own], ids[same[i]]])
                ties[own] = np.sort(found)[: missing[own]]
        for own in range(n):
            many = len(ties[own])
            yield _rows(np.full(many, own), np.full(many, block.ids[own]), ties[own], np.full(many, value[own]))

    return run, "q long, query_id long, vec_id long, score long"


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(("q", "query_id", "vec_id", "score"), columns)})


def _blocks(queries: DataFrame, size: int) -> Iterator[_Block]:
    rows: list[tuple[int, list[float]]] = []
    for r in queries.select("vec_id", "v").toLocalIterator():
        rows.append((r.vec_id, r.v))
        if len(rows) == size:
            yield _Block(rows)
            rows = []
    if rows:
        yield _Block(rows)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; ``is_query`` is an expression over vec_id. Candidates are all rows whose vec_id
    isn't the query's own and whose vector has as many components. Null vectors, vectors with null or non-finite components
    and null ids take no part. Rows are queries and candidates, whatever their ids: a query id that repeats gets a ranking for each of
    its rows, with ranks from 1 each, and repeated candidates all count. Fewer than k candidates are all returned. Scores are exact; one that doesn't fit a long is an error, whatever its rank
    (as it is in SQL). Other columns are not read. The driver and each task hold one block of ``block_rows``
    queries at a time.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col("vec_id").cast("long"), "embedding")
                   .where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
                   .select("vec_id", scaled(F.col("embedding")).alias("v")), "topk-vectors")
    queries = rows.where(is_query)
    path = shared_path(spark, "topk-result")
    result = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], result).write.parquet(path)
    for block in _blocks(queries, block_rows):
        held = spark.sparkContext.broadcast(block)
        n = len(block.ids)
        low, high, need = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        run, kind = _ranges(held, k)
        for r in (rows.mapInArrow(run, kind).groupBy("q").agg(F.sum("n").alias("n"), F.min("low").alias("low"),
                                                              F.max("kth").alias("kth"), F.max("high").alias("high")).collect()):
            # With fewer than k candidates in all, the lowest score is the last one wanted.
            low[r.q] = r.low if r.kth is None else r.kth
            high[r.q], need[r.q] = r.high, min(k, r.n)
        one = np.uint64(1)
        width = np.where(high >= low, _gap(low, high) // np.uint64(BINS) + one, one)
        above = np.zeros(n, np.int64)  # scores over the range
        while n:
            run, kind = _counts(held, low, high, width)
            total = np.zeros((n, BINS), np.int64)
            for r in rows.mapInArrow(run, kind).groupBy("q", "bin").agg(F.sum("n").alias("n")).collect():
                total[r.q, r.bin] = r.n
            down = above[:, None] + np.cumsum(total[:, ::-1], axis=1)  # scores from the top down to each bin
            at = np.argmax(down >= need[:, None], axis=1)
            above = down[np.arange(n), at] - total[:, ::-1][np.arange(n), at]
            low = low + ((BINS - 1 - at).astype(np.uint64) * width).view(np.int64)
            high = low + np.minimum(_gap(low, high), width - one).view(np.int64)
            if (width == 1).all():
                break
            width = (width - one) // np.uint64(BINS) + one
        value, missing = np.where(need > 0, low, np.iinfo(np.int64).max), need - above
        run, kind = _winners(held, value, missing)
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        (rows.mapInArrow(run, kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path))
    return spark.read.schema(result).parquet(path)
