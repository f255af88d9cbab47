"""Quality by gradient-boosted trees over document statistics.

Trees grow on histograms: each statistic is cut into at most 64 bins, a split is chosen from the sums of gradients and
hessians by bin, and the finished trees are complete binary trees in flat arrays that numpy walks for all documents at once.
"""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import CHUNKS, LINES, runs, text_groups
from .shared import labelled_sample, rows_by_score, scored_texts

_CLASSES = {
    "upper": lambda b: 65 <= b <= 90, "lower": lambda b: 97 <= b <= 122, "digit": lambda b: 48 <= b <= 57,
    "space": lambda b: b in b" \t\n\r\x0b\x0c", "stop": lambda b: b in b".,;:?", "shout": lambda b: b in b"!",
    "bar": lambda b: b in b"|", "mark": lambda b: chr(b) in "#$%&*+<=>@[]^_`{}~\\/", "other": lambda b: b >= 128,
}
_TABLES = [np.array([f(b) for b in range(256)], np.uint8) for f in _CLASSES.values()]
STATISTICS = [*_CLASSES, "bytes", "chunks", "chunk_length", "long_chunks", "distinct_chunks", "distinct_pairs", "echoes",
              "top_chunk", "lines", "line_length", "distinct_lines"]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values for each text, and how often its commonest occurs."""
    key = np.sort(doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    of = (key[first] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, np.diff(np.append(first, len(key))))
    return np.bincount(of, minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text: shares of byte classes, logs of sizes, and shares that tell repetition."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    bytes_ = np.maximum(size, 1)
    out = []
    for t in _TABLES:
        total = np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)])
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / bytes_)
    h, doc, length = runs(data, offsets, CHUNKS)
    count = np.bincount(doc, minlength=n)
    some = np.maximum(count, 1)
    same = doc[:-1] == doc[1:]
    distinct, most = _distinct(doc, h, n)
    pairs, _ = _distinct(doc[:-1][same], (h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[same], n)
    lh, ldoc, llength = runs(data, offsets, LINES)
    lines = np.bincount(ldoc, minlength=n)
    out += [np.log1p(size), np.log1p(count), np.bincount(doc, length, n) / some, np.bincount(doc, length > 20, n) / some,
            distinct / some, pairs / np.maximum(count - 1, 1),
            np.bincount(doc[:-1][same & (h[:-1] == h[1:])], minlength=n) / some, most / some, np.log1p(lines),
            np.log1p(np.bincount(ldoc, llength, n) / np.maximum(lines, 1)), _distinct(ldoc, lh, n)[0] / np.maximum(lines, 1)]
    return np.stack(out, axis=1)


class Trees:
    """Boosted trees of one depth in flat arrays: inner node i has children 2i+1 (at most the cut) and 2i+2."""

    def __init__(self, bias: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.bias, self.feature, self.cut, self.value = bias, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, row = np.full(len(x), self.bias), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            total += value[node - inner]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -35, 35)))

    def dumped(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, bias=self.bias, feature=self.feature, cut=self.cut, value=self.value)
        return to.getvalue()

    @classmethod
    def loaded(cls, raw: bytes) -> Trees:
        with np.load(io.BytesIO(raw)) as f:
            return cls(float(f["bias"]), f["feature"], f["cut"], f["value"])


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, l2: float = 1.0,
        least: float = 1.0, bins: int = 64) -> Trees:
    """Boosted trees for labels 0 and 1; ``least`` is the smallest sum of hessians of a child."""
    n, width = x.shape
    inner = (1 << depth) - 1
    base = np.clip(y.mean(), 0.001, 0.999)
    bias = float(np.log(base / (1 - base)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    total = np.full(n, bias)
    feature = np.zeros((trees, inner), np.int64)
    cut, value = np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            start, many = (1 << level) - 1, 1 << level
            best, where = np.full(many, 1e-6), np.full((many, 2), -1)
            local = node - start
            for j in range(width):
                slot = local * bins + binned[:, j]
                left_g = np.cumsum(np.bincount(slot, g, many * bins).reshape(many, bins), axis=1)
                left_h = np.cumsum(np.bincount(slot, h, many * bins).reshape(many, bins), axis=1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = (left_g ** 2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2)
                        - all_g ** 2 / (all_h + l2))
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                gain[:, len(cuts[j]):] = 0
                at = gain.argmax(1)
                better = gain[np.arange(many), at] > best
                best[better] = gain[np.arange(many), at][better]
                where[better] = np.stack([np.full(many, j), at], axis=1)[better]
            for i in np.flatnonzero(where[:, 0] >= 0):
                j, b = where[i]
                feature[t, start + i], cut[t, start + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        total += value[t][leaf]
    return Trees(bias, feature, cut, value)


def train_quality(docs: DataFrame, labels: DataFrame, chosen: Column, rows: int = 16_000) -> Trees:
    """Trees from at most ``rows`` labelled documents (those of smallest id hashes) whose id satisfies ``chosen``.

    Statistics are computed where the texts are; the bound lets one task grow the trees. Without labelled documents there
    is no tree and every score is 0.5.
    """
    sample = labelled_sample(docs, labels, "quality", chosen, rows)

    def measure(batches):
        for batch in batches:
            x = [row for data, offsets in text_groups(batch.column("text")) for row in statistics(data, offsets).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())),
                                              batch.column("label")], names=["doc_id", "x", "label"])

    def train(batches):
        parts = [(batch.column("x").to_pylist(), batch.column("label").to_pylist()) for batch in batches]
        x, y = [r for p in parts for r in p[0]], [v for p in parts for v in p[1]]
        yield pa.RecordBatch.from_pydict({"trees": pa.array([fit(np.array(x), np.array(y)).dumped()], pa.binary())})

    found = (sample.mapInArrow(measure, "doc_id long, x array<double>, label int").repartition(1)
             .sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "x").mapInArrow(train, "trees binary").collect())
    if not found:
        return Trees(0.0, np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    return Trees.loaded(bytes(found[0].trees))


def scorer(trees: Trees) -> Callable[[pa.Array], np.ndarray]:
    """From texts to the probabilities of label 1. Null counts as the empty text."""
    def score(texts: pa.Array) -> np.ndarray:
        x = [statistics(data, offsets) for data, offsets in text_groups(texts)]
        return trees.score(np.concatenate(x)) if x else np.zeros(0)

    return score


def score_quality(docs: DataFrame, labels: DataFrame, chosen: Column, threshold: float = 0.3,
                  rows: int = 16_000) -> DataFrame:
    """(doc_id, score, predicted) of every document by trees grown on labelled documents that satisfy ``chosen``.

    Null texts are empty texts, whose statistics are all zero; null ids are scored but never learned from; repeated rows are
    scored alike; labels other than 0 and 1 aren't learned from, and without any label every score is 0.5. Columns
    other than doc_id and text aren't read.
    """
    return scored_texts(docs, train_quality(docs, labels, chosen, rows), scorer).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def with_quality(docs: DataFrame, labels: DataFrame, chosen: Column, threshold: float = 0.3,
                 rows: int = 16_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``threshold``."""
    return rows_by_score(docs, train_quality(docs, labels, chosen, rows), scorer, lambda s: s >= threshold)
