"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of adjacent words and of words with one between them. The
weights are learned example by example with a learning rate for each coordinate and an L1 term that keeps most of
them at zero; only the others, a few thousand, are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytescan import WORDS, distinct, mixed, runs, text_groups
from .shared import labelled_sample, rows_by_score, scored_texts

BITS = 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word, adjacent pair and skip pair; features may repeat within a text."""
    h, doc, _ = runs(data, offsets, WORDS)
    grams, docs = [h], [doc]
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = doc[:-gap] == doc[gap:]
        grams.append(mixed(h[:-gap] * np.uint64(factor) + h[gap:])[same])
        docs.append(doc[:-gap][same])
    return np.concatenate(docs), (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)


class FTRL:
    """FTRL-proximal on binary features; the bias is not regularised."""

    def __init__(self, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def bias(self) -> float:
        return -self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1]))

    def learn(self, ids: np.ndarray, label: int) -> None:
        w, b = self.weights(ids), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        for at, now in ((ids, w), (-1, b)):
            root = np.sqrt(self.n[at])
            self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * now
            self.n[at] += g * g


def fit(examples: list[tuple[np.ndarray, int]], epochs: int = 4, **rates: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the bias."""
    model = FTRL(**rates)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            model.learn(*examples[i])
    w = model.weights(np.arange(1 << BITS))
    some = np.flatnonzero(w)
    return some, w[some], float(model.bias())


def train_toxicity(docs: DataFrame, labels: DataFrame, chosen: Column, rows: int = 12_000
                   ) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``rows`` labelled documents (those of smallest id hashes) whose id satisfies ``chosen``.

    The bound lets one task learn them in sequence. Without labelled documents all weights are zero.
    """
    sample = labelled_sample(docs, labels, "toxic", chosen, rows)

    def train(batches):
        examples = []
        for batch in batches:
            y = batch.column("label").to_pylist()
            done = 0
            for data, offsets in text_groups(batch.column("text")):
                doc, ids = features(data, offsets)
                pairs = distinct(doc << BITS | ids)
                cut = np.searchsorted(pairs, np.arange(len(offsets)) << BITS)
                examples += [((pairs[a:b] & (1 << BITS) - 1).astype(np.int32), y[done + i])
                             for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
                done += len(offsets) - 1
        at, w, bias = fit(examples)
        yield pa.RecordBatch.from_pydict({"at": pa.array([at.tolist()]), "w": pa.array([w.tolist()]),
                                          "bias": pa.array([bias])})

    found = (sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")
             .mapInArrow(train, "at array<long>, w array<double>, bias double").collect())
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.array(found[0].at, np.int64), np.array(found[0].w), found[0].bias


def scorer(weights: tuple[np.ndarray, np.ndarray, float]) -> Callable[[pa.Array], np.ndarray]:
    """From texts to the probabilities of label 1. Null counts as the empty text, whose score is the bias's."""
    at, w, bias = weights
    dense = np.zeros(1 << BITS, np.float32)
    dense[at] = w

    def score(texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for data, offsets in text_groups(texts):
            doc, ids = features(data, offsets)
            hit = dense[ids] != 0
            pairs = distinct(doc[hit] << BITS | ids[hit])
            total = np.bincount(pairs >> BITS, dense[pairs & (1 << BITS) - 1], len(offsets) - 1)
            out.append(1 / (1 + np.exp(-np.clip(total + bias, -35, 35))))
        return np.concatenate(out)

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, chosen: Column, threshold: float = 0.3,
                   rows: int = 12_000) -> DataFrame:
    """(doc_id, score, predicted) of every document by weights learned from labelled documents that satisfy ``chosen``.

    Null texts are empty texts; null ids are scored but never learned from; repeated rows are scored alike; labels other than 0
    and 1 aren't learned from, and without any label every score is 0.5. Columns other than doc_id and text aren't read.
    """
    return scored_texts(docs, train_toxicity(docs, labels, chosen, rows), scorer).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, chosen: Column, threshold: float = 0.3,
                  rows: int = 12_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    return rows_by_score(docs, train_toxicity(docs, labels, chosen, rows), scorer, lambda s: s < threshold)
