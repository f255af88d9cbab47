"""Lexical ranking, exact duplicates and whitening against plain Python."""

import hashlib
import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from branchlight.llm import exact_dedup, lexical, spectrum, whitening

DOCS = "doc_id long, text string, uid long, digest string, n int, key long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], DOCS)


# --- ranked lexical search ---------------------------------------------------------------------------------------------------


def plain_terms(text):
    small = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", small)


def plain_ranking(docs, items, k):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in plain_terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out.update((item, n + 1, None if null else i, -s) for n, (s, null, i) in enumerate(sorted(scores)[:k]))
    return out


def test_terms():
    text = "Ab1-ÉÀ\x00z\x7fQ\x80　w_x" + "y" * 20 + "  "
    assert [t.decode() for part in lexical.terms(text) for t in part] == plain_terms(text)
    assert list(lexical.terms(None)) == [] == list(lexical.terms("")) and not any(lexical.terms(" - "))


@pytest.mark.parametrize("tiny", [False, True])
def test_ranking(spark, monkeypatch, tiny):
    if tiny:  # many tiles, segments, parts and blocks
        for name, value in {"TERMS": 3, "DOCUMENTS": 4, "ITEMS": 2, "CELLS": 12, "TOGETHER": 20, "SEGMENT": 5, "LIMB": 4}.items():
            monkeypatch.setattr(lexical, name, value)
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)] + ["É", "ß9"]
    pick = lambda n: " ".join(words[int(x)] for x in np.minimum(rng.exponential(6, n), 31))
    docs = [(i, pick(int(rng.integers(0, 30)))) for i in range(60)]
    docs += [(100, "W1 w2"), (99, "w1 W2"), (98, "w2-w1"), (97, "w1,w2"), (97, "w1,w2"), (None, "w1 w2"), (None, None), (96, ""), (95, " - "),
             (94, "w3 " * 5000), (93, "w1 w2"), (92, "nothing known here")]
    items = [(i, pick(int(rng.integers(1, 8)))) for i in range(7)]
    items += [(7, "w1 w2"), (7, "w3"), (8, "w1 W1 w1 w31"), (9, "unseen"), (10, None), (11, ""), (None, "w4"), (12, "w5 " * 3000)]
    frames = documents(spark, docs).repartition(5), documents(spark, items).withColumnRenamed("doc_id", "item_id")
    got = lexical.ranked_documents(*frames, k=4, block_bytes=40 if tiny else 4 << 20)
    assert Counter(map(tuple, got.collect())) == plain_ranking(docs, items, 4)
    assert lexical.ranked_documents(frames[0].where("false"), frames[1]).collect() == []
    assert lexical.ranked_documents(frames[0], frames[1].where("false")).collect() == []


def test_partial_products_stay_exact():
    """Weights beyond a limb: repeated terms of an item."""
    block = lexical.ItemBlock([(1, "a b")])
    block.counts = [{0: 5_000_000, 1: 7}]
    (tile,), = lexical.tile_groups(block, np.array([30_000, 29_999]))
    impact = np.array([[999_999.0, 3.0], [999_998.0, 0.0]])
    assert len(tile.parts) == 2  # limbs
    assert tile.scores(impact).tolist() == [[5_000_000 * 30_000 * 999_999 + 7 * 29_999 * 999_998, 5_000_000 * 30_000 * 3]]
    assert lexical.TERMS << lexical.LIMB + 20 <= 2 ** 53
    assert lexical.impacts(np.array([1 << 32]), np.array([1 << 32]), 10, 10 ** 10).max() < 1 << 20


def test_long_lengths_in_impacts():
    tf, n = np.array([3, 1]), np.array([1 << 55, 7])
    assert lexical.impacts(tf, n, 1 << 20, 1 << 60).tolist() == [
        10 ** 9 * t // (1000 * t + 8 * (25 + 75 * x * (1 << 20) // (1 << 60))) for t, x in zip(tf.tolist(), n.tolist())]


# --- exact duplicates ----------------------------------------------------------------------------------------------------------


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


ROWS = [(i, f"text {i % 7}") for i in range(40)] + [(i, f"TEXT {i % 7}") for i in range(30, 60)] + [
    (100, None), (101, ""), (None, ""), (102, "ÀÉ X"), (103, "àé x"), (104, "ÀÉ x"), (105, "same"), (105, "same"), (105, "SAME"), (None, "lost"),
    (None, "LOST"), (106, "KKİ"), (107, "kKİ"), (108, "long " * 50_000), (109, "Long " * 50_000)]


@pytest.mark.parametrize("share", [1e-4, 0.05, 1.0])
def test_exact_duplicates(spark, share):
    """Whichever way digests take, by broadcast, by shuffle or some by each, the result is the same."""
    docs = documents(spark, ROWS).repartition(6)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(lower(t), []).append(i)
    out = exact_dedup.exact_duplicates(docs, share).collect()
    want = Counter((i, max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]),
                    hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = [r for r in out if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.one_of_each(docs, share)
    assert stay.columns == docs.columns
    rows = stay.collect()
    assert Counter((r.doc_id, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in rows) == Counter(
        (r.doc_id, r.text_sha256) for r in kept)
    again = exact_dedup.one_of_each(docs.repartition(3), share).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))
    assert exact_dedup.exact_duplicates(docs.where("false")).collect() == [] == exact_dedup.one_of_each(docs.where("false")).collect()


def test_frequent_digests_are_found(spark):
    """Every digest with more than the share of all rows is a winner, and nothing else; the summaries stay small."""
    rows = spark.range(60_000).selectExpr(
        "id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 1 THEN 'warm' ELSE concat('t', id) END AS text")
    marked = exact_dedup._marked(rows)
    found = exact_dedup.winners(marked, 1e-3).collect()
    assert {(r.keep_id, r.group_size) for r in found} == {(59_997, 20_000), (59_701, 400)} or {r.group_size for r in found} == {20_000, 400}
    assert exact_dedup.frequent(marked).count() <= exact_dedup.LANES * exact_dedup.TRACKED


# --- whitening -------------------------------------------------------------------------------------------------------------------


def plain_polynomial(matrix):
    """Faddeev-LeVerrier, exactly."""
    d = len(matrix)
    m, c = [[0] * d for _ in range(d)], [1]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][x] * m[x][j] for x in range(d)) + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        c.append(-sum(matrix[i][x] * m[x][i] for i in range(d) for x in range(d)) // k)
    return c[::-1]


def gram(rng, d, rank, size):
    b = rng.integers(-size, size + 1, (d, rank)).astype(object)
    return (b @ b.T).tolist()


@pytest.mark.parametrize("d,rank,size", [(1, 1, 5), (2, 2, 9), (5, 5, 1000), (8, 3, 10 ** 6), (12, 14, 50), (6, 0, 3)])
def test_polynomial_and_roots(spark, d, rank, size):
    matrix = gram(np.random.default_rng(d), d, rank, size)
    f = spectrum.characteristic_polynomial(spark, matrix)
    assert f == plain_polynomial(matrix)
    roots = spectrum.largest_roots(f, d)
    want = sorted(np.linalg.eigvalsh(np.array(matrix, float)))[::-1]
    want = [w for w in want if w > 1e-9 * want[0]]
    assert sum(r.many for r in roots) == len(want)
    got = [float(r.value()) for r in roots for _ in range(r.many)]
    assert np.allclose(got, want, rtol=1e-8, atol=1e-6 * (want[0] if len(want) else 1))


def test_repeated_and_close_roots():
    f = [1]
    for root in (3, 3, 3, 10, 10, 2, 7):
        f = [a - root * b for a, b in zip([0, *f], [*f, 0])]
    found = spectrum.largest_roots(f, 6)
    assert [(round(r.value()), r.many) for r in found] == [(10, 2), (7, 1), (3, 3), (2, 1)]
    assert all(abs(r.value() - round(r.value())) <= r.value() / 2 ** 64 for r in found)
    # (x**2 - 2 * 10**40 x + 10**80 - 1)(x - 1): roots 10**40 + 1 and 10**40 - 1, further apart than doubles tell.
    big = 10 ** 40
    g = [big * big - 1, -2 * big, 1]
    f = [a - b for a, b in zip([0, *g], [*g, 0])]
    above, below, one = spectrum.largest_roots(f, 3)
    assert above.value() > big > below.value() and abs(one.value() - 1) < 1e-15
    assert spectrum.roots_above(f, 0, 0) == 3 and spectrum.roots_above(f, big, 0) == 1 and spectrum.roots_above(f, 1, 0) == 2


def plain_whitening(vectors, most=32):
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    off = np.array([[n * c - s for c, s in zip(row, sums)] for row in x], object)
    v = (off.T @ off) / Fraction(n) ** 3
    values, basis = np.linalg.eigh(v.astype(float))
    return n, [int(sum(o * o)) for o in off], off.astype(float) / n, values[::-1][:most], basis[:, ::-1][:, :most], float(sum(np.diag(v)))


def test_whitening(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(6, 6))
    vectors = [(i, (rng.normal(size=6) * [5, 3, 2, 1, .5, .3] @ mix).tolist()) for i in range(300)] + [(5, [1.0] * 6), (5, [1.0] * 6), (None, [2.0] * 6)]
    odd = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("-inf")] * 6), (904, []), (905, [1.0]),
           (906, [1.0] * 7), (907, [1.0] * 7)]
    frame = spark.createDataFrame([(i, v, 9, 1.0) for i, v in vectors + odd], "vec_id long, embedding array<double>, n long, z double").repartition(4)
    out = whitening.whitened_components(frame, most=4).collect()
    n, deviation, off, values, basis, trace = plain_whitening(vectors, 4)
    assert len(out) == 4 * n and {r.n for r in out} == {n} and {r.component for r in out} == {1, 2, 3, 4}
    assert Counter((r.vec_id, int(r.deviation)) for r in out if r.component == 1) == Counter(zip([i for i, _ in vectors], deviation))
    for c in range(4):
        rows = [r for r in out if r.component == c + 1]
        assert abs(rows[0].explained - values[c] / trace) < 1e-9 and rows[0].identity_error < 1e-9
        want = off @ basis[:, c] / math.sqrt(values[c])
        got = {r.vec_id: r.whitened for r in rows}
        flip = np.sign(got[0] * want[0])
        assert max(abs(got[i] - flip * w) for (i, _), w in zip(vectors, want)) < 1e-9


def test_whitening_of_deficient_tables(spark):
    kind = "vec_id long, embedding array<float>"
    make = lambda rows: whitening.whitened_components(spark.createDataFrame(rows, kind)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [])]) == []
    assert make([(1, [1.0, 2.0])]) == [] and make([(i, [3.0, 3.0]) for i in range(5)]) == []
    # Two dimensions of the three depend on each other, and one is constant: two components at most.
    out = make([(i, [float(i % 5), 2.0 * (i % 5), 7.0, float(i % 3)]) for i in range(30)])
    assert {r.component for r in out} == {1, 2} and out[0].identity_error < 1e-9
    assert abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-12
    # Eigenvalues that repeat exactly.
    points = [[s * (i == j) * 1.0 for j in range(4)] for i in range(4) for s in (1, -1)]
    out = make(list(enumerate(points)))
    assert {r.component for r in out} == {1, 2, 3, 4} and out[0].identity_error < 1e-9 and {r.explained for r in out} == {0.25}
    # Entries of very different sizes, and large ones.
    rng = np.random.default_rng(2)
    out = make([(i, [float(a) * 1e12, float(b), float(a + b) * 1e5]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)))])
    assert out[0].identity_error < 1e-4 and len({r.component for r in out}) == 3


def test_products_of_large_entries():
    rng = np.random.default_rng(5)
    for size in (3, 1 << 20, 1 << 40, 1 << 59):
        y = rng.integers(-size, size, (9, 4))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_squared_sums_of_large_offsets():
    rng = np.random.default_rng(6)
    for size in (5, 1 << 31, 1 << 45, 1 << 61):
        rows = rng.integers(-size, size, (20, 64))
        assert whitening.squared_sums(rows).tolist() == [sum(int(x) ** 2 for x in r) for r in rows.tolist()]
        assert whitening.squared_sums(rows.astype(object)).tolist() == whitening.squared_sums(rows).tolist()
    held = whitening.Projection(10 ** 10, [7] * 64, [1], np.ones((1, 64)))
    offsets = held.offsets(rng.integers(-40, 40, (5, 64)))
    assert offsets.dtype == np.int64 and held.whitened(offsets).shape == (5, 1)
