"""Toxicity, quality, token files, packing, fingerprints and scores on small tables with every odd case."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from branchlight.llm import fingerprint, lattice_lm, packing, quality, token_files, toxicity
from branchlight.llm.shared import labelled_sample, remainder
from branchlight.llm.tokens import ChunkEncoder

WORD, BYTE, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = " ".join(f"word{i % 700} of{i}" for i in range(9000))
#: Extra columns have names that operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, fp long, row long"


def odd_documents(spark):
    rows = [(1, "The cat sat.\nOn a mat", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "The cat sat.\nOn a mat", "en", "a"),
            (5, LONG, "en", "a"), (None, "no id here", "en", None), (7, "  \n\t ", None, "b"), (7, "Ünïcode 中文 🙂 x", "de", "c"),
            (8, "twice", "en", "c"), (8, "twice", "en", "c"), (None, None, None, "c")]
    return spark.createDataFrame([(*r, None, 0.5, 1, 2, 3) for r in rows], SCHEMA)


def none_of(spark):
    return spark.createDataFrame([], SCHEMA)


LABELS = "doc_id long, quality int, toxic int, text string"


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join([f"w{x}" for x in rng.integers(0, 300, 60)] + ["you", "idiot"] * (i % 3 == 0))) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0), None) for i in range(400)] + [(9999, 1, 1, None), (None, 1, 1, None), (5, None, None, None)],
                                   LABELS)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    learn = remainder(F.col("doc_id"), 4) != 2
    found = {r.doc_id: r for r in toxicity.score_toxicity(table, labels, learn).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(found) == 400 and np.mean([found[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    kept = {r.doc_id for r in toxicity.without_toxic(table, labels, learn).collect()}
    assert kept == {i for i, r in found.items() if r.score < 0.3}


def test_labelled_sample_is_bounded_in_rows(spark):
    """Ids that many rows repeat are learned from once, by the first text."""
    rows = [(1, f"t{i}") for i in range(200)] + [(2, "one"), (2, None), (3, "three")]
    labels = spark.createDataFrame([(i, 1, i % 2, None) for i in (1, 2, 3)], LABELS)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()}
    want = {(i, min((t or "" for k, t in rows if k == i), key=hashes.get), i % 2) for i in (1, 2, 3)}
    got = [tuple(r) for r in labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect()]
    assert len(got) == 3 and set(got) == want


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifiers_on_odd_rows(spark, score):
    labels = spark.createDataFrame([(1, 1, 1, "x"), (4, 0, 0, "x"), (5, None, 7, None), (8, 1, 0, None)], LABELS)
    docs = odd_documents(spark)
    rows = score(docs, labels, F.lit(True)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    same = {r.score for r in rows if r.doc_id == 8}
    assert len(same) == 1
    assert score(none_of(spark), labels, F.lit(True)).collect() == []
    unlearned = score(docs, labels.where("false"), F.lit(True)).collect()
    assert {r.score for r in unlearned} == {0.5}


def test_filters_keep_all_columns(spark):
    labels = spark.createDataFrame([], LABELS)
    for keep in (toxicity.without_toxic, quality.with_quality):
        kept = keep(odd_documents(spark), labels, F.lit(True), threshold=0.5001 if keep is toxicity.without_toxic else 0.5)
        assert kept.columns == odd_documents(spark).columns and kept.count() == 11


def test_quality_trees(spark):
    rng = np.random.default_rng(2)
    good = lambda: " ".join(f"word{x}" for x in rng.integers(0, 500, 80)) + "."
    bad = lambda: " ".join(f"WORD{x}!!" for x in rng.integers(0, 500, 80))
    docs = spark.createDataFrame([(i, good() if i % 4 else bad()) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0, None) for i in range(300)], LABELS)
    rows = quality.score_quality(docs, labels, remainder(F.col("doc_id"), 5) != 0).collect()
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in rows)
    x = np.array([[0.0, 5], [1, 5], [2, 5], [3, 5]] * 30)
    trees = quality.fit(x, (x[:, 0] > 1.5).astype(int))
    again = quality.Trees.loaded(trees.dumped())
    assert (again.score(x) == trees.score(x)).all() and ((trees.score(x) > 0.5) == (x[:, 0] > 1.5)).all()


PARTS = st.lists(st.sampled_from(list("abzAZ019 .,'!\n\t\x1c\x85\xa0") + ["'s", "'ll", "É", "İ", "²", "́", "中", "　", " <|endoftext|>",
                                                                     "🙂", " word"]), max_size=16).map("".join)


@pytest.fixture(scope="module", params=[WORD, BYTE])
def chunked(request):
    return ChunkEncoder(request.param, most_chunks=50)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PARTS, max_size=5))
def test_chunks_encode_as_whole_texts(chunked, texts):
    for text, ids in zip(texts, chunked.encode(texts, most_chars=20)):
        assert np.frombuffer(ids, "<u4").tolist() == chunked.tokenizer.encode(text, add_special_tokens=False).ids


def encode(path, text):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()


def test_token_files_round_trip(spark, tmp_path):
    docs = odd_documents(spark)
    path = str(tmp_path / "store")
    token_files.write_token_files(docs, path, WORD, block_docs=3)
    rows = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((r.doc_id, encode(WORD, r.text)) for r in docs.collect())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (start, len(r.ids) // 4)
        start += r.n_tokens
    some = token_files.read_token_files(spark, path, [7, 5, 1234]).collect()
    assert Counter((r.doc_id, r.start) for r in some) == Counter((r.doc_id, r.start) for r in rows if r.doc_id in (5, 7))
    block = spark.read.parquet(f"{path}/blocks").first()
    with pytest.raises(ValueError):
        token_files.open_block(bytes(block.payload), b"another dictionary")


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(none_of(spark), path, WORD)
    assert token_files.read_token_files(spark, path).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([1, 2, 8, 16, 32]))
def test_packing_holds_every_id_once(sizes, window):
    docs = [(i // 2, np.arange(n, dtype="<u4").tobytes()) for i, n in enumerate(sizes)]
    seqs = list(packing.pack(iter(docs), window))
    fills = [sum(len(p[3]) // 4 for p in w) for w in seqs]
    assert all(f == window or f & (f - 1) == 0 for f in fills) and sum(f < window for f in fills) <= window.bit_length()
    for w in seqs:
        for _, start, _, ids in w:
            assert np.frombuffer(ids, "<u4").tolist() == list(range(start, start + len(ids) // 4))
    places = Counter((p[0], p[1] + k) for w in seqs for p in w for k in range(len(p[3]) // 4))
    assert places == Counter((i // 2, k) for i, n in enumerate(sizes) for k in range(n))


def test_level_choice_is_the_least_sum_of_squares():
    rng = np.random.default_rng(5)
    for _ in range(200):
        p = packing.SumOfSquares(12)
        p.counts[1:12] = rng.integers(0, 4, 11)
        size = int(rng.integers(1, 12))

        def after(h):
            c = p.counts.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 12
            return (c[1:12] ** 2).sum()
        options = [h for h in range(13 - size) if h == 0 or p.counts[h]]
        assert p.level(size) == max(options, key=lambda h: (-after(h), h))


def test_packing_documents(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, BYTE, window=64).collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.length
    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(encode(BYTE, r.text)) // 4
    assert whole == want
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or at & (at - 1) == 0
    assert packing.pack_documents(none_of(spark), BYTE).collect() == []


def test_fingerprints_and_edits(spark):
    docs = odd_documents(spark)
    rows = fingerprint.fingerprints_and_edits(docs).collect()
    assert len(rows) == 11
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[4].fingerprint != by_id[5].fingerprint
    ordered = [(5, LONG), (4, "The cat sat.\nOn a mat"), (3, "")]
    for (i, text), (_, after) in zip(ordered, ordered[1:]):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert by_id[i].n_chars == len(text)
        assert by_id[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert fingerprint.fingerprints_and_edits(none_of(spark)).collect() == []
    only = fingerprint.fingerprints_and_edits(docs.where("doc_id = 5")).first()
    cut = len(LONG) // 3
    assert only.near_next == 1 and only.edited_sha256 == hashlib.sha256((LONG[: len(LONG) - cut] + LONG[:cut]).encode()).hexdigest()


@pytest.mark.parametrize("ids", [
    [3 * i * i for i in range(200)], [*range(300), 2 ** 62], [7] * 200 + [None] * 200 + [10 ** 9 * i for i in range(200)],
    [None] * 50, [-2 ** 63, 0, 0, 2 ** 63 - 1], [5]], ids=["squares", "outlier", "hot", "nameless", "ends", "one"])
def test_next_document_over_many_buckets(spark, monkeypatch, ids):
    rows = [(i, f"t{k}") for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, body string")
    real = fingerprint.id_buckets
    monkeypatch.setattr(fingerprint, "CELLS", 32)
    monkeypatch.setattr(fingerprint, "id_buckets", lambda d, tie: real(d, tie, 7))
    tie = {r.body: r.h for r in docs.select("body", F.xxhash64("body").alias("h")).collect()}
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = {a: b for (_, a), (_, b) in zip(down, down[1:] + down[:1])}
    got = fingerprint.with_next(docs, ["body"]).collect()
    assert len(got) == len(rows) and {r.body: r.next_body for r in got} == want
    # No bucket holds a hot id or all null ids.
    sizes = [r["count"] for r in docs.groupBy(fingerprint.id_buckets(docs, F.xxhash64("body"))).count().collect()]
    assert max(sizes) <= 60


def test_fingerprints_are_multisets(spark):
    a, b = "One here.\nTwo there!\nThree", "Four\nTwo there!"
    rows = spark.createDataFrame([(a, b, f"{b}\n{a}")], "a string, b string, both string")
    for c in ("a", "b", "both"):
        rows = fingerprint.with_fingerprint(rows, c, f"f_{c}")
    r = rows.select(F.expr("f_both") == fingerprint.merged(F.col("f_a"), F.col("f_b")),
                    F.expr("f_a") == fingerprint.without(F.col("f_both"), F.col("f_b"))).first()
    assert list(r) == [True, True]
    pieces = [f"sentence {i}." for i in range(400)]
    x, y = " ".join(pieces[:300]), " ".join(pieces[100:])
    near = fingerprint.with_fingerprint(fingerprint.with_fingerprint(
        spark.createDataFrame([(x, y)], "x string, y string"), "x", "fx"), "y", "fy")
    assert abs(fingerprint.likeness(near, "fx", "fy", "n").first().n - 2 / 3) < 0.2


@pytest.mark.parametrize("n", [9_000, 20_000, 70_000])
def test_likeness_of_many_equal_paragraphs(spark, n):
    """``n`` equal pieces against two thirds of them and others: the lanes' sums don't wrap."""
    x, y = "same\n" * n, "same\n" * (n - n // 3) + "other\n" * (n // 3)
    near = fingerprint.with_fingerprint(fingerprint.with_fingerprint(
        spark.createDataFrame([(x, y)], "x string, y string"), "x", "fx"), "y", "fy")
    a = n - n // 3
    lanes = [[(xxhash.xxh64_intdigest(p, seed) >> s & 1) * 2 - 1 for seed in (fingerprint.SUMS, fingerprint.SUMS + 1) for s in range(60)]
             for p in (b"same", b"other")]
    u, v = n * np.array(lanes[0]), a * np.array(lanes[0]) + (n - a) * np.array(lanes[1])
    assert near.select(F.expr("fx[0]"), F.expr("fy[0]")).first()[:] == (n, n)
    assert fingerprint.likeness(near, "fx", "fy", "n").first().n == pytest.approx(2 * (u @ v) / (u @ u + v @ v))


def brute_segmentations(word, edges):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, len(word) + 1):
        if word[:n] in edges:
            total += edges[word[:n]] * brute_segmentations(word[n:], edges)
    return total


def test_lattice_sums_all_segmentations():
    v = lattice_lm.Vocabulary(PIECES)
    lattice = lattice_lm.Lattice(v, v.first)
    edges = {p: math.exp(e[1]) for p, e in lattice.edges.items() if e}
    for word in ("the", "information", "zzyx", "a", "über", "don't."):
        assert lattice.log_marginal(word) == pytest.approx(math.log(brute_segmentations("▁" + word, edges)), abs=1e-9)
        short, long = [0.0] * len(v.pieces), [0.0] * len(v.pieces)
        lattice.expect(word, 3, short)
        lattice._expect_long(word, 3, long)
        assert np.allclose(short, long, atol=1e-6)
    assert lattice.log_marginal("🙂") > -math.inf and lattice.log_marginal("x" * 5000) > -math.inf


def test_lattice_scores(spark):
    docs = odd_documents(spark)
    learn = remainder(F.col("doc_id"), 10) != 0
    rows = lattice_lm.score_documents(docs, PIECES, learn).collect()
    given = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    seen = Counter(w for i, ws in given if zlib.crc32(str(i if i is not None else "").encode()) % 10 for w in [*ws, None])
    total, below = sum(seen.values()), sum(seen.values()) + 0.1 * (len(seen) + 1)
    want = Counter()
    for i, ws in given:
        base = sum(math.log10((seen[w] + 0.1) / below) for w in [*ws, None])
        want[(i, len(ws) + 1, sum(seen[w] > 0 for w in [*ws, None]), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score <= 0 and math.isfinite(r.score) for r in rows)
    assert lattice_lm.score_documents(none_of(spark), PIECES, learn).collect() == []
    unlearned = lattice_lm.score_documents(docs, PIECES, F.lit(False)).collect()
    assert len(unlearned) == 11 and all(r.train_tokens == 0 and math.isfinite(r.score) for r in unlearned)
    assert re.search("lattice", lattice_lm.__doc__)
