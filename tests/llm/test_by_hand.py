"""Operators recomputed by plain Python, and every pipeline stage on odd rows."""

import math
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from branchlight.llm import bytescan, fingerprint, lattice_lm, packing, quality, token_files, topk, toxicity
from branchlight.llm.shared import words_of

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

BYTE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
WIDE = (1 << 64) - 1


def packed_texts(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


# --- toxicity --------------------------------------------------------------------------------------------------------------------


def plain_mixed(h):
    h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & WIDE
    h = (h ^ h >> 27) * 0x94D049BB133111EB & WIDE
    return h ^ h >> 31


def plain_features(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    h = [plain_mixed(sum(b * pow(bytescan._FACTOR, k, 1 << 64) for k, b in enumerate(w)) & WIDE) for w in words]
    out = list(h)
    for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        out += [plain_mixed((a * factor + b) & WIDE) for a, b in zip(h, h[gap:])]
    return Counter(x >> 64 - toxicity.BITS for x in out)


def test_features_are_words_pairs_and_skip_pairs():
    texts = ["You you IDIOT, you", "", "one", "two words", "a b c d e a b c", "ünï 中文 x9", " - ! "]
    doc, ids = toxicity.features(*packed_texts(texts))
    for i, t in enumerate(texts):
        assert Counter(ids[doc == i].tolist()) == plain_features(t)


def test_ftrl_by_hand():
    """The per-coordinate update rule, one feature at a time in dictionaries."""
    rng = np.random.default_rng(1)
    examples = [(np.unique(rng.integers(0, 40, 6)).astype(np.int32), int(rng.integers(0, 2))) for _ in range(60)]
    rates = {"alpha": 0.7, "beta": 1.0, "l1": 0.6, "l2": 0.3}
    z, n = Counter(), Counter()

    def weight(i):
        if i == "bias":
            return -z[i] * rates["alpha"] / (rates["beta"] + math.sqrt(n[i]))
        if abs(z[i]) <= rates["l1"]:
            return 0.0
        return -(z[i] - math.copysign(rates["l1"], z[i])) / ((rates["beta"] + math.sqrt(n[i])) / rates["alpha"] + rates["l2"])

    order = np.random.default_rng(7)
    for _ in range(3):
        for e in order.permutation(len(examples)):
            ids, label = examples[e]
            held = {i: weight(i) for i in [*ids.tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(held.values()))) - label
            for i, w in held.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates["alpha"] * w
                n[i] += g * g
    some, w, bias = toxicity.fit(examples, epochs=3, **rates)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert dict(zip(some.tolist(), w.tolist())) == pytest.approx(want) and bias == pytest.approx(weight("bias"))
    assert 0 < len(want) < 40  # L1 keeps some at zero
    import pyarrow as pa
    score = toxicity.scorer((some, w, bias))(pa.array(["", None]))
    assert score == pytest.approx([1 / (1 + math.exp(-bias))] * 2, rel=1e-6)


# --- quality ---------------------------------------------------------------------------------------------------------------------


def test_statistics_by_hand():
    texts = ["Hello there, HELLO there!\nNew line 42 | x", "", "a a a b\n\na a a b", "é中 ~~ " + "long" * 10]
    rows = quality.statistics(*packed_texts(texts))
    at = {s: i for i, s in enumerate(quality.STATISTICS)}
    for text, row in zip(texts, rows):
        raw = text.encode()
        chunks, lines = raw.lower().split(), [x for x in re.split(rb"[\r\n]+", raw.lower()) if x]
        n, many = max(len(raw), 1), max(len(chunks), 1)
        want = {"upper": sum(65 <= b <= 90 for b in raw) / n, "digit": sum(48 <= b <= 57 for b in raw) / n,
                "space": sum(b in b" \t\n\r\x0b\x0c" for b in raw) / n, "other": sum(b >= 128 for b in raw) / n,
                "bytes": math.log1p(len(raw)), "chunks": math.log1p(len(chunks)), "chunk_length": sum(map(len, chunks)) / many,
                "long_chunks": sum(len(c) > 20 for c in chunks) / many, "distinct_chunks": len(set(chunks)) / many,
                "distinct_pairs": len(set(zip(chunks, chunks[1:]))) / max(len(chunks) - 1, 1),
                "echoes": sum(a == b for a, b in zip(chunks, chunks[1:])) / many,
                "top_chunk": max(Counter(chunks).values(), default=0) / many, "lines": math.log1p(len(lines)),
                "line_length": math.log1p(sum(map(len, lines)) / max(len(lines), 1)),
                "distinct_lines": len(set(lines)) / max(len(lines), 1)}
        assert {s: row[at[s]] for s in want} == pytest.approx(want)


def test_splits_are_the_best_ones():
    """Each stump against every cut of every statistic; then the walk against plain recursion."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        x, y = rng.integers(0, 12, (80, 3)).astype(float), rng.integers(0, 2, 80)
        stump = quality.fit(x, y, trees=1, depth=1, least=1.0)
        p = np.clip(y.mean(), 0.001, 0.999)
        g, h = p - y, np.full(80, p * (1 - p))

        def gain(left):
            parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
            return -math.inf if min(b for _, b in parts) < 1 else sum(a * a / (b + 1) for a, b in parts)
        best = max(gain(x[:, j] <= c) for j in range(3) for c in np.unique(x[:, j]))
        chosen = x[:, stump.feature[0, 0]] <= stump.cut[0, 0]
        assert gain(chosen) == pytest.approx(best)
        for side, leaf in ((chosen, 0), (~chosen, 1)):
            assert stump.value[0, leaf] == pytest.approx(-0.1 * g[side].sum() / (h[side].sum() + 1))
    trees = quality.fit(x, y, trees=4, depth=3)

    def walk(row):
        total = trees.bias
        for f, c, v in zip(trees.feature, trees.cut, trees.value):
            i = 0
            while i < len(f):
                i = 2 * i + (1 if row[f[i]] <= c[i] else 2)
            total += v[i - len(f)]
        return total
    assert trees.raw(x) == pytest.approx([walk(r) for r in x])


# --- fingerprints ----------------------------------------------------------------------------------------------------------------


def plain_paragraphs(text):
    """Runs up to a line end, or to white space after an ASCII mark other than the comma."""
    out, run = [], ""
    for c in text:
        marked = run and run[-1] in "!\"#$%&'()*+-./:;<=>?@[\\]^_`{|}~"
        if c in "\n\r" or c in " \t\x0b\x0c" and marked:
            out.append(run)
            run = ""
        else:
            run += c
    return [p for p in [*out, run] if p]


def test_fingerprints_are_sums_over_paragraphs(spark):
    texts = ["One, two. Three\nFour! Five", "same. same. same.", "a | b | c", "", "no end", "é. ü\r\n中. x ", "\n\n. .\n"]
    parts = [plain_paragraphs(t) for t in texts]
    names = sorted({p for x in parts for p in x})

    def lanes(values):
        df = spark.createDataFrame([(v,) for v in values], "t string")
        return {r.t: r.f for r in fingerprint.with_fingerprint(df, "t", "f").collect()}
    whole, each = lanes(texts), lanes(names)
    low = (1 << 30) - 1
    for t, own in zip(texts, parts):
        assert whole[t][0] == len(own)
        for i in range(1, fingerprint.SUMS + 1):
            assert whole[t][i] == sum(each[p][i] for p in own) % (1 << 60)
        for i in range(fingerprint.SUMS + 1, len(whole[t])):
            assert [whole[t][i] & low, whole[t][i] >> 30 & low] == [sum(each[p][i] >> s & low for p in own) % (1 << 30) for s in (0, 30)]


# --- lattice scores --------------------------------------------------------------------------------------------------------------


def test_words_together_equal_words_alone():
    v = lattice_lm.Vocabulary(PIECES)
    rng = np.random.default_rng(2)
    p = v.first * rng.uniform(0.5, 1.5, len(v.first))
    lattice = lattice_lm.Lattice(v, p / p.sum())
    letters = list("abcdeinorst'.0") + ["é", "ß", "🙂", "中"]
    words = ["".join(rng.choice(letters, int(rng.integers(1, 26)))) for _ in range(300)] + ["a", "the", "information", "x" * 60, "\udc80"]
    counts = rng.integers(1, 9, len(words))
    assert lattice.log_marginals(words) == pytest.approx([lattice.log_marginal(w) for w in words], rel=1e-12)
    into = [0.0] * len(v.pieces)
    for w, c in zip(words, counts.tolist()):
        lattice._expect_long(w, c, into)
    assert np.allclose(lattice.expected(words, counts), into, rtol=1e-6, atol=1e-6)
    assert len(lattice.log_marginals([])) == 0 and not lattice.expected([], counts[:0]).any()


def segmentations(word, known):
    if not word:
        return [[]]
    return [[known[word[:n]], *rest] for n in range(1, len(word) + 1) if word[:n] in known for rest in segmentations(word[n:], known)]


@pytest.mark.parametrize("rounds,whole", [(1, True), (2, True), (2, False)])
def test_document_scores_by_all_segmentations(spark, rounds, whole, monkeypatch):
    """Expectation maximisation and the marginal over every listed segmentation, in plain Python."""
    texts = ["the cat sat", "The cat ran", "a cat", "the the rat", "sat on a mat", "rat mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    real = lattice_lm.fit_pieces
    monkeypatch.setattr(lattice_lm, "fit_pieces", lambda w, v, e: real(w, v, e, rounds=rounds))
    got = {r.doc_id: r.score for r in lattice_lm.score_documents(docs, PIECES, F.col("doc_id") < 5, whole_words=whole).collect()}

    v = lattice_lm.Vocabulary(PIECES)
    known = {s: i for i, s in enumerate(v.pieces) if i not in set(v.bytes)}
    learned = [w.decode() for t in texts[:5] for w in words_of(t)]
    count, ends = Counter(learned), 5
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    hard = np.zeros(len(v.pieces))
    for w, c in count.items():
        for i in model.encode(w):
            hard[v.places[i]] += c
    p = 0.9 * hard / hard.sum() + 0.1 * v.first
    every = {w: segmentations("▁" + w, known) for w in {*count, "rat", "mat"}}
    for _ in range(rounds):
        soft = np.full(len(p), 0.01)
        for w, c in count.items():
            weight = [math.prod(p[i] for i in s) for s in every[w]]
            for s, x in zip(every[w], weight):
                for i in s:
                    soft[i] += c * x / sum(weight)
        total = soft.sum() + ends + 0.01
        p, end = soft / total, (ends + 0.01) / total
    n = len(learned) + ends
    rest = (len(count) + 1) * 0.5 / n if whole else 1.0
    begins = p[v.starts].sum() + end

    def logp(w):
        seen = max(count[w] - 0.5, 0) / n if whole else 0.0
        return math.log10(seen + rest * sum(math.prod(p[i] for i in s) for s in every[w]))
    close = math.log10(((ends - 0.5) / n if whole else 0.0) + rest * end / begins)
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(sum(logp(w.decode()) for w in words_of(t)) + close, rel=1e-9)


# --- packing, token files, top k -------------------------------------------------------------------------------------------------


def test_packing_doesnt_depend_on_the_files(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id % 7, ' '), cast(20 + id * 37 % 211 as int))").alias("text"))
    fills = []
    for files in (1, 4, 200):
        seqs = Counter()
        for r in packing.pack_documents(docs.repartition(files), BYTE, window=256).collect():
            seqs[r.sequence_id] += r.length
        fills.append(sorted(seqs.values()))
    assert fills[0] == fills[1] == fills[2] and sum(f < 256 for f in fills[0]) <= 8


def test_open_windows_are_bounded(monkeypatch):
    """Items of which no two fit in a window: the emptiest windows go into the fullest when too many are open."""
    monkeypatch.setattr(packing, "MOST_OPEN", 16)
    most = []
    real = packing.SumOfSquares.place
    monkeypatch.setattr(packing.SumOfSquares, "place", lambda self, piece: (real(self, piece), most.append((self.many, self.counts.sum())))[0])
    docs = [(i, np.arange(33 + i % 5, dtype="<u4").tobytes()) for i in range(500)]
    seqs = list(packing.pack(iter(docs), 64))
    assert max(n for n, _ in most) <= 16 and all(n == c for n, c in most)
    fills = [sum(len(p[3]) // 4 for p in w) for w in seqs]
    assert sum(fills) == sum(33 + i % 5 for i in range(500)) and sum(f < 64 for f in fills) <= 6
    places = Counter((p[0], p[1] + k) for w in seqs for p in w for k in range(len(p[3]) // 4))
    assert places == Counter((i, k) for i in range(500) for k in range(33 + i % 5))


def test_dictionary_samples_are_spread():
    ids = np.arange(1000, dtype="<u4").tobytes()
    parts = [np.frombuffer(p, "<u4").tolist() for p in token_files._spread(ids, 80, 8)]
    assert [len(p) for p in parts] == [10] * 8 and parts[0][0] == 0 and parts[-1][-1] == 999
    assert [b[0] - a[0] for a, b in zip(parts, parts[1:])] == pytest.approx([990 / 7] * 7, abs=1)
    assert token_files._spread(ids[:320], 80, 8) == [ids[:320]]


def test_repeated_query_ids_are_asked_for_each_row(spark):
    rows = [(100, [1.0, 2.0]), (100, [-3.0, 1.0]), (100, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (200, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0, k=3, block_rows=2).collect()))
    want = Counter()
    for q, a in rows:
        if q % 100 == 0:
            near = sorted((-int(1024 * 1024 * (a[0] * b[0] + a[1] * b[1])), c) for c, b in rows if c != q)[:3]
            want.update((q, n + 1, c, -s) for n, (s, c) in enumerate(near))
    assert got == want


def test_repeated_rows_are_mixed_one_by_one(spark):
    """A source of equal rows comes near its target as well; the query agrees with its SQL."""
    import duckdb

    from branchlight.llm import mixing, queries
    from tools.check import compare
    rows = [(1, "four words in here", "a", 0)] * 300 + [(None, None, None, 0)] * 3 + [(i, "w " * (i % 9 + 1), "bc"[i % 2], 0) for i in range(400)]
    rows += [(5, "same id", None, 0)] * 40 + [(5, "same id", "b", 0)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, uid int").repartition(6)
    out = mixing.mix(docs)
    taken = {}
    for r in out.collect():
        taken.setdefault((r.source_size, r.target), []).append(r.taken)
    assert len(taken) == 4 and all(abs(sum(v) - target) <= 10 for (_, target), v in taken.items())
    copies = Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect())
    times = Counter()
    for r in out.collect():
        times[r.doc_id, r.size] += r.taken // max(r.size, 1)
    assert copies[1, "a"] == times[1, 4] and copies[5, None] + copies[5, "b"] == times[5, 2]
    assert mixing.mixed_documents(docs).columns == docs.columns
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert compare(out, con, queries.ORACLES["op4_mixing"])[0] is None


# --- the pipeline ----------------------------------------------------------------------------------------------------------------

ODD = [(1, "The cat sat on a mat."), (2, None), (3, ""), (4, "The cat sat on a mat."), (4, "The cat sat on a mat."), (5, "long text " * 30_000),
       (None, "no id here at all"), (None, "no id here at all"), (None, None), (6, " \n\t "), (7, "ünïcode 中文 🙂 x")]
SHAPE = ("doc_id long, text string, lang string, source string, n_chars long, row long, score double, label int, fp long, root long, key long, "
         "size long, whole long, bound long, times long, uid long")


def odd(spark):
    return spark.createDataFrame([(i, t, None, "ab"[n % 2] if n % 3 else None, None, 1, 0.5, 1, 2, 3, 4, 5, 6, 7, 8, 9) for n, (i, t) in enumerate(ODD)], SHAPE)


@pytest.fixture
def folder(spark, tmp_path):
    labels = [(1, 1, 0), (4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0), (99, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES, ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, folder, name, stage):
    docs = odd(spark)
    rows = stage(spark, docs, folder)
    found = rows.collect()
    assert stage(spark, docs.where("false"), folder).collect() == []
    if name == "packing":
        assert {r.doc_id for r in found} == {i for i, _ in ODD} and sum(r.length for r in found if r.offset == 0) > 0
        return
    assert rows.columns == docs.columns
    given = Counter((i, t) for i, t in ODD)
    kept = Counter((r.doc_id, r.text) for r in found)
    assert set(kept) <= set(given)
    if name == "near_duplicates":
        # The three texts without words are one component; repeated texts are another each.
        assert sorted(kept.values()) == [1] * len(kept) and sum((t or "").split() == [] for _, t in kept) == 1
        assert {t for _, t in kept} >= {"The cat sat on a mat.", "no id here at all"} and len(kept) == 5
    if name == "mixing":
        assert all(n <= 3 * given[k] for k, n in kept.items())
    if name in ("toxicity", "quality"):
        assert all(n == given[k] for k, n in kept.items())  # equal rows are kept or dropped together


def test_the_pipeline_runs_on_nothing(spark, folder):
    odd(spark).where("false").write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
