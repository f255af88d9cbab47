"""Language-model scores by subword lattice likelihood.

The vocabulary is that of an existing public tokenizer. A word's lattice has an edge for every vocabulary piece that it
holds, and the forward recursion adds, in log space, the weights of all segmentations to the word's marginal
probability Q(word). Pieces that start with the word mark begin a word; no other edge crosses a word's border, so a text's
marginal is the product over its words and the end.

Piece weights start from the vocabulary's own scores (its segmentation of the corpus's words, and a Zipf law over the merge
ranks) and are fitted to the corpus by expectation maximisation over the distinct words and their counts. As usual for words that were seen often, the
lattice also has an edge for the whole word: its discounted count, (c - d) / N, and what the discounts free, d for each
distinct token, weights the segmentations into pieces. All token probabilities add up to one.

Counts are aggregated per task before the shuffle. Words with at least a HEADth of all tokens (so at most HEAD words) and at most
LONGEST bytes are broadcast with their scores; all other words of a text are joined with the count table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions_for, words_of, written

MARK = "▁"
#: Common words that are broadcast, at most, and their bytes.
HEAD, LONGEST = 1_000_000, 64
ALPHA, DISCOUNT = 0.1, 0.5
#: Words with fewer letters: their probability is above 1e-300, as no piece's is below 1e-14.
SHORT = 20
#: Bits of a letter's code point.
LETTER = 21
_FLUSH = 200_000


class Vocabulary:
    """Pieces usable within one word and their first weights, from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.path = path
        self.pieces: list[str] = []
        self.places = np.full(model.get_piece_size(), -1)  # the piece of each of the tokenizer's ids
        self.bytes = [0] * 256  # the piece of each byte
        weights = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = len(self.pieces)
            elif model.is_control(i) or model.is_unknown(i) or not piece or MARK in piece[1:]:
                continue
            self.places[i] = len(self.pieces)
            self.pieces.append(piece)
            # Scores of merges are minus their ranks; bytes and letters have the lowest.
            weights.append(1.0 / (10.0 - model.get_score(i)))
        self.starts = np.array([p.startswith(MARK) for p in self.pieces])
        self.first = np.array(weights) / sum(weights)
        self._build_trie()

    def _build_trie(self) -> None:
        """The pieces as a trie in arrays: sorted keys (node, letter), the node each leads to, and the piece that ends at a node."""
        byte_pieces, steps, ends = set(self.bytes), {}, [-1]
        for i, piece in enumerate(self.pieces):
            if i in byte_pieces:
                continue
            node = 0
            for letter in piece:
                key = node << LETTER | ord(letter)
                node = steps.get(key, 0)
                if not node:
                    node = steps[key] = len(ends)
                    ends.append(-1)
            ends[node] = i
        self.keys = np.array(sorted(steps), np.int64)
        self.nodes = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends)

    def segmented(self, words: list[str]) -> list[list[int]]:
        """The tokenizer's own segmentation of each word."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return model.encode([w.encode("utf-8", "replace").decode() for w in words], num_threads=1)


_PREFIXES: dict[str, dict[str, int]] = {}


def _prefixes(vocabulary: Vocabulary) -> dict[str, int]:
    """The number of each piece and -1 for each other prefix of one, kept by the worker for its next tasks."""
    if vocabulary.path not in _PREFIXES:
        byte_pieces = set(vocabulary.bytes)
        edges = {piece: i for i, piece in enumerate(vocabulary.pieces) if i not in byte_pieces}
        for piece in list(edges):
            for n in range(1, len(piece)):
                edges.setdefault(piece[:n], -1)
        _PREFIXES[vocabulary.path] = edges
    return _PREFIXES[vocabulary.path]


class Lattice:
    """Forward (and backward) recursions over the segmentations of words, given the pieces' probabilities.

    Short words of one length go through together, as arrays; long words and those with a letter that no piece has, one by one
    and in log space.
    """

    def __init__(self, vocabulary: Vocabulary, probabilities: np.ndarray):
        self.vocabulary, self.probabilities = vocabulary, probabilities
        self.logs = np.log(probabilities).tolist()
        self.bytes = [(i, self.logs[i]) for i in vocabulary.bytes]
        self.known = _prefixes(vocabulary)

    @property
    def edges(self) -> dict[str, tuple[int, float] | None]:
        """(number, log weight) of each piece, None for each other prefix of one."""
        return {k: (i, self.logs[i]) if i >= 0 else None for k, i in self.known.items()}

    def _steps(self, word: str) -> list[list[tuple[int, float, list[int]]]]:
        """From each place: (place reached, log weight, pieces) of the edges. A letter without a piece takes its bytes."""
        get, n, out = self.known.get, len(word), []
        for i in range(n):
            here = []
            for j in range(i + 1, n + 1):
                edge = get(word[i:j])
                if edge is None:
                    break
                if edge >= 0:
                    here.append((j, self.logs[edge], [edge]))
            if not here or here[0][0] != i + 1:
                spelled = [self.bytes[b] for b in word[i].encode("utf-8", "surrogatepass")]
                here.append((i + 1, sum(w for _, w in spelled), [p for p, _ in spelled]))
            out.append(here)
        return out

    def log_marginal(self, word: str) -> float:
        """Natural log of the sum over all segmentations of the word mark and ``word``."""
        word = MARK + word
        get, n, bytes_, logs = self.known.get, len(word), self.bytes, self.logs
        alpha = [-math.inf] * n + [-math.inf]
        alpha[0] = 0.0
        exp, log1p = math.exp, math.log1p
        for i in range(n):
            a = alpha[i]
            single = False
            for j in range(i + 1, n + 1):
                edge = get(word[i:j])
                if edge is None:
                    break
                if edge >= 0:
                    single = single or j == i + 1
                    x, y = alpha[j], a + logs[edge]
                    if y > x:
                        x, y = y, x
                    alpha[j] = x + log1p(exp(y - x)) if y > x - 40 else x
            if not single:
                y = a + sum(bytes_[b][1] for b in word[i].encode("utf-8", "surrogatepass"))
                x = alpha[i + 1]
                if y > x:
                    x, y = y, x
                alpha[i + 1] = x + log1p(exp(y - x)) if y > x - 40 else x
        return alpha[n]

    def _blocks(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers, letters) of the short words, those of one length together, word mark first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for n in np.unique(size[size < SHORT]).tolist():
            own = np.flatnonzero(size == n)
            letters = "".join([MARK + words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass")
            yield own, np.frombuffer(letters, "<u4").reshape(len(own), n + 1).astype(np.int64)

    def _edges(self, letters: np.ndarray) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(from, to, rows, pieces) in order of places, and which rows have a letter without a piece."""
        v, (many, n) = self.vocabulary, letters.shape
        out, spelled = [], np.zeros(many, bool)
        for i in range(n):
            rows, node, single = np.arange(many), np.zeros(many, np.int64), np.zeros(many, bool)
            for j in range(i, n):
                key = node << LETTER | letters[rows, j]
                at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
                hit = v.keys[at] == key
                rows, node = rows[hit], v.nodes[at[hit]]
                if not len(rows):
                    break
                piece = v.ends[node]
                some = piece >= 0
                if j == i:
                    single[rows[some]] = True
                out.append((i, j + 1, rows[some], piece[some]))
            spelled |= ~single
        return out, spelled

    def _forward(self, letters: np.ndarray, edges) -> np.ndarray:
        # In a short word no product of weights leaves the range of doubles.
        alpha = np.zeros((len(letters), letters.shape[1] + 1))
        alpha[:, 0] = 1.0
        for i, j, rows, piece in edges:
            alpha[rows, j] += alpha[rows, i] * self.probabilities[piece]
        return alpha

    def log_marginals(self, words: list[str]) -> np.ndarray:
        """``log_marginal`` of each word."""
        out = np.full(len(words), np.nan)
        for own, letters in self._blocks(words):
            edges, spelled = self._edges(letters)
            alpha = self._forward(letters, edges)
            out[own[~spelled]] = np.log(alpha[~spelled, -1])
        for i in np.flatnonzero(np.isnan(out)).tolist():
            out[i] = self.log_marginal(words[i])
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """The expected uses of each piece in ``counts`` times each word."""
        into, done = np.zeros(len(self.probabilities)), np.zeros(len(words), bool)
        for own, letters in self._blocks(words):
            edges, spelled = self._edges(letters)
            alpha = self._forward(letters, edges)
            beta = np.zeros(alpha.shape)
            beta[~spelled, -1] = counts[own[~spelled]] / alpha[~spelled, -1]
            pieces, uses = [np.zeros(0, np.int64)], [np.zeros(0)]
            for i, j, rows, piece in reversed(edges):
                y = beta[rows, j] * self.probabilities[piece]
                beta[rows, i] += y
                pieces.append(piece)
                uses.append(alpha[rows, i] * y)
            into += np.bincount(np.concatenate(pieces), np.concatenate(uses), len(into))
            done[own[~spelled]] = True
        rest = into.tolist()
        for i in np.flatnonzero(~done).tolist():
            self._expect_long(words[i], float(counts[i]), rest)
        return np.array(rest)

    def expect(self, word: str, count: float, into: list[float]) -> None:
        """Add the expected uses of each piece in ``count`` words to ``into``."""
        uses = self.expected([word], np.array([count], float))
        for p in np.flatnonzero(uses).tolist():
            into[p] += float(uses[p])

    def _expect_long(self, word: str, count: float, into: list[float]) -> None:
        """The same with logarithms."""
        steps = self._steps(MARK + word)
        n = len(steps)
        alpha, beta = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        alpha[0] = beta[n] = 0.0
        exp, log1p = math.exp, math.log1p
        for i, here in enumerate(steps):
            for j, w, _ in here:
                x, y = alpha[j], alpha[i] + w
                if y > x:
                    x, y = y, x
                alpha[j] = x + log1p(exp(y - x)) if y > x - 40 else x
        total = alpha[n]
        for i in range(n - 1, -1, -1):
            for j, w, pieces in steps[i]:
                y = beta[j] + w
                share = alpha[i] + y - total
                if share > -20:
                    use = count * exp(share)
                    for p in pieces:
                        into[p] += use
                x = beta[i]
                if y > x:
                    x, y = y, x
                beta[i] = x + log1p(exp(y - x)) if y > x - 40 else x


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogatepass")


def word_counts(docs: DataFrame, learns: Column) -> DataFrame:
    """(word, c) of every word of ``docs``; c counts it in the documents that ``learns`` selects, 0 if only others hold it."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            kept = pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())
            seen.clear()
            return pa.RecordBatch.from_arrays(list(kept), names=["word", "c"])

        for batch in batches:
            for text, learn in zip(batch.column("text").to_pylist(), batch.column("learns").to_pylist()):
                words = words_of(text)
                if learn:
                    seen.update(words)
                else:
                    for w in words:
                        if w not in seen:
                            seen[w] = 0
                if len(seen) > _FLUSH:
                    yield out()
        yield out()

    rows = docs.select("text", learns.alias("learns")).mapInArrow(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, vocabulary: Vocabulary, ends: int, rounds: int = 2, floor: float = 0.01
               ) -> tuple[np.ndarray, float]:
    """Probabilities of the pieces and of the end, adding up to one.

    The first weights mix, 9 to 1, the pieces' uses in the vocabulary's own segmentation of every word and its rank weights;
    then come ``rounds`` of expectation maximisation. Only sums by piece come to the driver: as many numbers as the
    vocabulary has pieces.
    """
    spark = words.sparkSession
    known = words.where("c > 0")

    def uses(run) -> np.ndarray:
        out = np.zeros(len(vocabulary.pieces))
        for r in (known.mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()):
            out[r.piece] = r.uses
        return out

    def sums(into: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(into)
        return pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int64()), "uses": pa.array(into[some])})

    given = spark.sparkContext.broadcast(vocabulary)

    def segment(batches):
        into = np.zeros(len(given.value.pieces))
        for batch in batches:
            found = given.value.segmented([_text(w) for w in batch.column("word").to_pylist()])
            each = np.repeat(batch.column("c").to_numpy(), [len(x) for x in found])
            at = given.value.places[np.array([i for x in found for i in x], np.int64)]
            into += np.bincount(at[at >= 0], each[at >= 0], len(into))
        yield sums(into)

    hard = uses(segment)
    p = (0.9 * hard / hard.sum() if hard.any() else 0.9 * vocabulary.first) + 0.1 * vocabulary.first
    end = 0.0
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((vocabulary, p))

        def expect(batches):
            lattice, into = Lattice(*held.value), np.zeros(len(held.value[1]))
            for batch in batches:
                words = [_text(w) for w in batch.column("word").to_pylist()]
                into += lattice.expected(words, batch.column("c").to_numpy())
            yield sums(into)

        soft = uses(expect) + floor
        total = soft.sum() + ends + floor
        p, end = soft / total, (ends + floor) / total
    return p, end


def score_documents(docs: DataFrame, vocabulary_file: str, learns: Column, whole_words: bool = True) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; logarithms to base 10.

    Tokens are a text's words (split at ASCII white space, A-Z lower-cased) and one end. ``learns``, an expression over
    doc_id, selects the documents to learn from. base_score adds log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens. Null
    texts are empty (the end alone); null ids and repeated rows are kept and count each time; with nothing to learn from, the pieces
    keep their first weights. Columns other than doc_id and text are not read. Without ``whole_words`` the lattice has no edges but
    the vocabulary's pieces.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    vocabulary = Vocabulary(vocabulary_file)
    ends = docs.where(learns).count()
    words = written(word_counts(docs, learns), "words")
    n, distinct, freed = words.where("c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.least("c", F.lit(DISCOUNT))), F.lit(0.0))).first()
    n, distinct, freed = n + ends, distinct + (ends > 0), freed + min(ends, DISCOUNT)
    # Partitions by the number of words: their lattices are the work, not their bytes.
    p, end = fit_pieces(words.repartition(partitions_for(words, 50_000)), vocabulary, ends)
    rest = freed / n if n and whole_words else 1.0
    begins = p[vocabulary.starts].sum() + end
    below = n + ALPHA * (distinct + 1)

    def base(c: int) -> float:
        return math.log10((c + ALPHA) / below)

    held = spark.sparkContext.broadcast((vocabulary, p))

    def weigh(batches):
        lattice, log_rest = Lattice(*held.value), math.log(rest)
        for batch in batches:
            counts = batch.column("c").to_pylist()
            q = log_rest + lattice.log_marginals([_text(w) for w in batch.column("word").to_pylist()])
            # Log space keeps the lattice's share where it is below the smallest double.
            with np.errstate(divide="ignore"):
                seen = np.log(np.maximum(np.array(counts) - DISCOUNT, 0.0) / max(n, 1)) if whole_words else -np.inf
                out = np.logaddexp(q, seen) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(map(base, counts), pa.float64()),
                                              pa.array(out, pa.float64())], names=["word", "c", "base", "logp"])

    kind = "word binary, c long, base double, logp double"
    weighed = written(words.repartition(partitions_for(words, 50_000)).mapInArrow(weigh, kind), "weighed-words")
    often = max(1, math.ceil(n / HEAD))
    head = weighed.where((F.col("c") >= often) & (F.octet_length("word") <= LONGEST))
    common = {bytes(r.word): (r.base, r.logp) for r in head.collect()} if n > HEAD else {}
    shared = spark.sparkContext.broadcast(common)
    end_base = base(ends)
    end_logp = math.log10((max(ends - DISCOUNT, 0.0) / n if n and whole_words else 0.0) + rest * max(end, 1e-12) / begins)

    def texts(batches):
        head, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for text in part.column("text").to_pylist():
                    found = words_of(text)
                    known, b, q, rare, times = int(ends > 0), end_base, end_logp, [], []
                    for word, k in Counter(found).items():
                        hit = head.get(word)
                        if hit is None:
                            rare.append(word)
                            times.append(k)
                        else:
                            known += k
                            b += k * hit[0]
                            q += k * hit[1]
                    out.append((row, len(found) + 1, known, b, q, rare, times))
                    row += 1
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "row", "n_tokens", "known", "base", "logp", "rare", "times"])

    # Written once: the row numbers must stay the same for both uses below.
    rows = written(docs.mapInArrow(texts, "doc_id long, row long, n_tokens long, known long, base double, logp double, "
                                          "rare array<binary>, times array<long>"), "scored-texts")
    tail = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select(
        "row", F.col("r.rare").alias("word"), F.col("r.times").alias("k"))
    sums = (tail.join(weighed, "word").groupBy("row")
            .agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"),
                 F.sum(F.col("k") * F.col("base")).alias("more_base"), F.sum(F.col("k") * F.col("logp")).alias("more_logp")))
    return rows.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("logp") + F.coalesce("more_logp", F.lit(0.0))).alias("score"))
