"""Packing token ids into fixed windows by sum-of-squares online packing.

Documents of a partition arrive in id order. A document longer than the window fills whole windows; its rest is one item.
``counts[h]`` is the number of open windows filled to level h. An item of size s goes to the level h (0: a new window) at
which the sum of the squared counts ends smallest, ties to the fullest. Full windows are handed out at once. When MOST_OPEN
windows are open, the emptiest ones are emptied, cutting pieces freely, into the fullest, and only the rest stays
open: a task never holds more. So it goes when the partition ends, and what then is left of the last window is cut into windows
of powers of two, which need no padding. Partitions are merged until they have about PARTITION_BYTES of text, so
that these rests are few, however many files the documents lie in.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoded

Piece = tuple[int | None, int, int, bytes]  # doc_id, start in the document, the document's ids, ids of the piece
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Open windows that a task holds at most, and bytes of text that a partition has at least, unless there are fewer in all.
MOST_OPEN, PARTITION_BYTES = 2048, 8 << 20
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")]
                   + [("ids", pa.binary())])


class SumOfSquares:
    """Open windows by fill level, and the choice of a level for the next item."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # level 0 and the full level stay 0
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.many = 0  # open windows

    def level(self, size: int) -> int:
        """The level on which an item of ``size`` (below the window) changes the sum of squares least."""
        c, top = self.counts, self.window - size
        # After placing on level h: one window fewer at h, one more at h + size unless that is full.
        change = 2 * (c[size: self.window + 1] - c[: top + 1]) + 2
        change[top] -= 2 * c[self.window] + 1  # a full window leaves the counts
        change[0] = 2 * c[size] + 1  # a new window
        change[1:][c[1: top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put an item into a window; the window, if that filled it."""
        size = len(piece[3]) // 4
        h = self.level(size)
        window = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.many -= 1
        window.append(piece)
        if h + size == self.window:
            return window
        self.many += 1
        self.counts[h + size] += 1
        self.open[h + size].append(window)
        return None

    def merge(self) -> Iterator[list[Piece]]:
        """Full windows, by emptying the emptiest open ones into the fullest; what is left is one open window at most."""
        left = [w for level in reversed(self.open) for w in level]  # the fullest first
        fills = [sum(len(p[3]) for p in w) // 4 for w in left]
        full, rest = divmod(sum(fills), self.window)
        # The emptiest windows hold at least as much as the others lack.
        pool = deque(p for w in left[full:] for p in w)
        for window, filled in zip(left[:full], fills):
            yield _fill(window, self.window - filled, pool)
        self.counts[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.many = int(rest > 0)
        if rest:
            self.counts[rest] = 1
            self.open[rest].append(list(pool))

    def close(self) -> Iterator[list[Piece]]:
        """All open windows, filled up from each other; the rest in windows of powers of two."""
        yield from self.merge()
        rest = int(np.argmax(self.counts))
        pool = deque(p for w in self.open[rest] for p in w)
        for bit in reversed(range(rest.bit_length())):
            if rest >> bit & 1:
                yield _fill([], 1 << bit, pool)


def _fill(window: list[Piece], lack: int, pool: deque[Piece]) -> list[Piece]:
    while lack:
        part, more = _cut(pool.popleft(), lack)
        if more:
            pool.appendleft(more)
        window.append(part)
        lack -= len(part[3]) // 4
    return window


def _cut(piece: Piece, size: int) -> tuple[Piece, Piece | None]:
    doc, start, tokens, ids = piece
    if len(ids) <= 4 * size:
        return piece, None
    return (doc, start, tokens, ids[: 4 * size]), (doc, start + size, tokens, ids[4 * size:])


def pack(docs: Iterator[tuple[int | None, bytes]], window: int) -> Iterator[list[Piece]]:
    """Windows, each a list of pieces, of (doc_id, serialized ids) in order; together they hold every id once."""
    packer = SumOfSquares(window)
    for doc_id, ids in docs:
        n = len(ids) // 4
        for start in range(0, n, window):
            piece = (doc_id, start, n, ids[4 * start: 4 * (start + window)])
            done = [piece] if len(piece[3]) == 4 * window else packer.place(piece)
            if done:
                yield done
            elif packer.many >= MOST_OPEN:
                yield from packer.merge()
    yield from packer.close()


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids.

    Every partition packs its own documents, without a shuffle; small input partitions are read together, by the bytes of text that
    a first pass adds up. A null text is the empty text (its only id is the end id); a null
    doc_id is kept; repeated rows are packed once each; other columns are not read. No documents give no pieces.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32

        def rows():
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    part = b.slice(at, 1000)
                    yield from zip(part.column("doc_id").to_pylist(),
                                   encoded(tokenizer, part.column("text").to_pylist(), end_id))

        out: list[tuple] = []
        for number, pieces in enumerate(pack(rows(), window)):
            offset = 0
            for doc, start, tokens, ids in pieces:
                out.append((doc, start, len(ids) // 4, tokens, base + number, offset, ids))
                offset += len(ids) // 4
            if len(out) >= 1000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first().bytes or 0
    # In id order a task that is run again packs the same windows.
    return (rows.coalesce(max(1, math.ceil(size / PARTITION_BYTES))).sortWithinPartitions("doc_id", "text")
            .mapInArrow(run, PIECES))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
