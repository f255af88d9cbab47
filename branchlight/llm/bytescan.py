"""Vectorised passes over the bytes of a batch of texts: words and lines as hashes, without a Python object for each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SEGMENT = 1 << 15
_FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers can be divided out modulo 2**64
_powers: list[np.ndarray] = []


def text_groups(texts: pa.Array, most_bytes: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, n + 1 offsets) of runs of whole texts, each run of about ``most_bytes``. Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + most_bytes, "right")) - 1)
        yield raw[at[first]: at[last]], at[first: last + 1] - at[first]
        first = last


def byte_table(keep) -> np.ndarray:
    """A table from byte to byte for ``runs``: 0 for separators, A-Z lower-cased. Bytes of other scripts are kept."""
    return np.array([0 if not keep(b) else b + 32 if 65 <= b <= 90 else b or 1 for b in range(256)], np.uint8)


WORDS = byte_table(lambda b: b >= 128 or chr(b).isalnum())
#: Runs between the bytes of white space.
CHUNKS = byte_table(lambda b: b not in b" \t\n\r\x0b\x0c")
LINES = byte_table(lambda b: b not in b"\r\n")


def mixed(h: np.ndarray) -> np.ndarray:
    """Every output bit depends on all input bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the factor and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 1)
        made = [np.full(size, f, np.uint64) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
        for p in made:
            p[0] = 1
            np.cumprod(p, out=p)
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, length in bytes) of each maximal run of bytes that ``table`` keeps, in order; none spans two texts."""
    plain = table[data]
    inside = plain != 0
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = np.empty(len(first), np.uint64)
    a = 0
    while a < len(first):  # a segment ends where a run ends; a single longer run is a segment of its own
        b = max(a + 1, int(np.searchsorted(last, first[a] + _SEGMENT, "right")))
        base, n = first[a], last[b - 1] - first[a]
        power, inverse = _scales(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(plain[base: base + n].astype(np.uint64) * power[:n], out=total[1:])
        out[a:b] = (total[last[a:b] - base] - total[first[a:b] - base]) * inverse[first[a:b] - base]
        a = b
    return mixed(out), np.searchsorted(offsets, first, "right") - 1, last - first


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by sorting."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
