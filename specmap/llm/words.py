"""Words of whole texts and their hashes, for many texts at once (NumPy over the bytes of an Arrow column).

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A null
text has no words. Arrow batches are cut by bytes, not by rows, so memory follows `SLICE` and the longest single text.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
SLICE = 1 << 21

#: Spans of up to so many bytes are hashed side by side, longer ones one by one.
SHORT_SPAN = 256
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes of text (or one row): the rows, their bytes, the row offsets."""
    column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of the texts in `data`, cut by `offsets`: starts, ends, text number, words per text, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        inside = ~_SEPARATOR[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | cut[1:-1]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        #: words of text i are first[i] … first[i+1]-1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span: eight bytes after the other are mixed in, so no structure of a text cancels."""
        length = ends - starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(self.data) + 1, np.dtype("<u8"), padded, strides=(1,))
        h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        live = np.flatnonzero(length <= SHORT_SPAN)
        for at in range(0, SHORT_SPAN, 8):
            live = live[length[live] > at]
            if not len(live):
                break
            part = eight[starts[live] + at] & _MASK[np.minimum(length[live] - at, 8)]
            h[live] = mix(h[live] ^ part) + np.uint64(at)
        for i in np.flatnonzero(length > SHORT_SPAN).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return h

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)

    def per_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the ascending byte positions lie in each text."""
        return np.diff(np.searchsorted(positions, self.offsets))


def window_hash(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of each k consecutive values of `h` (empty when there are fewer)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    c = np.uint64(0xD1342543DE82EF95 + 2 * seed)
    out = np.full(n, seed, np.uint64)
    for j in range(k):
        out = out * c + h[j : j + n]
    return mix(out)


def whole_windows(first: np.ndarray, counts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n windows of k consecutive words lie in one text."""
    ok = np.zeros(max(n, 0), bool)
    if n > 0:
        edge = np.zeros(n + 1, np.int64)
        live = counts >= k
        np.add.at(edge, first[:-1][live], 1)
        np.add.at(edge, (first[:-1] + counts - k + 1)[live], -1)
        ok = np.cumsum(edge[:-1]) > 0
    return ok


def unused(columns: list[str], *names: str) -> list[str]:
    """`names`, each lengthened until none of `columns` has it (whatever its case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
