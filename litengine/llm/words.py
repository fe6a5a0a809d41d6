"""Words, word hashes and shingles of a whole Arrow batch at once, as numpy arrays over its UTF-8 bytes.

A word is a maximal run of bytes outside x20 and x09-x0D; UTF-8 never uses those inside a longer character, so bytes
and characters give the same words. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes hashed at a time; a single longer word still goes in one piece.
_BLOCK = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_TABLES.get("up", ())) < n:
        _TABLES["up"], _TABLES["down"] = _powers(_BASE, n), _powers(_BASE_INVERSE, n)
    return _TABLES["up"], _TABLES["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. Text r has the words first[r] to first[r + 1]; word i is data[start[i]:end[i]]."""

    data: np.ndarray
    rows: np.ndarray  # byte offsets of the texts
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, the same wherever the word stands."""
        n, out, i = len(self.start), np.empty(len(self.start), np.uint64), 0
        while i < n:
            lo = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, lo + _BLOCK, "right")))
            hi = self.end[j - 1]
            up, down = _tables(int(hi - lo))
            values = _BYTE[_LOWER[self.data[lo:hi]]] * up[: hi - lo]
            at = np.empty(2 * (j - i), np.int64)
            at[::2], at[1::2] = self.start[i:j] - lo, self.end[i:j] - lo
            sums = np.add.reduceat(np.append(values, np.uint64(0)), at)[::2]
            out[i:j] = mix(sums * down[self.start[i:j] - lo])
            i = j
        return out

    def row(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def characters(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Code points between the start of a text and a byte offset in it."""
        lead = np.concatenate(([0], np.cumsum((self.data & 0xC0) != 0x80)))
        return lead[at] - lead[self.rows[row]]


def batches(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about so many bytes, so that memory does not follow the size of Arrow's batches."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + size, "right")) - 1)
        j = min(j, len(texts))
        yield i, j
        i = j


def split(texts: pa.Array) -> Words:
    """The words of each text; a null text is empty."""
    if len(texts) == 0:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64), z, z)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    rows = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[rows[0] : rows[-1]] if raw is not None and rows[-1] > rows[0] else np.zeros(0, np.uint8)
    rows = rows - rows[0]
    if not len(data):
        z = np.zeros(0, np.int64)
        return Words(data, rows, np.zeros(len(rows), np.int64), z, z)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[rows] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, rows, np.searchsorted(start, rows, "left"), start, end)


def fold(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words: out[i] covers words i to i + n - 1 of the batch."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m])
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles as sorted int64; with fewer words, the whole sequence as one; without words none."""
    words = split(texts)
    hashes = words.hashes()
    runs = fold(hashes, n)
    for r in range(len(texts)):
        i, j = words.first[r], words.first[r + 1]
        if j - i >= n:
            yield np.unique(runs[i : j - n + 1].view(np.int64))
        elif j > i:
            yield (fold(hashes[i:j], j - i) ^ np.uint64(j - i)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
