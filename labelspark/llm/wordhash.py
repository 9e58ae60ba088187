"""Word and word-sequence hashes of whole Arrow batches with numpy.

Texts are read as UTF-8 bytes, so a batch is one byte array.  A word's hash is a polynomial over its bytes, read off
sums between word starts; no Python string is made.  Work is done in pieces of bounded length, so that memory beyond the
text itself is a few words' worth of hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20  # text handled at once; a longer document is a slice of its own
BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8


def word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    """Which byte values belong to words: all but those in the given inclusive ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low:high + 1] = False
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of values of about ``size`` bytes together; at least one value each."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


class WordHasher:
    """Hashes of the words of texts, with A-Z read as a-z."""

    def __init__(self, is_word: np.ndarray):
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.is_word = is_word = is_word[lower]
        weights = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.weights = np.where(is_word, weights[lower], np.uint64(0))
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, PIECE_BYTES + 4096)
            for name, base in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash per word, word bounds per text, position of each word's first byte)."""
        found, places, low, end = [], [], int(offsets[0]), int(offsets[-1])
        while low < end:
            high = min(low + PIECE_BYTES, end)
            while high < end and self.is_word[data[high]]:  # never cut inside a word
                rest = np.flatnonzero(~self.is_word[data[high:min(high + 65536, end)]])
                high = high + int(rest[0]) if len(rest) else min(high + 65536, end)
            piece = data[low:high]
            inside = self.is_word[piece]
            start = inside.copy()
            start[1:] &= ~inside[:-1]
            edges = offsets[np.searchsorted(offsets, low):np.searchsorted(offsets, high)] - low
            start[edges] = inside[edges]
            starts = np.flatnonzero(start)
            if len(starts):
                self._reach(len(piece))
                sums = np.add.reduceat(self.weights[piece] * self.powers[:len(piece)], starts)
                found.append(mix(sums * self.inverses[starts]))
                places.append(starts + low)
            low = high
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
        first = np.concatenate(places)
        return np.concatenate(found), np.searchsorted(first, offsets), first


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` consecutive words, regardless of text bounds."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        total = total * np.uint64(BASE) + words[j:j + n]
    return mix(total)


def whole(words: np.ndarray) -> np.uint64:
    """The hash of one whole word sequence."""
    return grams(words, len(words))[0]
