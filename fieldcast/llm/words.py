"""Words of many texts at once, as numpy arrays over one byte buffer.

White space and the ASCII delimiters used here are single bytes in UTF-8, so words are cut on bytes and no text is
decoded. Words are told apart by their bytes first; each different one of a slice is hashed once, by a hash that isn't
linear in the bytes (XXH3 with a seed), so that equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: [\x20\x09-\x0D]
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: [\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing
NO_LETTER_OR_DIGIT = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: [\x00-\x40\x5B-\x60\x7B-\x7F], after lower-casing
NO_LETTER = np.isin(np.arange(256), [*range(0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: bytes handled together
CHUNK = 500_000
#: seeds of the hashes of words
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Texts:
    """Some texts in one buffer: `data`, `begin` and `end` of each text, and their words."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, delimiter: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.begin, self.end = begin, end
        inside = ~delimiter[self.data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[begin] = False
        after = np.zeros(len(data) + 1, bool)
        after[: len(data)] = inside
        after[end] = False
        self.inside = inside
        self.start = np.flatnonzero(inside & ~before[:-1])
        self.stop = np.flatnonzero(inside & ~after[1:]) + 1
        #: first word of each text, and one past its last
        self.first = np.searchsorted(self.start, begin)
        self.last = np.searchsorted(self.start, end)
        self._words: pa.DictionaryArray | None = None

    @property
    def n_words(self) -> np.ndarray:
        return self.last - self.first

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begin)), self.n_words)

    def encoded(self, start: np.ndarray, stop: np.ndarray) -> pa.DictionaryArray:
        """Byte ranges by number, equal ones alike."""
        return binaries(self.data, start, stop - start).dictionary_encode()

    def words(self) -> pa.DictionaryArray:
        if self._words is None:
            self._words = self.encoded(self.start, self.stop)
        return self._words

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges."""
        return hashed(self.encoded(start, stop), 0)

    def word_hashes(self, kind: int = 0) -> np.ndarray:
        """Hashes of the words; each `kind` is an independent one."""
        return hashed(self.words(), kind)

    def shingles(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of k words inside a text, in order."""
        n = np.maximum(self.n_words - k + 1, 0)
        at = runs(self.first, n)
        return np.repeat(np.arange(len(n)), n), shingle_hash(hashes, at, k)

    def total(self, per_byte: np.ndarray) -> np.ndarray:
        """Sum of a value per byte over each text."""
        sums = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return sums[self.end] - sums[self.begin]


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] of them), then those of first[1], and so on."""
    after = np.cumsum(n)
    return np.arange(after[-1] if len(n) else 0) + np.repeat(first - (after - n), n)


def hashed(encoded: pa.DictionaryArray, kind: int) -> np.ndarray:
    values = encoded.dictionary.to_pylist()
    hashes = np.fromiter((xxh3_64_intdigest(x, SEEDS[kind]) for x in values), np.uint64, len(values))
    return hashes[encoded.indices.to_numpy()]


def binaries(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.BinaryArray:
    """The byte ranges as one Arrow column."""
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    content = np.ascontiguousarray(data[runs(start, length)])
    return pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(content)])


def shingle_hash(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[at + i])
    return out


def texts_of(
    column: pa.Array, delimiter: np.ndarray = BLANK, lower: bool = False, chunk: int = CHUNK
) -> Iterator[tuple[int, int, Texts]]:
    """Slices of a string column (nulls are empty) of about `chunk` bytes: first row, one past the last, the texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, side="right")) - 1)
        part = data[offsets[a] : offsets[b]]
        yield a, b, Texts(part, offsets[a:b] - offsets[a], offsets[a + 1 : b + 1] - offsets[a], delimiter, lower)
        a = b
