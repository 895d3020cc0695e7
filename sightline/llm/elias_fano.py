"""Elias-Fano sequences and a two-level n-gram trie of them, kept as one block of bytes.

A trie holds (context, successor) pairs with a probability code each. Level one is the sorted contexts,
with a monotone pointer to each context's first successor, which bounds the search; level two is the successors of all contexts
as one rising sequence of `context place * SPAN + successor`. All three are Elias-Fano sequences. The
probabilities are one byte each, the index of 256 values evenly spaced from the least to the greatest.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np

_HEAD = struct.Struct("<qqqqq")


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


class EliasFano:
    """A rising sequence: low bits packed, high bits in unary. Opening it builds the place of each high part."""

    @staticmethod
    def packed(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        highs = (values >> np.uint64(low_bits)).astype(np.int64)
        bits = np.zeros((int(highs[-1]) if n else 0) + n + 2, np.uint8)
        bits[highs + np.arange(n)] = 1
        lows = values & np.uint64((1 << low_bits) - 1)
        words = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, lows << shift)
            spills = shift + np.uint64(low_bits) > np.uint64(64)
            np.bitwise_or.at(words, word[spills] + 1, lows[spills] >> (np.uint64(64) - shift[spills]))
        high = _padded(np.packbits(bits, bitorder="little").tobytes())
        return _HEAD.pack(n, low_bits, len(words), len(high), len(bits)) + words.tobytes() + high

    def __init__(self, buffer, at: int):
        self.n, self.low_bits, n_words, n_high, n_bits = _HEAD.unpack_from(buffer, at)
        at += _HEAD.size
        self.words = np.frombuffer(buffer, np.uint64, n_words, at)
        at += 8 * n_words
        bits = np.unpackbits(np.frombuffer(buffer, np.uint8, n_high, at), count=n_bits, bitorder="little")
        zeros = np.flatnonzero(bits == 0)
        #: elements whose high part is below h
        self.starts = np.concatenate([[0], zeros - np.arange(len(zeros))]).astype(np.int32 if self.n < 1 << 31 else np.int64)
        self.end = at + n_high

    def lows(self, places: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(places), np.uint64)
        at = places.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        over = np.where(shift > 0, self.words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.words[word] >> shift) | over) & np.uint64((1 << self.low_bits) - 1)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The values at these places."""
        high = np.searchsorted(self.starts, places, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(places)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1; with bounds, the place is searched from `begin` to before `end` only."""
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        low = values & np.uint64((1 << self.low_bits) - 1)
        last = len(self.starts) - 2
        known = high <= last
        high = np.minimum(high, last)
        a, b = self.starts[high], np.where(known, self.starts[high + 1], self.starts[high])
        if begin is not None:
            a, b = np.maximum(a, begin), np.maximum(np.maximum(a, begin), np.minimum(b, end))
        left, right = a.copy(), b.copy()
        while (going := left < right).any():
            middle = (left + right) // 2
            less = np.zeros(len(values), bool)
            less[going] = self.lows(middle[going]) < low[going]
            left = np.where(going & less, middle + 1, left)
            right = np.where(going & ~less, middle, right)
        found = left < b
        found[found] = self.lows(left[found]) == low[found]
        return np.where(found, left, -1)


def build_trie(contexts: np.ndarray, successors: np.ndarray, values: np.ndarray, span: int) -> bytes:
    """Bytes of a trie; pairs are sorted by (context, successor), and successors are below `span`."""
    heads, first = np.unique(contexts, return_index=True)
    place = np.repeat(np.arange(len(heads), dtype=np.uint64), np.diff(np.append(first, len(contexts))))
    least, most = (values.min(), values.max()) if len(values) else (0.0, 0.0)
    book = np.linspace(least, most, 256)
    codes = np.rint((values - least) / ((most - least) or 1.0) * 255).astype(np.uint8)
    levels = [heads, np.append(first, len(contexts)), place * np.uint64(span) + successors.astype(np.uint64)]
    parts = [struct.pack("<qq", span, len(codes)), book.astype(np.float64).tobytes()]
    return b"".join([*parts, *(EliasFano.packed(x) for x in levels), codes.tobytes()])


class Trie:
    """A trie over a file of build_trie(), mapped into memory."""

    def __init__(self, content: bytes):
        with tempfile.TemporaryFile() as file:
            file.write(content)
            file.flush()
            self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        self.span, n = struct.unpack_from("<qq", self.map)
        self.book = np.frombuffer(self.map, np.float64, 256, 16)
        self.contexts = EliasFano(self.map, 16 + 2048)
        self.pointers = EliasFano(self.map, self.contexts.end)
        self.successors = EliasFano(self.map, self.pointers.end)
        self.codes = np.frombuffer(self.map, np.uint8, n, self.successors.end)

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of pairs: the context's place, then its successor within the context's range."""
        place = self.contexts.find(contexts)
        known = np.flatnonzero(place >= 0)
        rank = place[known].astype(np.uint64)
        begin, end = (self.pointers.access(place[known] + i).astype(np.int64) for i in (0, 1))
        at = self.successors.find(rank * np.uint64(self.span) + successors[known].astype(np.uint64), begin, end)
        inside = at >= 0
        found, values = np.zeros(len(contexts), bool), np.zeros(len(contexts))
        found[known[inside]] = True
        values[known[inside]] = self.book[self.codes[at[inside]]]
        return found, values
