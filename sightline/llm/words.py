"""Words as 64-bit hashes, and hashes of runs of words, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

PUNCTUATION = ".,;:!?\"'()[]{}<>|*#&$%-_=+/\\~`^@"
#: Words whose hash a task remembers before it starts anew.
REMEMBERED = 500_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Word → hash of the word without punctuation at its ends; pure punctuation stands for itself."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest((word.strip(PUNCTUATION) or word).encode())
        return value

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the lower-cased words of a text, split at white space."""
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * _MULTIPLIER + words[i : i + n]
    return mixed(total)


def occurrences(values: np.ndarray) -> np.ndarray:
    """For each value, how many equal ones stand before it."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    counts = np.empty(len(values), np.uint64)
    counts[order] = (np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))).astype(np.uint64)
    return counts


def odd_numbers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
