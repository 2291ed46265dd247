"""Rolling hashes of words and bytes, for whole texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

MOST_WORDS = 200_000
_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered for frequent words; the memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 with an odd base, from sums over prefixes."""

    def __init__(self, which: int):
        self.base = _ODD[which] | 1
        self.back = pow(self.base, -1, 1 << 64)
        self.powers = self.backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            size = 1 << n.bit_length()
            grown = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)]))
            self.powers, self.backs = grown(self.base), grown(self.back)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the first i values, each times its power of the base, for i from 0."""
        self._grow(len(values) + 1)
        return np.concatenate([[np.uint64(0)], np.cumsum(values * self.powers[:len(values)], dtype=np.uint64)])

    def between(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end), equal for equal stretches anywhere."""
        return mixed((sums[end] - sums[start]) * self.backs[start])

    def windows(self, values: np.ndarray, length: int) -> np.ndarray:
        """The hash of every window of this length, by start."""
        sums = self.sums(values)
        n = max(0, len(values) - length + 1)
        return mixed((sums[length:length + n] - sums[:n]) * self.backs[:n])


def lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Where the smallest value of every window of ``width`` is; the leftmost of equal ones."""
    low, at, size = values, np.arange(len(values)), 1

    def joined(shift: int, n: int):
        a, b = low[:n], low[shift:shift + n]
        left = a <= b
        return np.where(left, a, b), np.where(left, at[:n], at[shift:shift + n])

    while size * 2 <= width:
        low, at = joined(size, len(low) - size)
        size *= 2
    if size < width:
        low, at = joined(width - size, len(low) - (width - size))
    return at
