"""Hashes of words and word windows over whole batches of texts, with numpy only."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Two independent 64-bit hashes from two seeds; equal words hash alike on every machine."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bytes = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.step = rng.integers(0, 2**62, dtype=np.uint64) * np.uint64(8) + np.uint64(5)
        self.slots = rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.ones(1, dtype=np.uint64)

    def _power(self, n: int) -> np.ndarray:
        if n > len(self.powers):
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 256), self.step, dtype=np.uint64)], dtype=np.uint64)
        return self.powers

    def words(self, body: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """body: the bytes of all words, one after another."""
        if not len(starts):
            return np.empty(0, dtype=np.uint64)
        within = np.arange(len(body)) - np.repeat(starts, lengths)
        value = self.bytes[body] * self._power(int(lengths.max()))[within]
        return mix(np.add.reduceat(value, starts) + lengths.astype(np.uint64) * _ODD)

    def windows(self, words: np.ndarray, size: int) -> np.ndarray:
        """The hash of each run of ``size`` words, by where it starts."""
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        total = np.zeros(n, dtype=np.uint64)
        for j in range(size):
            total += words[j : j + n] * self.slots[j]
        return mix(total)


def cut_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all words, their starts in these, their lengths, the text of each word)."""
    data = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    solid = ~_BLANK[data]
    edge = np.diff(np.r_[False, solid, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = end - begin
    text_end = np.cumsum(sizes + 1)  # each text and the blank that follows it
    return data[solid], np.cumsum(lengths) - lengths, lengths, np.searchsorted(text_end, begin, side="right")
