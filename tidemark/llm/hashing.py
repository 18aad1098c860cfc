"""Hashes of all words of a byte buffer at once."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 17  # bytes whose running sums are held at once


class WordHasher:
    """64-bit polynomial hashes of slices of a buffer through running sums: a few vector operations per byte, none per word."""

    def __init__(self, factor: int, seed: int) -> None:
        self.factor = factor
        self.letters = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        """Running sums of a buffer, from which any of its slices is hashed."""
        if len(self.powers) < len(raw):
            n = 1 << int(len(raw)).bit_length()
            self.powers, self.inverse = (
                np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64) for base in (self.factor, pow(self.factor, -1, 2**64))
            )
        return np.concatenate([[np.uint64(0)], np.cumsum(self.letters[raw] * self.powers[: len(raw)], dtype=np.uint64)])

    def between(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray, add: np.ndarray | int = 0) -> np.ndarray:
        """Odd hashes of the slices begin:end; ``add`` tells apart equal words that are to count as different."""
        h = (sums[end] - sums[begin]) * self.inverse[begin] + np.asarray(add, np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) | np.uint64(1)

    def __call__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray, add: np.ndarray | int = 0) -> np.ndarray:
        """Hashes of the slices begin:end, ``begin`` ascending. The buffer is taken in pieces, so that the tables of powers
        stay small; a slice longer than a piece is a piece of its own."""
        out, add, at = np.empty(len(begin), np.uint64), np.broadcast_to(np.asarray(add, np.uint64), len(begin)), 0
        while at < len(begin):
            low = begin[at]
            to = max(at + 1, int(np.searchsorted(begin, low + PIECE)))
            sums = self.sums(raw[low : end[at:to].max()])
            out[at:to] = self.between(sums, begin[at:to] - low, end[at:to] - low, add[at:to])
            at = to
        return out
