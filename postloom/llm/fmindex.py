"""A compressed FM-index over sequences of integers: suffix array, Burrows-Wheeler transform, wavelet matrix.

Sequences are put one after another with a separator each. Patterns are searched backwards, all at
once: in every step each pattern takes one more symbol to the left by rank queries on the wavelet
matrix, whose bits are packed and counted per 64.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of distinct-ended `symbols` by prefix doubling."""
    size = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        following = np.zeros(size, np.int64)
        following[:-step or None] = rank[step:] + 1 if step < size else 0
        key = rank * (size + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == size - 1 or step >= size:
            return order
        step *= 2


class WaveletMatrix:
    """Rank queries of symbols below `alphabet`, one packed bit row per binary digit."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.digits = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for digit in range(self.digits - 1, -1, -1):
            bits = (symbols >> digit) & 1
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))]))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])
        self.starts = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, digit in enumerate(range(self.digits - 1, -1, -1)):
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            below = (np.uint64(1) << bit) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)
            at = np.where((symbols >> digit) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.starts[symbols]


class FMIndex:
    """Index of sequences of symbols numbered from 0; `text` has symbol + 1, and 0 as separator."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = ends - lengths + np.arange(len(lengths))  # of each sequence in the text
        self.text = np.zeros(len(symbols) + len(lengths), np.int64)
        self.text[np.arange(len(symbols)) + owner] = symbols + 1
        # separators differ by their place, so every suffix differs from all others within its sequence
        apart = self.text + len(lengths)
        separators = self.starts + lengths
        apart[separators] = np.arange(len(lengths))
        self.suffixes = suffix_array(apart)
        alphabet = int(self.text.max(initial=0)) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=alphabet))])
        self.matrix = WaveletMatrix(self.text[self.suffixes - 1], alphabet)

    def search(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches of the `length` symbols of the text that end at each place, taken leftwards.

        Returns the patterns that occur more than once and the interval of suffixes of each; a
        pattern is given up as soon as only its own occurrence is left.
        """
        alive = np.arange(len(ends))
        symbols = self.text[ends]
        low, high = self.before[symbols], self.before[symbols + 1]
        for step in range(1, length):
            several = high - low > 1
            alive, low, high = alive[several], low[several], high[several]
            if not len(alive):
                break
            symbols = self.text[ends[alive] - step]
            low = self.before[symbols] + self.matrix.rank(symbols, low)
            high = self.before[symbols] + self.matrix.rank(symbols, high)
        several = high - low > 1
        return alive[several], low[several], high[several]

    def later_matches(self, starts: np.ndarray, length: int) -> np.ndarray:
        """For each start whether the `length` symbols there occur at an earlier place of the text, too."""
        out = np.zeros(len(starts), bool)
        found, low, high = self.search(starts + length - 1, length)
        if len(found):
            lows, first, back = np.unique(low, return_index=True, return_inverse=True)
            edges = np.stack([lows, high[first]], 1).ravel()
            held = np.append(self.suffixes, len(self.text))
            earliest = np.minimum.reduceat(held, edges)[::2]
            out[found] = starts[found] != earliest[back]
        return out
