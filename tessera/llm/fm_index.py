"""A compressed FM-index: the Burrows-Wheeler transform of a text of numbers in a wavelet matrix, searched backward.

Bits of the wavelet matrix are packed, with one count for each 64 of them, so a symbol takes about one and a half bits a
level. All searches go in step: each step extends all patterns that are still alive by one symbol to the left.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit row with ranks."""

    def __init__(self, bits: np.ndarray):
        filled = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        filled[: len(bits)] = bits
        self.words = np.packbits(filled, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, upto: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        at = upto >> 6
        mask = (np.uint64(1) << (upto & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at].astype(np.int64) + np.bitwise_count(self.words[at] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, (sigma - 1).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1 > 0
            self.levels.append((shift, Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.begin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(place)
            place = np.where((symbol >> shift) & 1 > 0, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._down(symbol, upto) - self.begin[symbol]


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in their order, by prefix doubling; the suffixes have to be different before their ends."""
    n, step = len(ranks), 1
    while True:
        key = ranks.astype(np.int64) * (n + 1)
        key[: n - step] += ranks[step:] + 1
        order = np.argsort(key, kind="stable")
        fresh = np.append(False, key[order][1:] != key[order][:-1])
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(fresh)
        if n == 0 or int(ranks[order[-1]]) == n - 1:
            return order
        step *= 2


class FMIndex:
    """Over several texts of numbers from 1 on. owners: a number for each text; a search can ask for texts of smaller numbers alone."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray, owners: np.ndarray):
        count, self.sigma = len(offsets) - 1, int(tokens.max(initial=0)) + 1
        # each text ends in a mark of its own, so that no suffix goes on into the next text
        length = np.diff(offsets)
        marks = np.cumsum(length + 1) - 1
        whole = np.zeros(len(tokens) + count, np.int64)
        inside = np.ones(len(whole), bool)
        inside[marks] = False
        whole[inside] = tokens
        ranks = whole + count
        ranks[marks] = np.arange(count)
        dense = np.zeros(int(ranks.max(initial=0)) + 1, np.int64)
        dense[ranks] = 1
        order = suffix_order(np.cumsum(dense)[ranks] - 1)
        self.size = len(whole)
        self.transform = WaveletMatrix(whole[order - 1], self.sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=self.sigma))])
        self.least = [np.repeat(owners, length + 1)[order]]
        while (1 << len(self.least)) <= self.size:
            half, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-half], last[half:]))

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the suffixes that begin with the symbol followed by the patterns of the given intervals."""
        begin = self.smaller[symbol]
        return begin + self.transform.rank(symbol, low), begin + self.transform.rank(symbol, high)

    def first_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each interval, none of which may be empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.least[0].dtype)
        for k in np.unique(level).tolist():
            at = level == k
            row = self.least[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
        return out

    def matched(self, tokens: np.ndarray, ends: np.ndarray, most: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Matching statistics: how many tokens before each end (of at most `most`) also stand in a text of a smaller owner."""
        found = np.zeros(len(ends), np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        for step in range(1, int(most.max(initial=0)) + 1):
            go = most[alive] >= step
            alive, low, high = alive[go], low[go], high[go]
            if not len(alive):
                break
            low, high = self.extended(tokens[ends[alive] - step], low, high)
            some = np.flatnonzero(high > low)
            some = some[self.first_owner(low[some], high[some]) < owner[alive[some]]]
            alive, low, high = alive[some], low[some], high[some]
            found[alive] = step
        return found
