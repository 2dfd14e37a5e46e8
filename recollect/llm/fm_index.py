"""An FM-index over sequences of 64-bit words: suffix array, wavelet matrix, backward search.

Bits of the wavelet matrix are packed; ranks come from counts for blocks of 64 and one
population count, so a level takes 1.5 bits a symbol. Everything runs over arrays of
queries at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class _Bits:
    """Packed bits with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = i >> 6
        below = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.words[block] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.levels.append(_Bits(bit.astype(bool)))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        every = np.arange(sigma)
        self.begin = self._follow(every, np.zeros(sigma, np.int64))

    def _follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.depth - 1, -1, -1)):
            ones = self.levels[k].rank(i)
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._follow(symbol, i) - self.begin[symbol]


def suffix_array(symbols: np.ndarray, longest: int) -> np.ndarray:
    """Positions in suffix order, by doubling; ties beyond ``longest`` symbols by position."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step <= longest and int(rank.max()) < n - 1:
        after = np.full(n, -1, np.int64)
        after[:-step] = rank[step:] if step < n else 0
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        step *= 2
    return order


class FMIndex:
    """Index of sequences ``flat[starts[i]:starts[i] + sizes[i]]`` of word hashes.

    Every sequence ends with a separator of its own (smaller than all words), so no match
    runs over the end of one. ``value`` gives each indexed word a number; searches return
    the least one at which an occurrence starts.
    """

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, value: np.ndarray):
        self.words, code = np.unique(flat, return_inverse=True)
        m = len(sizes)
        place = np.arange(len(flat)) + np.repeat(np.arange(m), sizes)
        text = np.empty(len(flat) + m, np.int64)
        text[place] = code + m
        text[np.cumsum(sizes + 1) - 1] = np.arange(m)
        order = suffix_array(text, int(sizes.max()) + 1)
        # separators are alike for the index: one symbol 0, words from 1
        plain = np.maximum(text - m + 1, 0)
        self.sigma = len(self.words) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(plain, minlength=self.sigma))])
        self.matrix = WaveletMatrix(plain[order - 1], self.sigma)
        self.n = len(text)
        values = np.full(self.n + 1, np.iinfo(np.int64).max)
        values[place] = value
        self.value = np.concatenate([values[order], values[-1:]])

    def symbols(self, flat: np.ndarray) -> np.ndarray:
        """Symbols of words; 0 for those that the index lacks."""
        at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        return np.where(self.words[at] == flat, at + 1, 0)

    def matching(self, symbol: np.ndarray, end: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Matching statistics by backward search: for each query string, the ``length`` words
        of ``symbol`` before ``end``, how many words at its end occur together in the index
        (at most all), and the interval (low, high) of these occurrences."""
        low, high = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        steps, live = np.zeros(len(end), np.int64), np.flatnonzero(length > 0)
        while len(live):
            x = symbol[end[live] - 1 - steps[live]]
            known = x > 0
            live, x = live[known], x[known]
            base = self.before[x]
            both = self.matrix.rank(np.concatenate([x, x]), np.concatenate([low[live], high[live]]))
            a, b = base + both[: len(x)], base + both[len(x) :]
            some = b > a
            live = live[some]
            low[live], high[live] = a[some], b[some]
            steps[live] += 1
            live = live[steps[live] < length[live]]
        return steps, low, high

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each interval (not empty)."""
        if not len(low):
            return low
        # each interval once and in order, so that what lies between is passed over once
        key, where = np.unique(low * (self.n + 1) + high, return_inverse=True)
        pairs = np.stack(np.divmod(key, self.n + 1), axis=1).ravel()
        return np.minimum.reduceat(self.value, pairs)[::2][where]
