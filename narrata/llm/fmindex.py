"""A compressed full-text index over integer symbols: suffix order, BWT, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    order = np.argsort(text, kind="stable")
    ranks = np.empty(len(text), np.int64)
    step = np.concatenate(([0], np.cumsum(text[order][1:] != text[order][:-1])))
    ranks[order] = step
    width = 1
    while step[-1] < len(text) - 1:
        later = np.concatenate((ranks[width:] + 1, np.zeros(min(width, len(text)), np.int64)))[: len(text)]
        pairs = ranks * (len(text) + 1) + later
        order = np.argsort(pairs, kind="stable")
        step = np.concatenate(([0], np.cumsum(pairs[order][1:] != pairs[order][:-1])))
        ranks[order] = step
        width *= 2
    return order


class WaveletMatrix:
    """Rank of any symbol in any prefix, one bit vector with counts per 64 bits for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
            padded[: len(bits)] = bits
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1])).astype(np.int32))
            self.zeros.append(len(bits) - int(bits.sum()))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix ``at`` ends among the places of ``symbol`` on the last level."""
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            inside = self.words[i][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[i][word] + np.bitwise_count(inside)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at


class LeastOf:
    """Least value of any range, from the minima of all power-of-two ranges."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.starts = np.cumsum([0, *map(len, self.rows)])
        self.flat = np.concatenate(self.rows)
        del self.rows

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Ranges [low, high), none empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        first = self.starts[level]
        return np.minimum(self.flat[first + low], self.flat[first + high - (1 << level)])


class FMIndex:
    """Passages of documents, searchable backwards word by word; ``owner`` is one number per passage."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray):
        n = len(lengths)
        known, codes = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths) + np.arange(n)  # each passage is closed by a mark of its own
        text = np.empty(len(words) + n, np.int64)
        is_mark = np.zeros(len(text), bool)
        is_mark[ends] = True
        text[is_mark] = np.arange(n)
        text[~is_mark] = codes + n
        order = suffix_order(text)
        bwt = text[order - 1]
        counts = np.bincount(text, minlength=n + len(known))
        self.wavelet = WaveletMatrix(bwt, n + len(known))
        symbols = np.arange(n + len(known))
        before = np.concatenate(([0], np.cumsum(counts)[:-1]))
        self.shift = before - self.wavelet.descend(symbols, np.zeros(len(symbols), np.int64))
        self.least = LeastOf(np.repeat(owner, lengths + 1)[order])
        self.text, self.size, self.starts = text, len(text), ends - lengths

    def matching(self, ends: np.ndarray, below: np.ndarray, most: int) -> np.ndarray:
        """Matching statistics: for each place of the indexed text, how many words (at most ``most``) ending just before
        it also stand, in this order, in a passage whose owner is less than ``below``."""
        found = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        for length in range(1, most + 1):
            symbol = self.text[ends[live] - length]
            low = self.shift[symbol] + self.wavelet.descend(symbol, low)
            high = self.shift[symbol] + self.wavelet.descend(symbol, high)
            ok = self.least(low, high) < below[live]  # the place itself matches, so no range is empty
            live, low, high = live[ok], low[ok], high[ok]
            found[live] = length
            if not len(live):
                break
        return found
