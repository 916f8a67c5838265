"""A compressed full-text index over numbered words: BWT, wavelet matrix, backward search.

Many patterns are searched at once, one step to the left each, so the work is in numpy.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; rounds follow the longest repeat."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    held = text[order]
    rank[order] = np.cumsum(np.append(False, held[1:] != held[:-1]))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key)
        held = key[order]
        new = np.cumsum(np.append(False, held[1:] != held[:-1]))
        rank[order] = new
        step *= 2
        if new[-1] == n - 1 or step >= n:
            return order


class WaveletMatrix:
    """Ranks of any symbol in a sequence, in about one and a half bits per symbol and level."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.words, self.sums, self.zeros = [], [], []
        first = np.arange(symbols, dtype=np.int64) * 0
        names = np.arange(symbols, dtype=np.int64)
        n = len(values)
        for level in range(self.levels - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.sums.append(np.append(0, np.cumsum(np.bitwise_count(words).astype(np.int64)))[:-1])
            self.zeros.append(n - int(bits.sum()))
            first = self._down(len(self.words) - 1, first, names >> level & 1)
            values = np.concatenate([values[bits == 0], values[bits == 1]])
        self.first = first

    def _down(self, k: int, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """Where position ``at`` goes on the next level, for symbols with this bit."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.sums[k][block] + np.bitwise_count(self.words[k][block] & mask)
        return np.where(bit == 1, self.zeros[k] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        for k in range(self.levels):
            at = self._down(k, at, symbol >> (self.levels - 1 - k) & 1)
        return at - self.first[symbol]


class FmIndex:
    """Pieces of numbered words (from 1 on), each ended by 0, which no pattern holds."""

    def __init__(self, pieces: list[np.ndarray]):
        lengths = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int(ends[-1]) + 1, np.int64)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.concatenate(pieces)
        self.text, self.starts, self.ends = text, ends - lengths, ends
        order = suffix_array(text)
        symbols = int(text.max()) + 1
        self.less = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        self.wavelet = WaveletMatrix(text[order - 1], symbols)

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that start with the symbol and go on with those of the ranges."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.less[symbol]
        return base + both[:len(low)], base + both[len(low):]

    def repeats(self, chosen: np.ndarray, width: int) -> list[tuple[int, int, int]]:
        """(piece, start, end): parts of the chosen pieces that stand twice and hold ``width`` words.

        Every window of ``width`` words that stands twice is in one of them. The text of a piece
        streams by from right to left; while the range holds two suffixes, the match goes on. Where
        it breaks at word ``x``, windows over ``x`` are left that end earlier: runs that begin at ``x``
        are tried at a few lengths, and where one is unique no window over it can be repeated.
        """
        trials = np.array([2, min(8, width), width], np.int64)
        item = np.array(chosen, np.int64)
        begin, end = self.starts[item], self.ends[item].copy()
        at = end.copy()
        low, high = np.zeros(len(item), np.int64), np.full(len(item), len(self.text), np.int64)
        # -1: matching; otherwise the trial under way for the word in ``broken``.
        trial, broken = np.full(len(item), -1), np.zeros(len(item), np.int64)
        limit = end.copy()  # of the match that broke
        out: list[tuple[int, int, int]] = []
        while len(item):
            left = at > begin
            symbol = self.text[np.maximum(at - 1, 0)]
            new_low, new_high = self.back(symbol, low, high)
            goes = left & (new_high - new_low >= 2)
            at, low, high = np.where(goes, at - 1, at), np.where(goes, new_low, low), np.where(
                goes, new_high, high)

            # A trial that reached its word: the next length, or on with matching.
            reached = goes & (trial >= 0) & (at == broken)
            longer = reached & (trial < len(trials) - 1)
            trial = np.where(longer, trial + 1, np.where(reached, -1, trial))
            # A match that broke: report, then the first trial. A trial that broke: match before it.
            stopped = ~goes & (trial < 0)
            for k in np.flatnonzero(stopped & (end - at >= width)):
                out.append((int(item[k]), int(at[k] - begin[k]), int(end[k] - begin[k])))
            tried = stopped & left
            broken = np.where(tried, at - 1, broken)
            limit = np.where(tried, end, limit)
            trial = np.where(tried, 0, trial)
            failed = ~goes & (trial >= 0) & ~tried
            target = np.minimum(broken + trials[np.maximum(trial, 0)], limit)
            end = np.where(failed, end - 1, np.where(tried | longer, target, end))
            trial = np.where(failed, -1, trial)
            restart = tried | longer | failed
            at = np.where(restart, end, at)
            low = np.where(restart, 0, low)
            high = np.where(restart, len(self.text), high)

            alive = ~(stopped & ~left) & (np.where(trial >= 0, limit, end) - width >= begin)
            if not alive.all():
                item, begin, end, at, low, high, trial, broken, limit = (
                    x[alive] for x in (item, begin, end, at, low, high, trial, broken, limit))
        return out
