"""FM-index over word ids, in numpy: suffix array by prefix doubling, the
Burrows-Wheeler transform in a wavelet matrix, vectorised backward search, and
location of occurrences by walking back to sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class WaveletMatrix:
    """Symbols with rank(symbol, i) and access(i) on arrays of queries."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = levels
        self.ones, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol in [0, i)."""
        low = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = self.ones[k]
            low = np.where(one, self.zeros[k] + ones[low], low - ones[low])
            i = np.where(one, self.zeros[k] + ones[i], i - ones[i])
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of ``text``, in which 0 marks ends: ends differ
    from each other (by place), so no comparison goes past one. Each doubling
    round only sorts what is still tied."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    fresh = np.r_[True, np.diff(rank[order]) != 0]
    span = 1
    while True:
        head = np.flatnonzero(fresh)
        rank[order] = np.repeat(head, np.diff(np.r_[head, n]))
        at = np.flatnonzero(~(fresh & np.r_[fresh[1:], True]))
        if not len(at):
            return order
        suffix = order[at]
        group, follow = rank[suffix], rank[np.minimum(suffix + span, n - 1)]  # a tied suffix has not met its end yet
        by = np.lexsort((follow, group))
        order[at] = suffix[by]
        fresh[at] = np.r_[True, (np.diff(group[by]) != 0) | (np.diff(follow[by]) != 0)]
        span *= 2


class FMIndex:
    """Index of ``text``: ids 1 .. sigma, with 0 before and after every segment."""

    def __init__(self, text: np.ndarray, sigma: int):
        order = suffix_array(text)
        self.length = len(text)
        bwt = text[order - 1]  # before the first stands the last, an end
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma + 1))]
        self.tree = WaveletMatrix(bwt.astype(np.int64), max(1, int(sigma).bit_length()))
        ends = np.flatnonzero(text == 0)
        offset = np.arange(len(text)) - np.repeat(np.r_[0, ends[:-1] + 1], np.diff(np.r_[0, ends + 1]))
        sampled = (offset[order] % SAMPLE) == 0  # a segment's first word is sampled: no walk crosses an end
        self.sampled_before = np.r_[0, np.cumsum(sampled)]
        self.positions = order[sampled]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of patterns (one a row, left-aligned ids from 1)."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.length, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            symbol = patterns[live, lengths[live] - 1 - step].astype(np.int64)
            lo[live] = self.below[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.below[symbol] + self.tree.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows = rows.astype(np.int64)
        out = np.full(len(rows), -1, np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            here = rows[live]
            known = self.sampled_before[here + 1] > self.sampled_before[here]
            out[live[known]] = self.positions[self.sampled_before[here[known]]] + steps
            live, here = live[~known], here[~known]
            symbol = self.tree.access(here)
            rows[live] = self.below[symbol] + self.tree.rank(symbol, here)
            steps += 1
        return out
