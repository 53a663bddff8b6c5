"""An FM-index over integer symbols: suffix array, Burrows-Wheeler transform, wavelet tree, sampled suffix positions.

Everything is vectorised over patterns: one backward step takes all patterns at once down the wavelet tree.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling on ranks; suffixes that are told apart are not sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    heads = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    step = 1
    while True:
        # Places in the order whose bucket has more than one suffix.
        at = rank[order]
        tied = np.concatenate([at[1:] == at[:-1], [False]])
        tied[1:] |= tied[:-1].copy()
        places = np.flatnonzero(tied)
        if not len(places) or step >= n:
            return order
        who = order[places]
        after = who + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = at[places]
        by = np.lexsort((key, first))
        who, key, first = who[by], key[by], first[by]
        order[places] = who
        fresh = np.concatenate([[True], (first[1:] != first[:-1]) | (key[1:] != key[:-1])])
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))
        rank[who] = places[begun]
        step *= 2


class WaveletTree:
    """Levelwise bits from the highest, stable by the bits above, with running counts: rank by one lookup a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.n = len(symbols)
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = symbols
        for level in range(self.bits):
            bit = (current >> (self.bits - 1 - level)) & 1
            running = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=running[1:])
            self.ones.append(running)
            self.zeros.append(self.n - int(running[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        lo = np.zeros(len(symbols), np.int64)
        hi = ends.astype(np.int64)
        for level in range(self.bits):
            bit = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def access(self, places: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        out = np.zeros(len(places), np.int64)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            bit = ones[places + 1] - ones[places]
            out = out * 2 + bit
            places = np.where(bit == 1, zeros + ones[places], places - ones[places])
        return out


class FMIndex:
    """Symbols are integers from 1; 0 ends the sequence and is added here."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.tree = WaveletTree(last, sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.sampled = order % sample == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix array that begin with each row of ``patterns``; rows are padded on the left with -1."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.tree.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[:, column]
            live = np.flatnonzero((symbol >= 0) & (lo < hi))
            if len(live):
                c = symbol[live]
                both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo[live], hi[live]]))
                lo[live], hi[live] = self.smaller[c] + both[: len(c)], self.smaller[c] + both[len(c) :]
        return lo, np.maximum(lo, hi)

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the sequence of places in the suffix array, walking back to a sampled one."""
        out = np.zeros(len(places), np.int64)
        which, at, steps = np.arange(len(places)), places.astype(np.int64), 0
        while len(which):
            hit = self.sampled[at]
            out[which[hit]] = self.samples[self.sampled_before[at[hit]]] + steps
            which, at = which[~hit], at[~hit]
            if len(which):
                c = self.tree.access(at)
                at = self.smaller[c] + self.tree.rank(c, at)
            steps += 1
        return out
