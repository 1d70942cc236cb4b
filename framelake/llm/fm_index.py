"""An FM-index over a sequence of small integers: suffix array, wavelet-matrix ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """A bit vector with ranks: packed words and a running count before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector by level from the highest bit."""

    def __init__(self, x: np.ndarray):
        self.depth = max(1, int(x.max(initial=0)).bit_length())
        self.levels: list[tuple[int, Bits, int]] = []
        for level in range(self.depth - 1, -1, -1):
            bit = ((x >> level) & 1).astype(np.uint8)
            self.levels.append((level, Bits(bit), int(len(x) - bit.sum())))
            x = np.concatenate((x[bit == 0], x[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[j] before position i[j]."""
        lo = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = ((c >> level) & 1).astype(bool)
            a, b = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, i - b)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros_like(i)
        for level, bits, zeros in self.levels:
            one = bits.get(i)
            r = bits.rank(i)
            c |= one << level
            i = np.where(one == 1, zeros + r, i - r)
        return c


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Prefix doubling: ranks of runs of 1, 2, 4 ... symbols until all differ."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        step *= 2
        if fresh.sum() == n - 1 or step >= n:
            return order


class FMIndex:
    """Index of runs of symbols (1 and above). Runs end in separators that differ, so no match spans two runs."""

    def __init__(self, symbols: np.ndarray, run_off: np.ndarray):
        runs = len(run_off) - 1
        self.start = run_off[:-1] + np.arange(runs)  # of each run, with the separators before it
        seq = np.zeros(len(symbols) + runs, np.int64)
        inside = np.ones(len(seq), bool)
        inside[run_off[1:] + np.arange(runs)] = False
        seq[inside] = symbols
        keys = seq + runs
        keys[~inside] = np.arange(runs)
        sa = suffix_array(keys)
        last = np.where(sa > 0, seq[sa - 1], 0)
        self.wavelet = WaveletMatrix(last)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=int(seq.max(initial=0)) + 2))))
        kept = sa % SAMPLE == 0
        kept[np.isin(sa, self.start)] = True
        self.sampled = Bits(kept)
        self.samples = sa[kept]
        self.length = len(seq)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns, aligned to the right of the rows of a matrix."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.length, np.int64)
        width = patterns.shape[1]
        top = len(self.first) - 3  # `first` has a place before symbol 0 and one after the greatest symbol
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths > width - 1 - j) & (hi > lo))
            c = patterns[live, j]
            known = c <= top
            hi[live[~known]] = lo[live[~known]]
            live, c = live[known], c[known]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes: step back to a sampled one. A run's start is sampled, so no step leaves a run."""
        out, step = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            hit = self.sampled.get(at) == 1
            done = live[hit]
            out[done] = self.samples[self.sampled.rank(at[hit])] + step[done]
            live, at = live[~hit], at[~hit]
            step[live] += 1
            c = self.wavelet.access(at)
            at = self.first[c] + self.wavelet.rank(c, at)
        return out
