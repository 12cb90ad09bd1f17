"""A compressed FM-index over word numbers, in numpy.

The Burrows-Wheeler transform is kept in a wavelet matrix of packed bits with
rank directories. A bit vector marks where neighbouring suffixes share less
than `threshold` symbols: it opens groups of suffixes that share their first
`threshold` symbols. A match that long is widened to its group, which drops what
it has beyond the threshold, and the group knows its least document. Queries
step many texts leftwards at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed[: (n + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletMatrix:
    """rank of any symbol of a sequence of numbers below 2**levels."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.rows: list[tuple[int, Bits, int]] = []
        s = symbols
        for shift in range(self.levels - 1, -1, -1):
            bit = (s >> shift) & 1
            zeros = int(len(s) - bit.sum())
            self.rows.append((shift, Bits(bit.astype(np.uint8)), zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])
        self.first = self.trace(np.arange(sigma), np.zeros(sigma, np.int64))

    def trace(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.rows:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self.trace(c, i) - self.first[c]


class FMIndex:
    """Index of segments (symbols joined, with lengths) of documents `docs`.

    Each segment is closed by a symbol of its own, so no match crosses its end.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, docs: np.ndarray, sigma: int, threshold: int):
        m = len(lengths)
        n = len(symbols) + m
        ends = np.cumsum(lengths + 1) - 1
        text = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols + m
        text[ends] = np.arange(m)
        self.offset, self.threshold = m, threshold
        order, same = self._sort(text, threshold, int(lengths.max(initial=0)) + 1)
        self.matrix = WaveletMatrix(text[order - 1], sigma + m)
        counts = np.bincount(text, minlength=sigma + m)
        self.start = np.cumsum(counts) - counts
        self.n = n
        self.groups = Bits((~same).astype(np.uint8))  # a one opens a group
        owner = np.repeat(docs, lengths + 1)[order]
        self.opens = np.append(np.flatnonzero(~same), n)
        self.least = np.minimum.reduceat(owner, self.opens[:-1]) if n else owner

    @staticmethod
    def _sort(text: np.ndarray, threshold: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix order by doubling, and whether a suffix shares `threshold` symbols with the one before it."""
        n = len(text)
        rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        at_threshold = (rank, 1)
        order = np.argsort(rank, kind="stable")
        while size < longest and n:
            if size <= threshold:
                at_threshold = (rank, size)
            after = np.full(n, -1, np.int64)
            after[: n - size] = rank[size:] if size < n else rank[:0]
            key = rank * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            sorted_key = key[order]
            new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            rank, size = new, size * 2
        if size <= threshold:
            at_threshold = (rank, size)
        rank, size = at_threshold
        same = np.zeros(n, bool)
        if n > 1:
            a, b = order[1:], order[:-1]
            ok = np.ones(n - 1, bool)
            for step in sorted({*range(0, threshold - size, size), threshold - size}):
                x, y = a + step, b + step
                ok &= (x < n) & (y < n) & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
            same[1:] = ok
        return order, same

    def step(self, c: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of c followed by what [left, right) stands for."""
        c = c + self.offset
        return self.start[c] + self.matrix.rank(c, left), self.start[c] + self.matrix.rank(c, right)

    def stream(self, symbols: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of texts, from their ends: (text, place) of each place whose
        match reaches the threshold and also starts in a document below docs.

        A symbol that the match can't take makes its right end give way by one.
        """
        begins = np.cumsum(lengths) - lengths
        place, end = lengths - 1, lengths.copy()
        left, right = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        size = np.zeros(len(lengths), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(place >= 0)
        while len(live):
            l, r = self.step(symbols[begins[live] + place[live]], left[live], right[live])
            lost = l >= r
            if lost.any():
                out = live[lost]
                end[out] = np.where(size[out] > 0, end[out] - 1, place[out])
                place[out], left[out], right[out], size[out] = end[out] - 1, 0, self.n, 0
                live, l, r = live[~lost], l[~lost], r[~lost]
            size[live] += 1
            deep = size[live] >= self.threshold
            if deep.any():
                group = self.groups.rank(l[deep] + 1) - 1
                hit = self.least[group] < docs[live[deep]]
                found.append((live[deep][hit], place[live[deep]][hit]))
                l[deep], r[deep] = self.opens[group], self.opens[group + 1]
                end[live[deep]] = place[live[deep]] + self.threshold
            left[live], right[live] = l, r
            place[live] -= 1
            live = np.flatnonzero(place >= 0)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
