"""Sorting suffixes by mergesort, with prefix hashes in place of byte comparisons.

Two suffixes are compared by their longest common extension: substrings have
equal hashes or not, so halving steps find where they part in a number of
comparisons that grows with the logarithm of the depth. The merges of one level
run side by side: each suffix of a left run is ranked in its right run by binary
search. Neighbours of the result are compared byte by byte afterwards; if hashes
lied anywhere, everything is sorted again with other ones.
"""

from __future__ import annotations

import numpy as np

from . import hashing


class Suffixes:
    """Suffixes of ``data``, compared up to ``depth`` bytes, which each of them must have."""

    def __init__(self, data: np.ndarray, depth: int, salt: int = 0):
        self.depth = depth
        self.loads = hashing.words(data)
        padded = np.concatenate([data, np.zeros(2 * depth, np.uint8)])
        self.hashes = hashing.prefixes(padded, salt)
        self.first = padded
        self.powers = hashing.powers(2 * depth + 1)
        self.steps = [1 << k for k in range((depth - 1).bit_length() - 1, -1, -1)]

    def _equal(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        h, power = self.hashes, self.powers[length]
        return h[a + length] - h[a] * power == h[b + length] - h[b] * power

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes in common, ``depth`` at most."""
        found = np.zeros(len(a), np.int64)
        whole = self._equal(a, b, self.depth)
        found[whole] = self.depth
        rest = np.flatnonzero(~whole)
        a, b, part = a[rest], b[rest], np.zeros(len(rest), np.int64)
        for step in self.steps:  # they part before ``depth``, so a step never passes that place
            part += np.where(self._equal(a + part, b + part, step), step, 0)
        found[rest] = np.minimum(part, self.depth)
        return found

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` comes strictly before suffix ``b``."""
        common = self.extension(a, b)
        return (common < self.depth) & (self.first[a + common] < self.first[b + common])

    def merged(self, at: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """``at`` with each segment (given by its bounds) in order."""
        at = at.copy()
        width, sizes = 1, np.diff(segments)
        while True:
            open_ = np.flatnonzero(sizes > width)
            if not len(open_):
                return at
            # the runs of this level: pairs of neighbours in every segment that is not one run yet
            pairs = -(-sizes[open_] // (2 * width))
            which, pair = hashing.spread(np.zeros(len(open_), np.int64), pairs)
            left = segments[:-1][open_][which] + pair * 2 * width
            stop = np.minimum(left + 2 * width, segments[1:][open_][which])
            middle = np.minimum(left + width, stop)
            lefts, x = hashing.spread(left, middle - left)
            low, high = middle[lefts].copy(), stop[lefts].copy()
            while True:  # rank of each left suffix among the right ones: those strictly before it
                busy = np.flatnonzero(low < high)
                if not len(busy):
                    break
                probe = (low[busy] + high[busy]) >> 1
                less = self.before(at[probe], at[x[busy]])
                low[busy] = np.where(less, probe + 1, low[busy])
                high[busy] = np.where(less, high[busy], probe)
            place = x + (low - middle[lefts])
            rights, y = hashing.spread(middle, stop - middle)
            # a right suffix moves by the number of left ones that come after it
            passed = np.zeros(len(at) + 1, np.int64)
            np.add.at(passed, low, 1)
            total = np.cumsum(passed)
            before_run = np.concatenate([[0], total])[middle]
            ahead = total[y] - before_run[rights]
            moved = left[rights] + (y - middle[rights]) + ahead
            out = at.copy()
            out[place], out[moved] = at[x], at[y]
            at = out
            width *= 2

    def in_order(self, a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> bool:
        """By their bytes: a before b, or the same where ``equal`` says so."""
        order = np.zeros(len(a), np.int64)
        for k in range(0, self.depth, 8):
            at = min(k, self.depth - 8) if self.depth >= 8 else 0
            x, y = self.loads[a + at], self.loads[b + at]
            if self.depth < 8:
                shift = np.uint64(64 - 8 * self.depth)
                x, y = x.astype(np.uint64) >> shift, y.astype(np.uint64) >> shift
            order = np.where(order == 0, np.where(x == y, 0, np.where(x < y, -1, 1)), order)
        return bool(((order == 0) == equal).all() and (order <= 0).all())


def classes(data: np.ndarray, at: np.ndarray, segments: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by segment in order, and whether each begins a new class of equal ``depth`` bytes."""
    salt = 0
    while True:
        suffixes = Suffixes(data, depth, salt)
        done = suffixes.merged(at, segments)
        begins = np.ones(len(done), bool)
        inner = np.ones(len(done), bool)
        inner[segments[:-1][np.diff(segments) > 0]] = False
        second = np.flatnonzero(inner)
        equal = suffixes.extension(done[second - 1], done[second]) == depth
        if suffixes.in_order(done[second - 1], done[second], equal):
            begins[second] = ~equal
            return done, begins
        salt += 1
