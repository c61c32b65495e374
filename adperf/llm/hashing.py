"""Prefix polynomial hashes of byte strings modulo 2^64, and comparisons of many places of a text at once."""

from __future__ import annotations

import numpy as np

from . import common

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: A value for each byte, so that strings of few different bytes spread over all bits, too.
VALUES = common.mix(common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, down: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse."""
    name = "down" if down else "up"
    if len(_powers[name]) < n:
        steps = np.full(n + n // 8, INVERSE if down else BASE, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def prefixes(data: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each prefix: h[0] = 0, h[i + 1] = h[i] * BASE + value of byte i; another ``salt``, other values."""
    n = len(data)
    values = VALUES if not salt else common.mix(VALUES + np.uint64(salt))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * powers(n + 1, down=True)[1:], out=sums[1:])
    sums *= powers(n + 1)
    return sums


def hashes_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes from each start, where the starts are few."""
    found = np.zeros(len(starts), np.uint64)
    for k in range(length):
        found = found * BASE + VALUES[data[starts + k]]
    return common.mix(found)


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in the order of the bytes; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))


def same(loads: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes from ``a`` and from ``b`` agree, each over its own length of eight or more."""
    equal = np.ones(len(a), bool)
    for k in range(0, int(lengths.max(initial=0)), 8):
        at = np.minimum(k, lengths - 8)
        equal &= loads[a + at] == loads[b + at]
    return equal


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces one after another, and where each begins (and the last ends)."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)
    return data[index], bounds


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of numbers: which range, and the number, of every member."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]
