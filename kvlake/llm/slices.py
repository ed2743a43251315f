"""Arithmetic on slices of byte arrays: hashes from prefix sums, gathering, comparison."""

from __future__ import annotations

import numpy as np

#: White space of the word pattern: blank, tab, LF, VT, FF and CR.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
GATHER_BYTES = 1 << 19
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        steps = [np.full(max(n, 1 << 16), b, np.uint64) for b in (_BASE, _INVERSE)]
        for x in steps:
            x[0] = 1
        _powers[:] = [np.cumprod(x) for x in steps]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any slices of an array, from its prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = _power(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[:-1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices' bytes, one after another. Indices are made for about GATHER_BYTES at a time."""
    end = np.cumsum(size)
    out = np.empty(int(end[-1]) if len(end) else 0, buf.dtype)
    at = 0
    while at < len(size):
        done = int(end[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(end, done + GATHER_BYTES)))
        own = size[at:to]
        shift = start[at:to] - (end[at:to] - own - done)
        out[done : int(end[to - 1])] = buf[np.repeat(shift, own) + np.arange(int(end[to - 1]) - done)]
        at = to
    return out


def same_slices(buf: np.ndarray, a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Which slices a equal the slices b."""
    same = a_size == b_size
    at = np.flatnonzero(same & (a_size > 0))
    for part in np.array_split(at, 1 + int(a_size[at].sum()) // (1 << 22)):
        if len(part):
            differ = gather(buf, a[part], a_size[part]) != gather(buf, b[part], a_size[part])
            same[part] = ~np.logical_or.reduceat(differ, np.concatenate(([0], np.cumsum(a_size[part])[:-1])))
    return same
