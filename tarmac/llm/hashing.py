"""Hashes of all substrings of a sequence at once, from one running sum."""

from __future__ import annotations

import numpy as np

#: Signs that are hashed together: many short texts, or a block of a long one.
BLOCK = 1 << 18
_U = np.uint64
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, for a block and some signs over."""
    if not _POWERS:
        for base in (_BASE, _INVERSE):
            x = np.full(BLOCK + (1 << 16), base, np.uint64)
            x[0] = 1
            _POWERS.append(np.multiply.accumulate(x))
    return _POWERS


class Hashes:
    """64-bit hashes of any substring of a block, given as random-looking 64-bit values of its signs."""

    def __init__(self, values: np.ndarray):
        up, self.down = _powers()
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        """Of the substrings of `size` signs at each place."""
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: max(0, len(self.sums) - size)] + _U(size))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the substrings from each start to its end."""
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))
