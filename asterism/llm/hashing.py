"""64-bit hashes of words and byte ranges of many texts at once, on flat numpy arrays."""

from __future__ import annotations

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_WORD = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(_WORD, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _WORD(shift)
        x *= _WORD(factor)
    return x ^ (x >> _WORD(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=_WORD) * _WORD(_ODD))


class RangeHash:
    """Hashes of ranges of one byte array: sums of byte values times powers, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        base = _ODD | 1
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.concatenate([np.zeros(1, _WORD), np.cumsum(BYTE_VALUES[data] * _powers(base, n))])

    def every(self, width: int) -> np.ndarray:
        """The hashes of all ranges of ``width`` bytes, without places to look up."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n] + _WORD(width))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(_WORD))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... as far as asked for; kept for the next batch."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.ones(size, _WORD)
        if size > 1:
            known[1:] = _WORD(base)
        known = np.cumprod(known)
        _POWERS[base] = known
    return known[:n]
