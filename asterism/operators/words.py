"""Whole numbers of many words in numpy: one array of int64 words, base 2**32, lowest first.

Words hold 32 bits each after ``settle``; the highest one has the sign. Used for exact sums of
products that outgrow 64 bits, without a Python integer per number.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 32) - 1
_HALF = 31
_HALF_MASK = (1 << _HALF) - 1


def empty(count: int, shape: tuple[int, ...]) -> np.ndarray:
    return np.zeros((count, *shape), np.int64)


def add(words: np.ndarray, value: np.ndarray, shift: int) -> None:
    """Add value * 2**shift, for any int64 values. Words take 2**29 additions before ``settle``."""
    at, bits = divmod(shift, 32)
    low, high = (value & _MASK) << bits if bits < 31 else None, value >> 32
    if low is None:  # 31 bits: two steps keep the low word inside int64
        low = (value & _MASK) << 30
        words[at] += (low & (_MASK >> 1)) << 1
        words[at + 1] += low >> 31
    else:
        words[at] += low & _MASK
        words[at + 1] += low >> 32
    top = high << bits
    words[at + 1] += top & _MASK
    words[at + 2] += top >> 32


def settle(words: np.ndarray) -> None:
    """Carry, so that every word but the highest is in 0 .. 2**32 - 1."""
    for i in range(len(words) - 1):
        words[i + 1] += words[i] >> 32
        words[i] &= _MASK


def times(words: np.ndarray, factor: int) -> np.ndarray:
    """words * factor for 0 <= factor < 2**62; ``words`` are settled and their highest one is small."""
    out = empty(len(words) + 4, words.shape[1:])
    for part in range(2):
        digit = (factor >> (_HALF * part)) & _HALF_MASK
        if digit:
            for i, word in enumerate(words):
                add(out, word * digit, 32 * i + _HALF * part)
    settle(out)
    return out


def halves(values: list[int], count: int = 5) -> np.ndarray:
    """Signed Python integers as ``count`` digits of 31 bits; the highest digit has the sign."""
    digits = [[(v >> (_HALF * i)) & _HALF_MASK if i < count - 1 else v >> (_HALF * i) for v in values] for i in range(count)]
    return np.array(digits, np.int64).reshape(count, len(values))


def subtract_products(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """words -= a[i] * b[j] for every i, j; ``a`` and ``b`` are ``halves``."""
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            add(words, -np.multiply.outer(x, y), _HALF * (i + j))
    settle(words)


def to_float(words: np.ndarray) -> np.ndarray:
    """The numbers as doubles, to the last place or two."""
    negative = words[-1] < 0
    size = np.where(negative, -words, words)
    settle(size)
    out = np.zeros(words.shape[1:])
    for i in reversed(range(len(size))):
        out += np.ldexp(size[i].astype(float), 32 * i)
    return np.where(negative, -out, out)
