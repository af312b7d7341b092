"""Random draws that depend only on (seed, step, row id), never on partitioning.

A draw is one round of the SplitMix64 mixer over ``id + key(seed, step)``, scaled into (0, 1).
"""

from __future__ import annotations

import numpy as np

_GAMMA = 0x9E3779B97F4A7C15
_M1 = 0xBF58476D1CE4E5B9
_M2 = 0x94D049BB133111EB
_WORD = 1 << 64


def step_key(seed: int, step: int) -> int:
    """64-bit key of one step of one seed."""
    z = (seed * _GAMMA + (step + 1) * _M1) % _WORD
    z = ((z ^ (z >> 30)) * _M1) % _WORD
    z = ((z ^ (z >> 27)) * _M2) % _WORD
    return z ^ (z >> 31)


def exponentials(ids: np.ndarray, seed: int, step: int) -> np.ndarray:
    """-ln(u) for one uniform draw u per id."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.int64).view(np.uint64) + np.uint64(step_key(seed, step))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(_M1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(_M2)
        z = z ^ (z >> np.uint64(31))
    u = ((z >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
    return -np.log(u)


def sql_exponential(id_expr: str, seed: int, step: int) -> str:
    """The same draw as a DuckDB expression (used by the SQL oracles)."""
    word = "18446744073709551616::UHUGEINT"

    def mul(expr: str, m: int) -> str:
        return f"(({expr})::UHUGEINT * {m}::UHUGEINT % {word})::UBIGINT"

    z = f"((({id_expr})::UHUGEINT + {step_key(seed, step)}::UHUGEINT) % {word})::UBIGINT"
    for shift, m in ((30, _M1), (27, _M2)):
        z = f"(SELECT {mul('xor(z, z >> ' + str(shift) + ')', m)} FROM (SELECT {z} AS z))"
    z = f"(SELECT xor(z, z >> 31) FROM (SELECT {z} AS z))"
    return f"(-ln((({z} >> 12)::DOUBLE + 0.5) / 4503599627370496.0))"
