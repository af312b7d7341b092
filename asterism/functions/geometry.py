"""Column functions on 2D coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOX_PAD


def rotate(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    """Coordinates turned about the origin by ``angle`` radians."""
    c, s = F.lit(math.cos(angle)), F.lit(math.sin(angle))
    return x * c - y * s, x * s + y * c


def to_box(
    x: Column, y: Column, width: float, height: float, pad: float = BOX_PAD
) -> tuple[Column, Column]:
    """Coordinates in [-1, 1] mapped into a width x height box with a margin, per axis."""
    inner_w, inner_h = max(1.0, width - 2 * pad), max(1.0, height - 2 * pad)
    return (
        F.lit(float(pad)) + (x + 1.0) / 2.0 * F.lit(inner_w),
        F.lit(float(pad)) + (y + 1.0) / 2.0 * F.lit(inner_h),
    )
