"""Projection to two dimensions by principal components.

Up to EXACT_DIM values per vector one pass gives the whole covariance. Wider vectors are never multiplied out:
block power iteration takes passes of X^T (X W), whose state is a few columns of d numbers, and looks for
the axes in the space of all blocks so far (a block Krylov space), which needs far fewer passes than the
last block alone. All sums are exact integers, so the axes do not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from .blocks import Batch, State, VectorBlocks, add_states, limbs, moments, on_grid, split_int
from .gram import exact_sums

EXACT_DIM = 256
BLOCK = 8  # columns of one pass
_MOST_COLUMNS = 240  # kept before the space is cut down to its best part
_MOST_PASSES = 2000
_LIMB = 18
_KEPT = 4  # levels of products of limbs; what is left out is below rounding
_CHUNK = 1 << 14


@dataclass
class Basis:
    """Two principal directions and the box of the projected rows."""

    mean: np.ndarray
    axes: np.ndarray  # 2 x d
    variances: np.ndarray
    centre: tuple[float, float] = (0.0, 0.0)
    span: float = 1.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """n x 2 coordinates before normalisation, each row by itself."""
        centred = x - self.mean
        return np.stack([np.einsum("ij,j->i", centred, axis) for axis in self.axes], axis=1)

    def place(self, x: np.ndarray) -> np.ndarray:
        """n x 2 coordinates in [-1, 1] (new rows may fall outside)."""
        return 2.0 * (self.project(x) - np.array(self.centre)) / self.span


def _basis(mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> Basis:
    """The first two of the given directions; the largest loading of each (the first, on ties) is positive.

    A direction without variance becomes the zero vector, so it adds the coordinate 0.
    """
    dim = len(mean)
    axes, variances = np.zeros((2, dim)), np.zeros(2)
    floor = max(float(values[0]), 0.0) * dim * np.finfo(float).eps
    for i in range(min(2, len(values))):
        value, axis = float(values[i]), vectors[:, i]
        if value > floor:
            axes[i] = axis * (1.0 if axis[np.abs(axis).argmax()] > 0 else -1.0)
            variances[i] = value
    return Basis(mean, axes, variances)


def principal_axes(mean: np.ndarray, cov: np.ndarray) -> Basis:
    """The two leading eigenvectors of a covariance."""
    values, vectors = np.linalg.eigh(cov)
    return _basis(mean, values[::-1], vectors[:, ::-1])


def _exponents(blocks: VectorBlocks, mean: np.ndarray) -> tuple[int, int]:
    """Powers of two that no centred value, and no length of a centred row, exceeds."""

    def step(batches: Iterable[Batch]) -> State:
        most = {"value": 0.0, "length": 0.0}
        for _, x in batches:
            x = x - mean
            most["value"] = max(most["value"], float(np.abs(x).max()))
            most["length"] = max(most["length"], float(np.einsum("ij,ij->i", x, x).max()))
        return most

    most = blocks.fold(step, lambda a, b: {key: max(a[key], b[key]) for key in a})
    return math.frexp(most["value"])[1], math.frexp(math.sqrt(most["length"]))[1] + 1


def _times(blocks: VectorBlocks, mean: np.ndarray, w: np.ndarray, exponents: tuple[int, int]) -> np.ndarray:
    """The covariance times unit columns ``w`` in one pass, the same bits for every partitioning.

    Centred rows and their products with ``w`` are cut into limbs of 18 bits, whose products add up exactly.
    """
    own, other = exponents
    pairs = [[(i, level - i) for i in range(3) if 0 <= level - i < 3] for level in range(_KEPT)]

    def step(batches: Iterable[Batch]) -> State:
        total = np.zeros((2, _KEPT, *w.shape), np.int64)
        for _, x in batches:
            for start in range(0, len(x), _CHUNK):
                part = on_grid(x[start : start + _CHUNK] - mean, own)
                # einsum adds up every row by itself, whatever rows are beside it
                z = on_grid(np.stack([np.einsum("ij,j->i", part, c) for c in w.T], axis=1), other)
                a, b = limbs(part, own, _LIMB, 3), limbs(z, other, _LIMB, 3)
                for level in range(_KEPT):
                    total[:, level] += split_int(sum(a[i].T @ b[j] for i, j in pairs[level]))
        return {"total": total}

    high, low = blocks.fold(step, add_states, 16 * _KEPT * w.size)["total"]
    out = np.zeros(w.shape)
    for level in reversed(range(_KEPT)):
        unit = own + other - _LIMB * (level + 2)
        out += np.ldexp(low[level].astype(float), unit) + np.ldexp(high[level].astype(float), unit + 32)
    return out / blocks.n


def _orthonormal(block: np.ndarray, against: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the space of ``against``; fewer where it adds less."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    found = u[:, size > scale]
    return np.linalg.qr(found - against @ (against.T @ found))[0] if found.shape[1] else found


def leading_axes(multiply, dim: int, count: int = 2, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the ``count`` leading eigenpairs of a symmetric matrix.

    ``multiply(w)`` is the matrix times a block of columns. Ends when the residuals are at the level of
    rounding, or when the blocks so far span a space that the matrix does not leave.
    """
    eps = np.finfo(float).eps
    block = min(block, dim)
    start = np.random.default_rng(dim).standard_normal((dim, block))
    w = np.linalg.qr(start)[0]
    space, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    best, stuck = math.inf, 0
    for passes in range(1, _MOST_PASSES + 1):
        y = multiply(w)
        space, images = np.hstack([space, w]), np.hstack([images, y])
        h = space.T @ images
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        asked = min(count, len(values))
        vectors = space @ u[:, :asked]
        off = images @ u[:, :asked] - vectors * values[:asked]
        size = max(float(values[0]), 0.0)
        residual = float(np.sqrt((off * off).sum(0)).max())
        stuck = stuck + 1 if residual > best / 2 else 0
        best = min(best, residual)
        level = size * eps * 16 * math.sqrt(dim)
        if space.shape[1] >= dim or residual <= level or (stuck > 20 and residual <= 1e3 * level):
            break
        w = _orthonormal(y, space, level)
        if not w.shape[1]:
            break
        if space.shape[1] + block > _MOST_COLUMNS:  # go on from the best part and the same next block
            space, images = space @ u[:, : 4 * block], images @ u[:, : 4 * block]
    else:
        raise RuntimeError(f"no principal axes after {_MOST_PASSES} passes, residual {residual:.1e}")
    return values[:asked], vectors, passes


def axes_by_passes(blocks: VectorBlocks) -> Basis:
    """The two leading axes without the d x d matrix."""
    n, unit = blocks.n, blocks.exponent - 3 * _LIMB
    mean = np.array([math.ldexp(s / n, unit) for s in exact_sums(blocks)])
    exponents = _exponents(blocks, mean)
    values, vectors, _ = leading_axes(lambda w: _times(blocks, mean, w, exponents), blocks.dim)
    return _basis(mean, values, vectors)


def box_of(low: tuple[float, float], high: tuple[float, float]) -> tuple[tuple[float, float], float]:
    """(centre, span) of a bounding box: the larger side, where a side of 0 counts as 1."""
    spans = [(h - l) or 1.0 for l, h in zip(low, high)]
    return ((low[0] + high[0]) / 2.0, (low[1] + high[1]) / 2.0), max(spans)


def fit_pca(blocks: VectorBlocks, exact_dim: int = EXACT_DIM) -> Basis:
    """The axes, then the bounding box of the projected rows in one more pass."""
    basis = principal_axes(*moments(blocks)) if blocks.dim <= exact_dim else axes_by_passes(blocks)

    def step(batches: Iterable[Batch]) -> State | None:
        state = None
        for _, x in batches:
            xy = basis.project(x)
            found = {"low": xy.min(axis=0), "high": xy.max(axis=0)}
            state = found if state is None else merge(state, found)
        return state

    def merge(a: State, b: State) -> State:
        return {"low": np.minimum(a["low"], b["low"]), "high": np.maximum(a["high"], b["high"])}

    if blocks.n > 1:
        box = blocks.fold(step, merge)
        low, high = box["low"].tolist(), box["high"].tolist()
        basis.centre, basis.span = box_of(low, high)
    return basis
