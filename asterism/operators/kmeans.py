"""k-means that gives the same clusters for every partitioning.

Seeding draws k-means++ centres as an exponential race over hashed ids; Lloyd iterations run all
requested k together, one job per iteration; sums are exact (see ``blocks``).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np

from ..constants import ELBOW_K_MAX, ELBOW_K_MIN, KMEANS_MAX_ITER, KMEANS_SEED
from ..functions.draws import exponentials
from .blocks import (
    GRID_BITS,
    Batch,
    State,
    VectorBlocks,
    add_states,
    join_int,
    limbs,
    split_int,
    to_float,
)

TIE = 1e-9
_KEPT = 16  # race entrants each task reports per step
_HALF = GRID_BITS // 2
_ROWS = 4096  # rows per matrix product, so that its parts stay in the processor's cache


# ---- distances ---------------------------------------------------------------------------------


def squared_distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance of every row to one centre, each row by itself."""
    diff = x - centre
    return np.einsum("ij,ij->i", diff, diff)


def nearest_in(x: np.ndarray, models: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per model (k x d centres), the index of the nearest centre per row; low indexes win ties.

    Distances within TIE times the largest length here count as equal. One matrix product ranks the
    centres of all models; rows whose best two lie near each other are decided again from plain
    differences, so the answer never depends on how rows are batched.
    """
    every = np.vstack(models)
    c2 = np.einsum("ij,ij->i", every, every)
    scores = (-2.0 * every) @ x.T
    scores += c2[:, None]
    lengths = np.sqrt(np.einsum("ij,ij->i", x, x))
    near = 8.0 * (x.shape[1] + 4) * np.finfo(float).eps + 4.0 * TIE
    found, start = [], 0
    for centres in models:
        k = len(centres)
        part = scores[start : start + k]
        reach = lengths + math.sqrt(c2[start : start + k].max())
        start += k
        own, best = np.zeros(len(x), dtype=np.int64), part[0].copy()
        for c in range(1, k):
            own[part[c] < best] = c
            np.minimum(best, part[c], out=best)
        best += near * reach * reach
        close = np.flatnonzero((part <= best).sum(axis=0) > 1)
        if len(close):
            rows = x[close]
            exact = np.stack([np.sqrt(squared_distance(rows, c)) for c in centres])
            own[close] = (exact <= exact.min(axis=0) + TIE * reach[close]).argmax(axis=0)
        found.append(own)
    return found


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre per row."""
    return nearest_in(x, [centres])[0]


# ---- seeding -----------------------------------------------------------------------------------


def _race(ids: np.ndarray, weight: np.ndarray, seed: int, t: int) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(weight > 0.0, exponentials(ids, seed, t) / weight, np.inf)


def _closest(x: np.ndarray, centres: Sequence[np.ndarray]) -> np.ndarray:
    best = np.ones(len(x)) if not len(centres) else np.full(len(x), np.inf)
    for c in centres:
        np.minimum(best, squared_distance(x, c), out=best)
    return best


def _first(scores: np.ndarray, ids: np.ndarray, vecs: np.ndarray, keep: int):
    """The ``keep`` finite scores that come first, and the score at which the rest starts."""
    if len(scores) > keep + 1:
        part = np.argpartition(scores, keep)[: keep + 1]
        part = np.flatnonzero(scores <= scores[part].max())
        scores, ids, vecs = scores[part], ids[part], vecs[part]
    order = np.lexsort((ids, scores))
    scores, ids, vecs = scores[order], ids[order], vecs[order]
    rest = scores[keep] if len(scores) > keep else np.inf
    kept = np.isfinite(scores[:keep])
    return scores[:keep][kept], ids[:keep][kept], vecs[:keep][kept].copy(), rest


def _entrants(blocks: VectorBlocks, centres: list, seed: int, steps: range) -> State:
    """Per step: the first rows of a race weighted by the distance to the centres so far.

    Later centres only shrink the weights, so a score here is a lower bound for later steps.
    """

    def join(a, b):
        scores, ids, vecs, rest = _first(
            np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]]), _KEPT
        )
        return scores, ids, vecs, min(rest, a[3], b[3])

    def step(batches: Iterable[Batch]) -> State | None:
        state = None
        for ids, x in batches:
            weight = _closest(x, centres)
            found = {}
            for t in steps:
                found[t] = _first(_race(ids, weight, seed, t), ids, x, _KEPT)
                flat = _first(exponentials(ids, seed, t), ids, x, 1)
                found[-1 - t] = flat
            state = found if state is None else merge(state, found)
        return state

    def merge(a: State, b: State) -> State:
        out = {}
        for key in a:
            if key >= 0:
                out[key] = join(a[key], b[key])
            else:
                both = [np.concatenate([a[key][i], b[key][i]]) for i in range(3)]
                out[key] = _first(*both, 1)
        return out

    size = len(steps) * (_KEPT + 1) * (blocks.dim + 2) * 8
    return blocks.fold(step, merge, state_bytes=size)


def seed_centres(blocks: VectorBlocks, k: int, seed: int = KMEANS_SEED) -> tuple[list[int], np.ndarray]:
    """(row ids, k x d centres) by k-means++.

    Step t takes the row with the smallest -ln(u) / d2, u drawn from (seed, t, id) and d2 the
    squared distance to the nearest centre so far: a draw with probability proportional to d2.
    When every row lies on a centre, rows drawn uniformly pad the list. The centres for k are the
    first k of those for any larger k.

    One pass settles many steps: a row outside the reported entrants cannot beat the score at
    which the rest starts, so a step is settled when its winner comes before that score.
    """
    known = blocks.seeds.setdefault(seed, ([], []))
    ids, centres = known
    while len(centres) < k:
        first = len(centres)
        steps = range(first, k) if first else range(1)
        state = _entrants(blocks, list(centres), seed, steps)
        for t in steps:
            _, rows, vecs, rest = state[t]
            scores = _race(rows, _closest(vecs, centres), seed, t) if len(rows) else np.array([])
            order = np.lexsort((rows, scores))
            if len(order) and np.isfinite(scores[order[0]]):
                if t > first and scores[order[0]] >= rest:
                    break
                pick = rows[order[0]], vecs[order[0]]
            elif np.isfinite(rest):
                break
            else:
                pick = state[-1 - t][1][0], state[-1 - t][2][0]
            ids.append(int(pick[0]))
            centres.append(np.array(pick[1]))
    return ids[:k], np.stack(centres[:k])


# ---- Lloyd -------------------------------------------------------------------------------------


@dataclass
class KMeansModel:
    k: int
    centroids: np.ndarray  # after the last update
    assign_by: np.ndarray  # the centroids that decided the final assignments
    sizes: np.ndarray
    iterations: int
    inertia: float | None = None


def _cluster_sums(blocks: VectorBlocks, stacks: dict[int, np.ndarray]) -> State:
    """Exact sums and counts per cluster of every model under its current centroids."""
    dim, ks = blocks.dim, list(stacks)
    scale = 2.0 ** (_HALF - blocks.exponent)
    first = np.cumsum([0, *ks])

    def step(batches: Iterable[Batch]) -> State | None:
        totals, counts = np.zeros((2, 2, first[-1], dim), np.int64), np.zeros(first[-1], np.int64)
        for _, x in batches:
            for start in range(0, len(x), _ROWS):
                part = x[start : start + _ROWS]
                member = np.zeros((first[-1], len(part)))
                for offset, own in zip(first, nearest_in(part, list(stacks.values()))):
                    member[own + offset, np.arange(len(part))] = 1.0
                whole = part * scale
                high = np.floor(whole)
                whole -= high  # multiples of 2**-26: their sums are exact as well
                totals += split_int(np.stack([member @ high, (member @ whole) * 2.0**_HALF]))
                counts += member.sum(axis=1).astype(np.int64)
        return {"sums": totals, "counts": counts}

    state = blocks.fold(step, add_states, state_bytes=int(first[-1]) * (dim + 1) * 32)
    sums = join_int(state["sums"])
    return {
        k: (sums[:, a : a + k], state["counts"][a : a + k]) for k, a in zip(ks, first.tolist())
    }


def lloyd(
    blocks: VectorBlocks, starts: dict[int, np.ndarray], max_iter: int = KMEANS_MAX_ITER
) -> dict[int, KMeansModel]:
    """Lloyd iterations of several k at once: one job per iteration carries all models that move.

    With exact sums, unchanged centroids and unchanged assignments are the same thing, so a model
    stops when its centroids repeat. An empty cluster keeps its centroid.
    """
    models = {
        k: KMeansModel(k, c, c, np.zeros(k, np.int64), 0) for k, c in starts.items()
    }
    moving = set(models)
    for _ in range(max_iter):
        if not moving:
            break
        state = _cluster_sums(blocks, {k: models[k].centroids for k in sorted(moving)})
        for k in sorted(moving):
            model = models[k]
            sums, counts = state[k]
            after = model.centroids.copy()
            for c in np.flatnonzero(counts):
                total = sums[0, c] * (1 << _HALF) + sums[1, c]
                after[c] = [to_float(s, int(counts[c]), blocks.exponent - GRID_BITS) for s in total]
            still = np.array_equal(after, model.centroids)
            only_first = model.iterations == 0 and counts[0] == blocks.n
            model.assign_by, model.centroids = model.centroids, after
            model.sizes = counts
            model.iterations += 1
            if still or only_first:
                moving.discard(k)
    return models


def measure_inertia(blocks: VectorBlocks, models: dict[int, KMeansModel]) -> None:
    """Sum of squared distances to the own final centroid, for all models in one pass."""
    top = 2 * blocks.exponent + 3 + math.ceil(math.log2(blocks.dim + 1))
    centres = {k: (m.assign_by, m.centroids) for k, m in models.items()}

    def step(batches: Iterable[Batch]) -> State | None:
        totals = {k: np.zeros((2, 3), np.int64) for k in centres}
        for _, x in batches:
            for k, (assign_by, final) in centres.items():
                diff = x - final[nearest(x, assign_by)]
                parts = limbs(np.einsum("ij,ij->i", diff, diff), top, _HALF, 3)
                totals[k] += split_int(np.array([p.sum() for p in parts]))
        return {str(k): v for k, v in totals.items()}

    state = blocks.fold(step, add_states)
    for k, model in models.items():
        high, mid, low = join_int(state[str(k)])
        total = (high << (2 * _HALF)) + (mid << _HALF) + low
        model.inertia = to_float(total, 1, top - 3 * _HALF)


def fit_kmeans(
    blocks: VectorBlocks, ks: Sequence[int], seed: int = KMEANS_SEED, max_iter: int = KMEANS_MAX_ITER
) -> dict[int, KMeansModel]:
    """Models for several k (each bounded to 1..n) from one seeding and one Lloyd loop."""
    if blocks.n == 0:
        return {}
    bounded = sorted({max(1, min(int(k), blocks.n)) for k in ks})
    _, centres = seed_centres(blocks, bounded[-1], seed)
    return lloyd(blocks, {k: centres[:k] for k in bounded}, max_iter)


# ---- choosing k --------------------------------------------------------------------------------


def elbow(curve: Sequence[tuple[int, float]]) -> int:
    """The k whose inertia lies farthest from the chord of the curve; the smallest k wins ties."""
    (x0, y0), (x1, y1) = curve[0], curve[-1]
    chord = math.hypot(x1 - x0, y1 - y0) or 1.0
    best, far = x0, -math.inf
    for x, y in curve:
        gap = abs((y1 - y0) * (x - x0) - (x1 - x0) * (y - y0)) / chord
        if gap > far:
            best, far = x, gap
    return best


def scan_k(
    blocks: VectorBlocks,
    k_min: int = ELBOW_K_MIN,
    k_max: int = ELBOW_K_MAX,
    seed: int = KMEANS_SEED,
    max_iter: int = KMEANS_MAX_ITER,
) -> tuple[int, dict[int, KMeansModel]]:
    """(chosen k, models by k with their inertia). Up to two rows, k is the number of rows."""
    n = blocks.n
    if n <= 2:
        return max(1, n), {}
    k_max, k_min = min(k_max, n - 1), max(2, k_min)
    if k_max < k_min:
        return k_min, {}
    models = fit_kmeans(blocks, range(k_min, k_max + 1), seed, max_iter)
    measure_inertia(blocks, models)
    return elbow([(k, models[k].inertia) for k in sorted(models)]), models
