"""Wide vectors: covariance in blocks, axes by passes."""

import itertools

import numpy as np
import pytest

from asterism.operators import gram, pca, words
from asterism.operators import vectors as vec
from asterism.operators.blocks import VectorBlocks, moments


def frame(spark, x, parts=3):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, features array<double>").repartition(parts)


def value(w):
    return [sum(int(w[i, k]) << (32 * i) for i in range(len(w))) for k in range(w.shape[1])]


def test_words_are_exact_whole_numbers():
    rng = np.random.default_rng(0)
    numbers = np.concatenate([rng.integers(-(2**62), 2**62, 30), [0, 1, -1, 2**63 - 1, -(2**63)]])
    plain = [int(v) for v in numbers]
    for shift in range(0, 100, 7):
        w = words.empty(8, numbers.shape)
        for _ in range(3):
            words.add(w, numbers, shift)
        words.settle(w)
        assert value(w) == [3 * v << shift for v in plain]
        for factor in (0, 1, 2**31, 2**61 + 99):
            assert value(words.times(w, factor)) == [(3 * v << shift) * factor for v in plain]
    a, b = [-(3**50), 7, 0], [5**40, -1, 2**90]
    w = words.empty(12, (3, 3))
    words.subtract_products(w, words.halves(a), words.halves(b))
    got = words.to_float(w)
    for i, j in itertools.product(range(3), repeat=2):
        assert got[i, j] == pytest.approx(-float(a[i] * b[j]), rel=1e-15)


@pytest.mark.parametrize("dim", [1, 5, 128, 300])
def test_covariance_blocks_equal_the_moments(spark, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(70, dim)) * 10.0 ** rng.integers(-3, 3, dim) + 50
    found = []
    for parts in (1, 5):
        got = np.full((dim, dim), np.nan)
        for r in vec.covariance(frame(spark, x, parts)).collect():
            got[r.i, r.j] = r["cov"]
        found.append(got)
    assert np.array_equal(found[0], found[1]) and np.array_equal(found[0], found[0].T)
    np.testing.assert_allclose(found[0], np.cov(x.T, bias=True).reshape(dim, dim), rtol=1e-8, atol=1e-9)
    if dim <= 128:
        blocks = VectorBlocks.of(frame(spark, x))
        np.testing.assert_allclose(found[0], moments(blocks)[1], rtol=1e-15, atol=0)
        blocks.close()


def test_states_of_many_tasks_are_merged_in_groups(spark, monkeypatch):
    monkeypatch.setattr(gram, "_FAN", 3)
    x = np.random.default_rng(4).normal(size=(60, 4))
    blocks = VectorBlocks.of(frame(spark, x, 20))
    blocks.width = 20
    got = {(r.i, r.j): r["cov"] for r in gram.covariance_blocks(blocks).collect()}
    blocks.close()
    want = np.cov(x.T, bias=True)
    assert len(got) == 16 and all(got[i, j] == pytest.approx(want[i, j], rel=1e-12) for i, j in got)


def test_covariance_of_very_wide_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(48, 1536))
    df = vec.covariance(frame(spark, x, 2))
    assert df.count() == 1536**2
    want = np.cov(x.T, bias=True)
    some = df.filter("i % 500 = 3 and j % 400 = 7").collect()
    assert len(some) == 4 * 4 - 4 or some
    for r in some:
        assert r["cov"] == pytest.approx(want[r.i, r.j], rel=1e-10, abs=1e-13)


@pytest.mark.parametrize("shape", ["steep", "flat", "low rank", "zero", "double"])
def test_leading_axes_of_known_matrices(shape):
    rng = np.random.default_rng(7)
    d = 400
    values = {
        "steep": 0.8 ** np.arange(d), "flat": np.linspace(1, 0.6, d), "low rank": np.r_[4.0, 1.0, np.zeros(d - 2)],
        "zero": np.zeros(d), "double": np.r_[2.0, 2.0, np.linspace(1, 0, d - 2)],
    }[shape]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix = (q * values) @ q.T
    got, vectors, passes = pca.leading_axes(lambda w: matrix @ w, d)
    assert got == pytest.approx(values[:2], abs=1e-12) and passes < 120
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(2)).max() < 1e-12


def test_axes_by_passes_equal_those_of_the_covariance(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 40)) * 1.05 ** -np.arange(40) + rng.normal(size=40) * 100
    found = []
    for parts in (1, 3, 8):
        blocks = VectorBlocks.of(frame(spark, x, parts))
        found.append(pca.fit_pca(blocks, exact_dim=0))
        whole = pca.fit_pca(blocks)
        blocks.close()
    assert all(np.array_equal(f.axes, found[0].axes) and f.centre == found[0].centre for f in found)
    np.testing.assert_allclose(found[0].axes, whole.axes, atol=1e-10)
    np.testing.assert_allclose(found[0].variances, whole.variances, rtol=1e-12)
    assert found[0].span == pytest.approx(whole.span, rel=1e-10)


@pytest.mark.parametrize("x", [[[3.0] * 300], [[1.0] * 300] * 4, [[float(i)] * 300 for i in range(3)]])
def test_axes_of_wide_vectors_with_little_variance(spark, x):
    blocks = VectorBlocks.of(frame(spark, x))
    basis = pca.fit_pca(blocks)
    blocks.close()
    ranks = 1 if len({tuple(r) for r in x}) > 1 else 0
    assert (np.abs(basis.axes).sum(1) > 0).sum() == ranks
    if ranks:
        np.testing.assert_allclose(basis.axes[0], np.full(300, 300**-0.5), atol=1e-12)


def test_axes_of_four_thousand_columns(spark):
    rng = np.random.default_rng(9)
    dim = 4096
    x = rng.normal(size=(60, dim)) * 0.1
    x[:, 11] += 3 * rng.normal(size=60)
    x[:, 4000] += 2 * rng.normal(size=60)
    blocks = VectorBlocks.of(frame(spark, x, 2))
    basis = pca.fit_pca(blocks)
    blocks.close()
    _, size, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    np.testing.assert_allclose(basis.variances, size[:2] ** 2 / 60, rtol=1e-10)
    for axis, want in zip(basis.axes, v):
        assert abs(axis @ want) == pytest.approx(1, abs=1e-10)
