import math

import numpy as np
import pytest

from asterism.operators import layout, nearest_point
from asterism.operators.blocks import VectorBlocks
from asterism.operators.nearest_point import pick_nearest
from asterism.operators.pca import fit_pca
from test_vectors import frame


def points(spark, rows, parts=1):
    data = [(i, float(r[0]), float(r[1]), r[2] if len(r) > 2 else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id long, x double, y double, cluster int").repartition(parts)


def xy(df, key="id"):
    return [(r.x, r.y) for r in df.orderBy(key).collect()]


def test_normalised_into_the_box(spark):
    assert xy(layout.normalize_coords(points(spark, [(-3, 5), (17, 25)]))) == [(-1, -1), (1, 1)]
    assert xy(layout.normalize_coords(points(spark, [(8, -6)] * 3))) == [(0, 0)] * 3
    assert xy(layout.normalize_coords(points(spark, [(0, 0)]).limit(0))) == []
    # One side of 0 counts as 1, so a shorter other side does not fill the box.
    assert xy(layout.normalize_coords(points(spark, [(0, 3), (0.5, 3)]))) == [(-0.5, 0), (0.5, 0)]


def test_random_points_land_in_the_box_and_keep_their_number(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 40):
        rows = rng.uniform(-1e6, 1e6, size=(n, 2))
        got = xy(layout.normalize_coords(points(spark, rows.tolist())))
        assert len(got) == n and all(abs(v) <= 1.0001 for p in got for v in p)


def test_rotation(spark):
    p = points(spark, [(-0.7, 0.2), (0, 3)])
    assert xy(layout.rotate_coords(p, 4 * math.pi))[0] == pytest.approx((-0.7, 0.2))
    assert xy(layout.rotate_coords(p, math.pi / 2))[1] == pytest.approx((-3, 0))
    assert math.hypot(*xy(layout.rotate_coords(p, 0.4321))[0]) == pytest.approx(math.hypot(0.7, 0.2))


def test_turning_once_by_the_whole_angle_equals_turning_step_by_step(spark):
    p = layout.normalize_coords(points(spark, [(0, 0), (3, 1), (1, 4), (2, 2)]))
    steps = p
    for _ in range(3):
        steps = layout.reproject(steps, 0.9)
    assert xy(steps) == [pytest.approx(q) for q in xy(layout.reproject(p, 0.9, 3))]


def test_box(spark):
    p = points(spark, [(-1, -1), (1, 1), (0, 0)])
    assert xy(layout.scale_to_box(p, 300, 140, 30)) == [(30, 30), (270, 110), (150, 70)]
    assert xy(layout.scale_to_box(p, 5, 4, 9)) == [(9, 9), (10, 10), (9.5, 9.5)]


def test_centres_and_edges(spark):
    p = points(spark, [(0, 0, 0), (2, 0, 0), (10, 10, 1), (9, 9, 7), (5, 5, None)])
    assert xy(layout.cluster_centroids_2d(p, 3), "cluster") == [(1, 0), (10, 10), (0, 0)]
    got = {(r.id, r.cx, r.cy) for r in layout.constellation_edges(p, 3).collect()}
    assert got == {(0, 1, 0), (1, 1, 0), (2, 10, 10)}


def test_isolate_and_highlight(spark):
    p = points(spark, [(0, 0, 0), (1, 1, 1), (2, 2, None)])
    assert [r.id for r in layout.isolate(p, 1).collect()] == [1]
    assert [r.dimmed for r in layout.highlight(p, 1).orderBy("id").collect()] == [True, False, True]
    assert not any(r.dimmed for r in layout.highlight(p, -1).collect())


def test_siblings_have_one_row_per_point(spark):
    p = points(spark, [(0, 0, 0)] * 3 + [(0, 0, 1)] * 2 + [(0, 0, 2), (0, 0, 9)])
    probes = spark.createDataFrame([(0,), (1,), (3,), (6,), (77,)], "id long")
    got = {r.id: (r.n_probes, r.is_probe, r.is_sibling) for r in layout.siblings(p, probes, 3).collect()}
    assert got == {
        0: (2, True, True), 1: (2, True, True), 2: (2, False, True), 3: (1, True, False), 4: (1, False, True),
    }


def picked(spark, probes, pts, radius=14.0, parts=3):
    q = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(probes)], "probe_id long, px double, py double")
    return [r.id for r in pick_nearest(q, points(spark, pts, parts), radius).orderBy("probe_id").collect()]


def grid_case(seed, n, radius, step=0.5):
    """Seeded points on a coarse grid, so that equal distances and equal spots are common, and probes around them."""
    rng = np.random.default_rng(seed)
    pts = rng.integers(-8, 9, (n, 2)) * step
    probes = np.vstack([rng.integers(-20, 21, (n, 2)) * step / 2, pts[:3] + [radius, 0], [[1e6, -1e6]]])
    return probes.tolist(), pts.tolist()


@pytest.mark.parametrize("radius", [0.0, 0.5, 1.75, 40.0])
def test_nearest_within_the_radius(spark, radius):
    probes, pts = grid_case(int(radius * 4), 60, radius)
    assert picked(spark, probes, pts, radius) == brute_nearest(probes, pts, radius)


def test_nearest_without_points(spark):
    q = spark.createDataFrame([(4, 1.5, 2.5), (4, 1.5, 2.5)], "probe_id long, px double, py double")
    got = pick_nearest(q, points(spark, [(9, 9)]).limit(0)).collect()
    assert [(r.probe_id, r.id) for r in got] == [(4, -1)]
    assert pick_nearest(q.limit(0), points(spark, [(9, 9)])).count() == 0


def test_a_probe_id_at_several_places_and_odd_probes(spark):
    q = spark.createDataFrame(
        [(7, 0.0, 0.0), (7, 50.0, 50.0), (7, 0.0, 0.0), (8, None, 1.0), (9, float("nan"), 0.0), (9, float("inf"), 0.0)],
        "probe_id long, px double, py double",
    )
    got = sorted((r.probe_id, r.id) for r in pick_nearest(q, points(spark, [(1, 1), (49, 50)]), 5.0).collect())
    assert got[:2] == [(7, 0), (7, 1)] and {i for p, i in got if p > 7} == {-1} and {p for p, _ in got} == {7, 8, 9}


def brute_nearest(probes, pts, radius):
    out = []
    for px, py in probes:
        best, far = -1, radius * radius
        for i, (x, y) in enumerate(pts):
            d = (x - px) * (x - px) + (y - py) * (y - py)
            if d <= far:
                best, far = i, d
        out.append(best)
    return out


@pytest.mark.parametrize("parts_of,blocks_of", [(1 << 16, 1 << 16), (50, 1 << 16), (16, 7)])
@pytest.mark.parametrize("shape", ["crowded", "far point", "far below", "lines"])
def test_parts_of_the_curve_agree_with_brute_force(spark, monkeypatch, shape, parts_of, blocks_of):
    monkeypatch.setattr(nearest_point, "PART_POINTS", parts_of)
    monkeypatch.setattr(nearest_point, "BLOCK_PROBES", blocks_of)
    monkeypatch.setattr(nearest_point, "_LEAF", 4)
    monkeypatch.setattr(nearest_point, "_LEAST_BOX", 5)
    rng = np.random.default_rng(2)
    crowd = rng.normal(size=(400, 2)) * 0.02 + [3.0, -4.0]
    ring = np.stack([np.cos(np.arange(200)), np.sin(np.arange(200))], axis=1) * 5
    pts = np.vstack([crowd, np.tile([7.0, 7.0], (100, 1)), ring, rng.uniform(-30, 30, size=(300, 2))])
    if shape == "far point":
        pts = np.vstack([pts, [[1e15, 3.0]]])
    elif shape == "far below":
        pts = np.vstack([pts, [[-1e15, -1e12], [2.0, -1e300]]])
    elif shape == "lines":
        pts = np.stack([np.repeat([0.0, 1.0, 2.0], 200), np.tile(np.linspace(0, 1e5, 200), 3)], axis=1)
    probes = np.vstack([
        rng.normal(size=(150, 2)) * 0.05 + [3.0, -4.0], rng.uniform(-35, 35, size=(150, 2)), np.tile([[0, 0], [7, 7]], (40, 1)), pts[-5:] + 0.25,
    ])
    got = picked(spark, probes.tolist(), pts.tolist(), radius=2.5, parts=4)
    assert got == brute_nearest(probes.tolist(), pts.tolist(), 2.5)


def test_points_are_copied_for_few_groups_of_probes(spark, monkeypatch):
    monkeypatch.setattr(nearest_point, "PART_POINTS", 200)
    monkeypatch.setattr(nearest_point, "BLOCK_PROBES", 16)
    dealt = []
    make = type(spark).createDataFrame

    def spy(self, data, schema=None, *args, **kwargs):
        if schema == "part int, blocks int":
            dealt.extend(data)
        return make(self, data, schema, *args, **kwargs)

    monkeypatch.setattr(type(spark), "createDataFrame", spy)
    rng = np.random.default_rng(8)
    pts, probes = rng.uniform(-9, 9, (800, 2)).tolist(), rng.uniform(-9, 9, (1200, 2)).tolist()
    assert picked(spark, probes, pts, radius=0.5) == brute_nearest(probes, pts, 0.5)
    assert len(dealt) >= 4 and sum(200 * blocks for part, blocks in dealt if part >= 0) <= 2 * (len(pts) + len(probes))


def test_points_at_one_distance_from_many_probes(monkeypatch):
    monkeypatch.setattr(nearest_point, "_PAIRS", 2000)
    turn = np.linspace(0, 2 * np.pi, 3000, endpoint=False)
    x, y = np.cos(turn), np.sin(turn)
    px = py = np.zeros(50)
    d2, ids = nearest_point.nearest_inside(x, y, np.arange(3000), px, py, np.full(50, 9.0), 9.0, 9.0)
    own = x * x + y * y
    assert set(d2) == {own.min()} and set(ids) == {int(np.flatnonzero(own == own.min()).max())}


def test_keys_follow_the_curve_and_parts_are_even(spark, monkeypatch):
    curve = nearest_point.Curve(0.0, 0.0, 1.0)
    x, y = np.array([0, 1, 0, 1, 2, 2.5, 1e30]), np.array([0, 0, 1, 1, 0, 3, -1e30])
    assert curve.key(*curve.cells(x, y)).tolist()[:6] == [0, 1, 2, 3, 4, 14]
    monkeypatch.setattr(nearest_point, "PART_POINTS", 100)
    monkeypatch.setattr(nearest_point, "_LEAST_BOX", 8)
    rng = np.random.default_rng(4)
    rows = np.vstack([rng.normal(size=(3000, 2)) * 1e-3, rng.uniform(-50, 50, (1000, 2))])
    ranged, parts = nearest_point._in_parts(points(spark, rows.tolist()), 1.0, 1.0)
    counts = [r["count"] for r in ranged.groupBy("part").count().collect()]
    assert len(parts.first) == 40 * parts.each and max(counts) < 300
    who, part, _ = parts.wanted(rows[:, 0], rows[:, 1])  # crowded probes meet few parts
    assert len(who) < 5 * len(rows)


def place(spark, rows, parts=1):
    blocks = VectorBlocks.of(frame(spark, rows, parts))
    basis = fit_pca(blocks)
    blocks.close()
    return basis, basis.place(np.array(rows, dtype=float))


def test_projection_of_small_inputs(spark):
    rng = np.random.default_rng(13)
    assert place(spark, rng.normal(size=(1, 6)).tolist())[1].tolist() == [[0, 0]]
    _, got = place(spark, np.tile(rng.normal(size=7), (5, 1)).tolist())
    assert np.abs(got).max() < 1e-12
    spots = np.sort(rng.uniform(0, 9, 6))  # in one dimension the layout is the scaled line itself
    _, got = place(spark, spots[:, None].tolist())
    want = (spots - (spots[0] + spots[-1]) / 2) / (spots[-1] - spots[0]) * 2
    assert np.allclose(got[:, 1], 0) and np.allclose(np.abs(got[:, 0]), np.abs(want))
    _, got = place(spark, (rng.normal(size=(25, 2)) @ rng.normal(size=(2, 9))).tolist())
    assert np.isfinite(got).all() and np.abs(got).max() <= 1.0001


def test_projection_separates_groups_and_matches_an_svd(spark):
    rng = np.random.default_rng(14)
    near, apart = rng.normal(size=(2, 7, 4)) * 0.1
    _, got = place(spark, np.vstack([near, apart + rng.normal(size=4) * 20]).tolist())
    assert abs(got[:7, 0].mean() - got[7:, 0].mean()) > 1
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) * [5, 3, 1, 1, 1]
    basis, _ = place(spark, x, 4)
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    for mine, theirs in zip(basis.axes, axes):
        assert abs(mine @ theirs) == pytest.approx(1)
        assert mine[np.abs(mine).argmax()] > 0
    again, _ = place(spark, x, 7)
    assert again.axes.tobytes() == basis.axes.tobytes() and again.span == basis.span
