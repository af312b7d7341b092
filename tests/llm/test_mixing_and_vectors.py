"""Mixing, clustering and whitening against plain computations and brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from asterism.llm import clustering, mixing, queries, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing ----------------------------------------------------------------------------------------


def test_words_are_counted_like_the_pattern():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \t\n\x0b\x0c\r\xa0é日") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    texts += ["", None, " ", "x", "x" * 5000, " a" * 3000]
    want = [len(WORD.findall(t or "")) for t in texts]
    assert mixing.count_words(pa.array(texts)).tolist() == want
    assert mixing.count_words(pa.array(texts).slice(7, 300)).tolist() == want[7:307]
    assert mixing.count_words(pa.array([], pa.string())).tolist() == []


def sums(sizes, room):
    reach = {0}
    for s, n in zip(sizes, room):
        reach = {r + s * k for r in reach for k in range(n + 1)}
    return reach


@pytest.mark.parametrize("seed", range(40))
def test_the_knapsack_finds_the_nearest_sum(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 6)))
    room = [rng.randint(0, 4) for _ in sizes]
    goal = rng.randint(1, 150)
    taken = mixing.nearest_sum(sizes, room, goal)
    assert all(0 <= t <= n for t, n in zip(taken, room))
    got = sum(s * t for s, t in zip(sizes, taken))
    assert got == min(sums(sizes, room), key=lambda r: (abs(r - goal), r))


@pytest.mark.parametrize("exact", [1 << 16, 64])
@pytest.mark.parametrize("seed", range(12))
def test_a_plan_comes_near_its_target(seed, exact):
    rng = random.Random(100 + seed)
    sizes = sorted(rng.sample(range(1, 400), rng.randint(1, 60)))
    counts = [rng.randint(1, 9) for _ in sizes]
    total = sum(s * n for s, n in zip(sizes, counts))
    target = rng.choice([0, 0.1, 0.5, 1, 1.7, 2.99, 3]) * total
    plan = mixing.plan_source(sizes, counts, target, exact=exact)
    assert all(0 <= c <= 3 and 0 <= e < n and (e == 0 or c < 3) for (c, e), n in zip(plan, counts))
    got = sum(s * (c * n + e) for s, n, (c, e) in zip(sizes, counts, plan))
    assert abs(got - target) <= (1 if len(sizes) > 10 else min(sizes))


def test_a_plan_of_sizes_with_a_common_factor_and_of_one_document():
    assert mixing.plan_source([10, 20], [5, 5], 75.0) in ([(0, 3), (0, 2)], [(0, 1), (0, 3)], [(0, 5), (0, 1)])
    assert mixing.plan_source([100], [1], 60.0) == [(1, 0)]
    assert mixing.plan_source([100], [1], 40.0) == [(0, 0)]
    assert mixing.plan_source([30, 1000], [1, 1], 90.0) == [(3, 0), (0, 0)]  # further copies come nearer
    assert mixing.plan_source([10**6], [7], 3.4e6) == [(0, 3)]
    assert mixing.plan_source([], [], 0.0) == []


def plain_targets(words, weights=(5, 2, 1), most=3):
    """Exact shares; sources above their limit are held, the excess is shared again."""
    order = sorted((k for k in words if k is not None)) + ([None] if None in words else [])
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    held, left = {}, sum(words.values())
    while True:
        free = [k for k in order if k not in held]
        share = {k: Fraction(left * weight[k], sum(weight[f] for f in free)) for k in free} if free else {}
        over = [k for k in free if share[k] > most * words[k]]
        if not over:
            return {k: float(held.get(k, share.get(k))) for k in order}
        for k in over:
            held[k] = most * words[k]
            left -= held[k]


MIXED = "doc_id long, text string, source string, size long, copies long, key string, document string"


def mixed_rows(n, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "B", "", None, "z", "small"]
    rows = []
    for i in range(n):
        source = "a" if i % 3 == 0 else rng.choice(names)
        words = rng.randint(1, 3) if source == "small" else rng.randint(0, 40)
        text = None if i % 29 == 0 else " ".join("w" * rng.randint(1, 5) for _ in range(words))
        rows.append((None if i % 17 == 0 else i // 2, text, source, 1, 2, "k", "d"))
    return rows + [(5, "copy of it", "a", 1, 2, "k", "d")] * 90 + [(7, "x " * 30000, "a", 1, 2, "k", "d")]


def test_a_mix_meets_its_targets_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTS", 7)
    rows = mixed_rows(900, 1)
    docs = spark.createDataFrame(rows, MIXED)
    got = mixing.mix_sources(docs.repartition(5)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    words = Counter()
    for _, text, source, *_ in rows:
        words[source] += size(text)
    targets = plain_targets(words)
    assert sorted(map(str, ((r.doc_id, r.source, r.size) for r in got))) == sorted(str((i, s, size(t))) for i, t, s, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-12)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    again = mixing.mix_sources(docs.orderBy("text").repartition(2)).collect()
    assert Counter(got) == Counter(again)
    other = mixing.mix_sources(docs, seed=12).collect()
    assert Counter(other) != Counter(got)


def test_the_mix_itself_repeats_rows(spark):
    docs = spark.createDataFrame(mixed_rows(200, 2), MIXED)
    planned = mixing.mix_sources(docs, keep=["text", "size"]).collect()
    assert all(r.document.size == 1 for r in planned)
    mix = mixing.mixed_documents(docs)
    assert mix.columns == docs.columns
    want = Counter()
    for r in planned:
        want[r.doc_id, r.document.text] += r.copies
    assert Counter((r.doc_id, r.text) for r in mix.collect()) == +want


def test_mixing_empty_tables_and_texts(spark):
    assert mixing.mix_sources(spark.createDataFrame([], MIXED)).count() == 0
    blank = spark.createDataFrame([(1, None, None, 0, 0, "", ""), (2, " ", "a", 0, 0, "", "")], MIXED)
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


# ---- clustering ------------------------------------------------------------------------------------


def plain_rounds(rows, k, rounds):
    """Lloyd in Python integers; rows are (vec_id, tuple)."""
    if not rows:
        return []
    draw = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [list(v) for _, v in sorted(rows, key=draw)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in rows:
            groups[nearest(v)[1]].append(v)
        for j, vs in groups.items():
            centres[j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in rows], centres


VECTORS = "vec_id long, embedding array<double>, v string, cluster string, upper long, label int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 3, 0) for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("case", ["plain", "crowded", "equal", "few", "large", "vast"])
def test_clusters_equal_plain_rounds(spark, case):
    rng = np.random.default_rng(4)
    dim, n, k = 3, 160, 5
    x = rng.normal(size=(n, dim)) * 0.2
    if case == "crowded":
        x = rng.integers(-2, 3, (n, dim)) / 64.0  # many ties and repeated vectors
    elif case == "equal":
        x[:] = 0.25
    elif case == "few":
        x = x[:3]
    elif case == "large":
        x *= 2.0**22
    elif case == "vast":
        x *= 2.0**52
    rows = [(int(i) if i % 11 else None, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, v) for _, v in rows[:2]]
    whole = [(i, tuple(math.floor(64 * c) for c in v)) for i, v in rows]
    broken = [(1, None), (2, [0.1, None, 0.2]), (3, [0.1, float("nan"), 0.2]), (4, [0.1, float("inf"), 0.2]), (5, [0.1]), (6, [])]
    df = vector_frame(spark, rows + broken)
    found = clustering.cluster_rows(clustering.whole_rows(df, dim), k, 3)
    want, centres = plain_rounds(whole, k, 3)
    got = [(r.vec_id, r.cluster, r.distance) for r in found.rows.collect()]
    most = 2**63 - 1
    assert Counter(got) == Counter((i, c, min(d, most)) for i, c, d in want)
    assert found.centroids == centres
    if case != "vast":
        totals = Counter()
        for _, c, d in want:
            totals[c] += d
        assert found.inertias == [totals[j] for j in range(len(centres))]


def test_no_vectors_no_clusters(spark):
    found = clustering.cluster_rows(clustering.whole_rows(vector_frame(spark, [(1, None)]), 64))
    assert found.rows.count() == 0 and found.centroids == []


@pytest.mark.parametrize("seed", range(6))
def test_bounds_are_loosened_enough_and_less_than_by_the_drift(seed):
    rng = np.random.default_rng(seed)
    k, dim = 6, 2 + seed
    centres = rng.normal(size=(k, dim)) * 10
    moved = centres + rng.normal(size=(k, dim)) * rng.choice([0.01, 1, 20], (k, 1))
    moved[0] = centres[0]
    radius = rng.uniform(0, 8, k)
    by = clustering.loosened(centres, moved, radius)
    drift = np.linalg.norm(moved - centres, axis=1)
    assert (by <= drift[None, :] * (1 + 1e-9)).all() and (by.sum() < (drift[None, :] + 0 * by).sum())
    for i in range(k):
        way = rng.normal(size=(4000, dim))
        x = centres[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.uniform(0.2, 1, (4000, 1))
        nearer = np.linalg.norm(x[:, None] - centres, axis=2) - np.linalg.norm(x[:, None] - moved, axis=2)
        assert (nearer.max(0) <= by[i] + 1e-9).all()


def test_most_rows_of_separate_groups_are_not_compared(spark):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(4, 8)) * 3
    x = middles[rng.integers(0, 4, 2000)] + rng.normal(size=(2000, 8)) * 0.1
    df = vector_frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found = clustering.cluster_rows(clustering.whole_rows(df, 8), 4, 6)
    assert found.compared[-1] < 1000


def test_clustering_query_equals_brute_force_on_all_vectors(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet")
    whole = [(r.vec_id, tuple(math.floor(64 * float(c)) for c in r.embedding)) for r in df.collect()]
    want, centres = plain_rounds(whole, 16, 3)
    got = queries.QUERIES["op12_centroid_clustering"](spark, tables).collect()
    inertia = sum(d for *_, d in want)
    spelled = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    assert sorted((r.vec_id, r.cluster, r.distance, r.inertia, r.centroid_sha256) for r in got) == sorted(
        (i, c, d, inertia, spelled[c]) for i, c, d in want
    )


# ---- whitening -------------------------------------------------------------------------------------


def plain_whitening(vectors, p):
    """numpy on the different whole vectors: (n, S, eigenvalues, axes, trace)."""
    fit = np.array(sorted(set(vectors)), object)
    n, total = len(fit), fit.sum(0)
    centred = ((fit * n - total) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, total, values[::-1][:p], axes[:, ::-1][:, :p], values.sum()


def check_whitening(rows, vectors, p=16, loose=1e-6):
    n, total, values, axes, trace = plain_whitening(vectors, p)
    shifted = total  # without the offset of a million: deviations do not depend on it
    by_id = defaultdict(dict)
    for r in rows:
        by_id[r.vec_id][r.component] = r
    assert len(by_id) == len(vectors)
    for i, v in enumerate(vectors):
        mine = by_id[i]
        assert sorted(mine) == list(range(1, len(values) + 1))
        off = [n * a - s for a, s in zip(v, shifted)]
        want = np.array([a / n for a in off]) @ axes / np.sqrt(values)
        for c, r in mine.items():
            assert r.n == n and r.deviation == sum(a * a for a in off)
            assert abs(r.whitened) == pytest.approx(abs(want[c - 1]), abs=loose)
            assert r.explained == pytest.approx(values[c - 1] / trace, rel=1e-8)
            assert r.identity_error < 1e-9


def whole(x):
    return [tuple(math.floor(64 * c) for c in v) for v in x]


def test_whitening_query_equals_numpy(spark, tables):
    df = spark.read.parquet(f"{tables}/embeddings.parquet").orderBy("vec_id")
    vectors = whole([[float(c) for c in r.embedding] for r in df.collect()])
    check_whitening(queries.QUERIES["op13_embedding_whitening"](spark, tables).collect(), vectors)


def test_whitening_with_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 40)) @ np.diag(1.1 ** -np.arange(40))
    x[100:200] = x[7]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, [0.5])]  # the last one is padded
    broken = [(900, None), (901, [None] * 40), (902, [float("nan")] * 40), (903, [float("-inf")] * 40)]
    got = whitening.whitened_rows(whitening.whole_vectors(vector_frame(spark, rows + broken))).collect()
    check_whitening(got, whole(x) + [(32, *[0] * 39)])
    again = whitening.whitened_rows(whitening.whole_vectors(vector_frame(spark, rows[::-1]).coalesce(1))).collect()
    first = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(first[r.vec_id, r.component] == pytest.approx(r.whitened, abs=1e-7) for r in again)


def test_whitening_of_few_dimensions_and_without_variance(spark):
    make = lambda rows: whitening.whitened_rows(whitening.whole_vectors(vector_frame(spark, rows)))
    assert make([]).count() == 0 and make([(1, [])]).count() == 0
    assert make([(1, [0.5, 0.25])] * 3).count() == 0
    flat = make([(0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 1.0]), (None, [3.0, 1.0])]).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 4
    near = sorted(abs(r.whitened) for r in flat)
    assert near[2] == near[3] and sum(r.deviation for r in flat if r.vec_id == 0) == (3 * 0 - 256) ** 2
    vast = make([(0, [2.0**45]), (1, [-(2.0**45)])]).collect()
    assert [r.deviation for r in vast] == [2**63 - 1] * 2 and {round(abs(r.whitened), 9) for r in vast} == {1.0}


@pytest.mark.parametrize("shape", ["flat", "steep", "gap", "double", "low rank"])
def test_filtered_iteration_finds_the_leading_axes(shape):
    rng = np.random.default_rng(6)
    d = 150
    values = {
        "flat": np.linspace(1.2, 0.8, d), "steep": 10.0 ** -np.linspace(0, 8, d),
        "gap": np.r_[np.full(3, 5.0), np.linspace(1, 0.5, d - 3)], "double": np.repeat(np.linspace(3, 1, d // 2), 2),
        "low rank": np.r_[3.0, 2.0, 1.0, np.zeros(d - 3)],
    }[shape]
    axes = np.linalg.qr(rng.normal(size=(d, d)))[0]
    matrix = (axes * values) @ axes.T
    found, got, passes = whitening.leading_axes(lambda q: matrix @ q, d, 16)
    want = values[:16][values[:16] > 0]
    assert got == pytest.approx(want, rel=1e-9) and passes < 600
    assert np.abs(matrix @ found - found * got).max() < 1e-11 * values[0]
    assert np.abs(found.T @ found - np.eye(len(want))).max() < 1e-12


def test_combinations_of_the_sizes_are_all_tried():
    for goal in range(1, 30):
        for room in itertools.product(range(3), repeat=3):
            got = sum(s * t for s, t in zip([3, 5, 7], mixing.nearest_sum([3, 5, 7], room, goal)))
            assert abs(got - goal) == min(abs(r - goal) for r in sums([3, 5, 7], room))
