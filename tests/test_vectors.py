import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterism.functions import vector as V
from asterism.operators import vectors as vec
from asterism.operators import many_centroids, similar
from asterism.operators.blocks import VectorBlocks, limbs, moments
from asterism.sources.vectors import embed_hash, embed_with, load_vectors, vector_stats


def frame(spark, rows, parts=1):
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, "id long, features array<double>").repartition(parts)


@pytest.mark.parametrize(
    "a,b,dot,cosine,euclid",
    [
        ([2, 6], [1, 3], 20, 1, math.sqrt(10)),
        ([5, -2], [2, 5], 0, 0, math.sqrt(58)),
        ([0, 0], [7, 24], 0, 0, 25),
        ([8, 15], [0, 0], 0, 0, 17),
        ([1, 1], [-2, -2], -4, -1, math.sqrt(18)),
    ],
)
def test_pair_functions(spark, a, b, dot, cosine, euclid):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    a_, b_ = F.col("a"), F.col("b")
    got = df.select(V.dot(a_, b_), V.cosine(a_, b_), V.euclidean(a_, b_), V.norm(a_)).first()
    assert got == pytest.approx((dot, cosine, euclid, math.hypot(*a)))


def test_unit_vectors_and_zero(spark):
    got = [r.features for r in vec.normalize_vectors(frame(spark, [[-5, 12], [0, 0]])).orderBy("id").collect()]
    assert got == [[-5 / 13, 12 / 13], [0.0, 0.0]]


def test_means(spark):
    rng = np.random.default_rng(30)
    x, cluster = rng.normal(size=(25, 4)) * 7, rng.integers(0, 3, 25)
    assert vec.mean_vector(frame(spark, x, 3)).first().mean == pytest.approx(x.mean(0).tolist())
    assert vec.mean_vector(frame(spark, x).filter("id < 0")).first().mean == []
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cluster))]
    df = spark.createDataFrame(rows, "id long, features array<double>, cluster int").repartition(2)
    for r in vec.group_centroids(df).collect():
        mine = x[cluster == r.cluster]
        assert r.centroid == pytest.approx(mine.mean(0).tolist()) and r["size"] == len(mine)


def test_nearest_centroid_and_inertia_prefer_low_ids(spark):
    cents = spark.createDataFrame([(4, [1.0, 0.0]), (2, [-1.0, 0.0])], "cluster int, centroid array<double>")
    rows = frame(spark, [[0, 0], [0.9, 0], [-3, 0]])
    got = [(r.cluster, round(r.d2, 9)) for r in vec.nearest_centroid(rows, cents).orderBy("id").collect()]
    assert got == [(2, 1.0), (4, 0.01), (2, 4.0)]
    assert vec.inertia(rows, cents).first().inertia == pytest.approx(5.01)


def test_remove_component(spark):
    got = vec.remove_component(frame(spark, [[3, 4]]), [1.0, 0.0]).first().features
    assert got == [0.0, 4.0]


def test_load_vectors_and_stats(spark, tables):
    rows = load_vectors(spark.read.parquet(f"{tables}/embeddings.parquet"), "vec_id", "embedding")
    s = vector_stats(rows).first()
    assert (s.n_vectors, s.min_dim, s.max_dim) == (500, 64, 64) and abs(s.max_norm - 1) < 1e-6


def test_bad_vectors_are_refused(spark):
    for rows in ([[1.0], [1.0, 2.0]], [[float("nan")]], [[]]):
        with pytest.raises(ValueError):
            VectorBlocks.of(frame(spark, rows))


def test_limbs_are_exact():
    x = np.array([0.7, -0.3, 2.0**-40, -1.0])
    x = np.rint(x * 2**52) / 2**52
    parts = limbs(x, 0, 18, 3)
    assert all(np.array_equal(p, np.rint(p)) for p in parts)
    assert np.array_equal(sum(p * 2.0 ** (-18 * (i + 1)) for i, p in enumerate(parts)), x)


def test_moments_are_the_same_for_every_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * [1, 100, 1e-3, 1, 1, 1] + [1000, 0, 0, 5, 0, 0]
    found = []
    for parts in (1, 3, 8):
        blocks = VectorBlocks.of(frame(spark, x, parts))
        found.append(moments(blocks))
        blocks.close()
    assert all(np.array_equal(a, b) for f in found for a, b in zip(f, found[0]))
    np.testing.assert_allclose(found[0][0], x.mean(0), rtol=1e-12, atol=1e-12)
    np.testing.assert_allclose(found[0][1], np.cov(x.T, bias=True), rtol=1e-9, atol=1e-9)


def test_states_merge_in_a_tree(spark):
    blocks = VectorBlocks.of(frame(spark, [[i] for i in range(300)], 150))
    blocks.width = 150
    total = blocks.fold(
        lambda batches: {"n": sum(len(ids) for ids, _ in batches)}, lambda a, b: {"n": a["n"] + b["n"]}
    )
    one = blocks.fold(
        lambda batches: {"n": sum(len(ids) for ids, _ in batches)}, lambda a, b: {"n": a["n"] + b["n"]},
        state_bytes=1 << 30,
    )
    blocks.close()
    assert total == one == {"n": 300}


def test_hashed_texts(spark):
    df = spark.createDataFrame(
        [(1, "Blue sky"), (2, "blue SKY!"), (3, "of the"), (4, None), (5, "red rose")], "id long, text string"
    )
    got = {r.id: r.features for r in embed_hash(df, dim=32).collect()}
    assert got[1] == got[2] and got[1] != got[5]
    assert got[3] == got[4] == [0.0] * 32
    assert sum(x * x for x in got[1]) == pytest.approx(1)


def test_any_model_embeds_each_text_once_per_batch(spark):
    def load():
        def model(batch):
            assert len(set(batch)) == len(batch)
            return np.array([[len(t), 1.0] for t in batch])

        return model

    df = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}") for i in range(90)], "id long, text string")
    rows = embed_with(df.repartition(2), load, batch_size=4).collect()
    assert len(rows) == 90
    for r in rows:
        assert r.features == pytest.approx([len(r.text) / math.hypot(len(r.text), 1), 1 / math.hypot(len(r.text), 1)])


def brute_top(x, ids, k):
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size == 0, 1, size)[:, None]
    sim = np.round(unit @ unit.T, 6)
    out = set()
    for i, a in enumerate(ids):
        best = sorted((-sim[i, j] + 0.0, b) for j, b in enumerate(ids) if b != a)[:k]
        out |= {(a, r + 1, b, round(-s + 0.0, 6)) for r, (s, b) in enumerate(best)}
    return out


def similar_rows(spark, x, path, monkeypatch, k=3, ids=None, probes=None):
    """Results of one path: probes held, rows held, or cells."""
    if path == "cells":
        monkeypatch.setattr(similar, "_GROUP_VALUES", 40 * x.shape[1])
    ids = list(range(len(x))) if ids is None else ids
    data = [(i, [float(v) for v in r]) for i, r in zip(ids, x)]
    df = spark.createDataFrame(data, "id long, features array<double>").repartition(4)
    asked = df if probes is None else df.filter(F.col("id").isin(probes))
    if path == "rows held":
        found = similar._by_held_rows(similar._typed(asked), similar._typed(df), k, True)
        return {(r.probe_id, r.id, round(r.similarity, 6)) for r in found.collect()}
    held = 0 if path == "cells" else None
    found = similar.topk_similar(df, asked, k, held_values=held)
    return {(r.probe_id, r.rank, r.id, round(r.similarity, 6)) for r in found.collect()}


@pytest.mark.parametrize("path", ["probes held", "rows held", "cells"])
@pytest.mark.parametrize("shape", ["crowded", "clusters", "line"])
def test_most_similar_rows(spark, monkeypatch, path, shape):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 5))
    if shape == "crowded":
        x[40:90] = x[0]  # a third of the rows are copies
        x[[7, 8, 100, 101, 102]] = 0
    elif shape == "clusters":
        x = rng.normal(size=(6, 5))[rng.integers(0, 6, 150)] + 0.05 * x
    else:
        x = np.outer(rng.integers(-3, 4, 150), x[0])  # opposite directions, many ties and zeros
    want = brute_top(x, list(range(150)), 3)
    got = similar_rows(spark, x, path, monkeypatch)
    assert got == ({(a, c, s) for a, _, c, s in want} if path == "rows held" else want)


def test_cells_take_few_probes_few_rows_and_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(90, 4))
    some = {r for r in brute_top(x, list(range(90)), 3) if r[0] in (3, 50)}
    assert similar_rows(spark, x, "cells", monkeypatch, probes=[3, 50]) == some
    assert similar_rows(spark, x[:2], "cells", monkeypatch) == brute_top(x[:2], [0, 1], 3)
    assert similar_rows(spark, np.zeros((5, 4)), "cells", monkeypatch) == brute_top(np.zeros((5, 4)), range(5), 3)
    twice = np.vstack([x[:40], x[:40]])
    ids = list(range(40)) * 2
    assert similar_rows(spark, twice, "cells", monkeypatch, 2, ids) == similar_rows(spark, twice, "held", monkeypatch, 2, ids)


def test_copies_of_clustered_vectors_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(similar, "_GROUP_VALUES", 512 * 8)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4000, 8))
    copies = []
    for n in (2000, 8000):  # the number of clusters grows with the table
        x = centres[rng.integers(0, n // 20, n)] + 0.01 * rng.normal(size=(n, 8))
        df = frame(spark, x, 4)
        asks, rows, _ = similar.cell_plan(df, df, 8, n, 5, True)
        copies.append(asks.count() + rows.count())
    assert math.log(copies[1] / copies[0], 4) < 1.2


@pytest.mark.parametrize("shape", ["random", "clusters", "copies"])
def test_centroids_met_in_parts_give_the_same_answer(spark, monkeypatch, shape):
    monkeypatch.setattr(many_centroids, "GROUP_VALUES", 3 * 20)
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 3))
    if shape == "clusters":
        x = rng.normal(size=(9, 3))[rng.integers(0, 9, 300)] * 10 + 0.1 * x
    elif shape == "copies":
        x = np.round(x)  # very many equal centroids and equal distances
    cents = spark.createDataFrame([(int(c) * 2, v.tolist()) for c, v in enumerate(x)], "cluster int, centroid array<double>")
    rows = frame(spark, np.vstack([rng.normal(size=(60, 3)) * 4, x[:20], np.zeros((3, 3))]), 3)
    whole = vec.nearest_centroid(rows, cents).select("id", "cluster", "d2").orderBy("id").collect()
    parts = vec.nearest_centroid(rows.withColumn("kept", F.col("id") + 1), cents.repartition(4), tile_values=200)
    assert parts.columns == ["id", "features", "kept", "cluster", "d2"]
    got = parts.select("id", "cluster", "d2").orderBy("id").collect()
    assert [r[:2] for r in got] == [r[:2] for r in whole]
    assert [r.d2 for r in got] == pytest.approx([r.d2 for r in whole])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD" in plan  # the test's own; vectors are read once, not stored


def test_bounds_spare_most_of_the_centroids(spark, monkeypatch):
    monkeypatch.setattr(many_centroids, "GROUP_VALUES", 8 * 50)
    rng = np.random.default_rng(22)
    x = (rng.normal(size=(40, 8)) * 20)[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 8)) * 0.1
    cents = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(x)], "cluster int, centroid array<double>")
    names, groups = many_centroids._files(many_centroids._grouped(cents, 4000, 8, 1 << 12))
    search = many_centroids._Search(names, groups)
    rows = x[:500] + 0.01
    cluster, d2 = search(rows)
    assert search.compared < 0.3 * 500 * 4000 and len(names) > 3
    want = ((rows[:, None, :] - x[None, :, :]) ** 2).sum(2)
    assert (cluster == want.argmin(1)).all() and d2 == pytest.approx(want.min(1))


@pytest.mark.parametrize("wrong", [[[1.0, 2.0, 3.0], [1.0, 2.0, 3.0, 4.0, 5.0]], [[1.0] * 4, None]])
def test_ragged_and_missing_vectors_are_refused(spark, wrong):
    cents = spark.createDataFrame([(0, [0.0] * 4)], "cluster int, centroid array<double>")
    rows = spark.createDataFrame(list(enumerate(wrong)), "id long, features array<double>").coalesce(1)
    with pytest.raises(Exception, match="vectors must have 4 values"):
        vec.nearest_centroid(rows, cents).collect()


def test_scalars_are_bound_once_for_wide_vectors(spark):
    rows = frame(spark, np.ones((200, 1024)))
    for out in (vec.normalize_vectors(rows), vec.remove_component(rows, [1.0] + [0.0] * 1023)):
        start = time.perf_counter()
        assert out.count() == 200 and len(out.first().features) == 1024
        out.write.format("noop").mode("overwrite").save()
        assert time.perf_counter() - start < 20
