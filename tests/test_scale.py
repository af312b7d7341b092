"""Steps that must stay small on large tables, and the same results."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asterism.constants import WHITESPACE
from asterism.functions.text import trim_ws
from asterism.operators import export, many_centroids, similar, similar_pairs
from asterism.operators import vectors as vec
from asterism.sources import vectors as sources


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(parts)


@pytest.mark.parametrize("path", ["files", "copies"])
def test_two_large_sides_by_files_and_by_copies(spark, monkeypatch, path):
    monkeypatch.setattr(similar, "_GROUP_VALUES", 40 * 6)
    monkeypatch.setattr(similar, "_HANDED_VALUES", 1 << 31 if path == "files" else 0)
    x = np.random.default_rng(30).normal(size=(200, 6))
    x[50:80], x[[5, 6]] = x[3], 0
    df = frame(spark, x)
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size == 0, 1, size)[:, None]
    sim = np.round(unit @ unit.T, 6) + 0.0
    np.fill_diagonal(sim, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(200) for r, j in enumerate(np.lexsort((np.arange(200), -sim[i]))[:4])}
    assert {(r.probe_id, r["rank"], r.id) for r in similar.topk_similar(df, df, 4, held_values=0).collect()} == want


def test_no_copies_of_probes_for_the_cells_they_meet(spark, monkeypatch):
    monkeypatch.setattr(similar, "_GROUP_VALUES", 40 * 16)
    monkeypatch.setattr(similar, "cell_plan", lambda *a: pytest.fail("probes are copied to cells"))
    df = frame(spark, np.random.default_rng(31).normal(size=(300, 16)))
    assert similar.topk_similar(df, df, 5, held_values=0).count() == 1500


def crowded(shape, n=220):
    rng = np.random.default_rng(34)
    x = rng.normal(size=(n, 6))
    if shape == "clusters":
        x = rng.normal(size=(9, 6))[rng.integers(0, 9, n)] + 0.05 * x
    elif shape == "line":
        x = np.outer(rng.integers(-3, 4, n), x[0])  # opposite directions, many ties and zeros
    x[50:110], x[[5, 6]] = x[3], 0
    return x


@pytest.mark.parametrize(("shape", "k", "skip"), [("random", 1, True), ("clusters", 4, False), ("line", 4, True)])
def test_a_table_meets_itself_in_pairs_of_blocks(spark, monkeypatch, shape, k, skip):
    monkeypatch.setattr(similar, "_FEW_ROWS", 0)
    monkeypatch.setattr(similar, "_GROUP_VALUES", 50 * 6)
    monkeypatch.setattr(many_centroids, "GROUP_VALUES", 8 * 6)
    monkeypatch.setattr(similar, "_by_files", lambda *a: pytest.fail("every two rows are compared twice"))
    x = crowded(shape)
    df, n = frame(spark, x), len(x)
    size = np.linalg.norm(x, axis=1)
    unit = x / np.where(size == 0, 1, size)[:, None]
    sim = np.round(unit @ unit.T, 6) + 0.0
    if skip:
        np.fill_diagonal(sim, -np.inf)
    want = {(i, r + 1, int(j)) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), -sim[i]))[:k])}
    got = similar.topk_similar(df, df, k, skip_self=skip, held_values=0).collect()
    assert {(r.probe_id, r["rank"], r.id) for r in got} == want and len(got) == len(want)
    assert all(r.similarity == pytest.approx(sim[r.probe_id, r.id]) for r in got)


@pytest.mark.parametrize("twice", ["equal", "other", "zeros"])
def test_repeated_ids_find_the_same_in_pairs_of_blocks(spark, monkeypatch, twice):
    monkeypatch.setattr(similar, "_GROUP_VALUES", 50 * 6)
    x = np.zeros((4, 6)) if twice == "zeros" else crowded("random", 120)
    rows = [(i % 100, [float(v) for v in (x[i % 100] if twice == "equal" else r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame([*rows, *rows[:30]], "id long, features array<double>").repartition(3)
    found = []
    for few in (1 << 16, 0):
        monkeypatch.setattr(similar, "_FEW_ROWS", few)
        found.append(sorted(map(tuple, similar.topk_similar(df, df, 3, held_values=0).collect())))
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("blocks", [1, 2, 7, 8, 75])
def test_every_two_blocks_meet_once(blocks):
    every = [p for part in similar_pairs.rounds(blocks) for p in part]
    assert len(every) == blocks * (blocks + 1) // 2 == len({frozenset(p) for p in every})


def test_every_two_rows_are_compared_once_at_most(spark):
    x = np.random.default_rng(35).normal(size=(900, 12))
    unit = similar_pairs.unit_rows(x)
    vectors = frame(spark, unit).selectExpr("id cluster", "features centroid")
    names, _ = many_centroids._files(many_centroids._grouped(vectors, 900, 12, 300 * 12))
    sides = [similar_pairs._Side(name, 12, 5, None) for name in names]
    compared = sum(similar_pairs.meet_blocks(sides[a], sides[b]) for part in similar_pairs.rounds(len(names)) for a, b in part)
    assert len(names) > 2 and compared <= 900 * 899 // 2
    sim = np.round(unit @ unit.T, 6)
    np.fill_diagonal(sim, -np.inf)
    for side in sides:
        order = np.lexsort((side.best[2] * 0, -side.best[2], side.best[0]))
        got = side.best[1][order].reshape(-1, 5)
        assert (np.sort(sim[side.ids[:, None], got]) == np.sort(np.sort(sim[side.ids])[:, -5:])).all()


def test_very_many_centroids_lie_in_few_files(spark, monkeypatch):
    found = []
    monkeypatch.setattr(many_centroids, "_files", lambda g, f=many_centroids._files: found.append(f(g)) or found[-1])
    x = np.random.default_rng(32).normal(size=(3000, 4))
    cents = spark.createDataFrame([(c, v.tolist()) for c, v in enumerate(x)], "cluster int, centroid array<double>")
    got = vec.nearest_centroid(frame(spark, x[:50] + 0.001), cents, tile_values=40).select("id", "cluster").collect()
    assert len(found[0][0]) <= 2 * many_centroids.FILES
    assert all(r.cluster == ((x[r.id] + 0.001 - x) ** 2).sum(1).argmin() for r in got)


@pytest.mark.parametrize("size", [1e-200, 1e-60, 1.0, 1e60, 1e200])
def test_screened_centroids_tie_like_plain_ones(size):
    rng = np.random.default_rng(33)
    x, c = np.round(rng.normal(size=(400, 3))) * size, np.round(rng.normal(size=(300, 3))) * size
    if 1e-150 < size < 1e150:
        most = np.full(len(x), np.inf)
        reach = float(np.sqrt((x**2).sum(1).max()) + np.sqrt((c**2).sum(1).max()))
        rows, at, d = many_centroids._nearest_screened(x, c, most, reach)
        assert (rows == np.arange(len(x))).all() and (at == many_centroids.nearest(x, c)).all()
        assert d == pytest.approx(np.sqrt(((x - c[at]) ** 2).sum(1)))


def test_trimming_takes_one_look_at_the_ends_of_a_text(spark):
    texts = [WHITESPACE + "a b" + WHITESPACE, WHITESPACE, "", None, "x", "　é \n", "a \u0085"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", trim_ws(F.col("t")).alias("t"))
    want = [None if t is None else t.strip(WHITESPACE) for t in texts]
    assert [r.t for r in df.orderBy("id").collect()] == want
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_records_are_made_once_for_an_ordered_text(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def record(i):
        made.add(1)
        return f"r{i}"

    rows = spark.range(400, numPartitions=4).select("id", record.asNondeterministic()("id").alias("record"))
    export.write_ordered(rows, ["id"], str(tmp_path / "out"))
    assert made.value == 400
    assert [r.value for r in spark.read.text(str(tmp_path / "out/parts")).collect()] != []


def test_long_texts_are_hashed_in_parts(monkeypatch):
    codes = [list(range(64)) * 3, [], [5], [2, 66 % 64, 34], list(range(40))]
    whole = sources._hash_embedder(32).func(pa.array(codes, pa.list_(pa.int32()))).to_pylist()
    monkeypatch.setattr(sources, "_TERMS", 50)
    seen, count = [], np.bincount
    monkeypatch.setattr(sources.np, "bincount", lambda a, **k: seen.append(len(a)) or count(a, **k))
    assert sources._hash_embedder(32).func(pa.array(codes, pa.list_(pa.int32()))).to_pylist() == whole
    assert len(seen) == 2 and whole[1] == [0.0] * 32 and whole[2][5] == 1.0
