"""Text files in, one ordered file out, texts embedded once, rows without ids."""

import io
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asterism.constants import WHITESPACE
from asterism.operators import export, labels
from asterism.plans.semantic_map import build_map, map_documents, map_files
from asterism.sources.lines import file_lines
from asterism.sources.vectors import embed_distinct
from test_map import SAMPLE, check, exported, items, planted_documents, records, rows_of


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for key, value in zip(before, ("700", "1")):
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def odd_lines(seed, n):
    rng = random.Random(seed)
    pieces = ["", " ", "x", "é日", "word ", "\t", "\r", "\x0b", "long " * 90]
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_lines_of_files_cut_into_many_splits_are_numbered_in_order(spark, tmp_path, small_splits):
    want, at = [], 0
    for name, n in (("a.txt", 400), ("b.txt", 1), ("c.txt", 0), ("d e.txt", 150)):
        lines = odd_lines(len(name) + n, n)
        end = "" if n == 1 else "\r\n"
        (tmp_path / name).write_bytes("\r\n".join(lines).encode() + end.encode())
        kept = [t for t in (x.strip(WHITESPACE) for x in "\r\n".join(lines).split("\n")) if t]
        for pos, line in enumerate(kept):
            want.append((at, name, pos, line))
            at += 1
    found = file_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path), lineSep="\n").rdd.getNumPartitions() > 20
    got = [
        (r.id, r.path.rsplit("/", 1)[1].replace("%20", " "), r.pos, r.line) for r in found.orderBy("id").collect()
    ]
    assert got == want


def test_no_files_no_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("\n \n")
    assert file_lines(spark, str(tmp_path)).count() == 0
    with pytest.raises(ValueError):
        map_files(spark, str(tmp_path))


def test_the_map_of_files_is_the_map_of_their_lines(spark, tmp_path, small_splits):
    docs, texts = planted_documents(spark)
    for r in docs.collect():
        (tmp_path / f"{r.doc_id:04}.txt").write_text(r.text or "")
    m = map_files(spark, str(tmp_path), k=3).close()
    points, _ = check(m, len(texts))
    assert [p.text for p in points] == texts and [p.id for p in points] == list(range(len(texts)))
    with_ids = map_documents(docs, k=3).close()
    assert [p.text for p in rows_of(with_ids)] == texts


# ---- one text in ordered parts ---------------------------------------------------------------------


def joined(folder, manifest):
    """The parts joined by name, and each of them at the place the manifest gives."""
    files = sorted(folder.glob("parts/part-*"))
    whole = b"".join(f.read_bytes() for f in files)
    placed = bytearray(len(whole))
    for r in manifest.collect():
        raw = (folder / "parts" / r.file).read_bytes()
        assert len(raw) == r.bytes
        placed[r.offset : r.offset + r.bytes] = raw
    assert bytes(placed) == whole
    return whole.decode()


@pytest.mark.parametrize("n", [0, 1, 300])
def test_csv_parts_join_to_the_file(spark, tmp_path, n):
    points, clusters = exported(spark, SAMPLE[0] * 25 if n == 300 else SAMPLE[0][:n], SAMPLE[1])
    text = joined(tmp_path / "csv", export.write_csv_file(points.repartition(5), clusters, str(tmp_path / "csv")))
    sample = (SAMPLE[0] * 25 if n == 300 else SAMPLE[0][:n], SAMPLE[1])
    assert text == "".join(r + "\r\n" for r in [export.csv_header(), *records(spark, export.export_csv, sample)])


@pytest.mark.parametrize("n", [0, 2, 200])
def test_json_parts_join_to_the_document(spark, tmp_path, n):
    sample = (SAMPLE[0] * 20)[:n]
    points, clusters = exported(spark, sample, SAMPLE[1] if n else [])
    text = joined(tmp_path / "json", export.write_json_file(points.repartition(4), clusters, 4, str(tmp_path / "json")))
    pieces = export.json_document(points, clusters, 4).orderBy("part", "id").collect()
    assert text == "".join(r.record + "\n" for r in pieces)
    whole = json.load(io.StringIO(text))
    assert len(whole["points"]) == n and whole["k"] == 4


def test_a_document_needs_ids(spark):
    points, clusters = exported(spark, *SAMPLE)
    with pytest.raises(ValueError, match="points have none"):
        export.json_document(points.withColumn("id", F.nullif("id", F.lit(3))), clusters, 2)


# ---- distinct texts --------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [100_000, 20])
def test_each_different_text_is_embedded_once(spark, hot):
    rng = random.Random(3)
    words = [f"w{rng.randrange(40)}" for _ in range(60)]
    rows = [(i if i % 9 else None, rng.choice([None, "", "crowd", "crowd", "crowd", *words])) for i in range(600)]
    calls, loads = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)

        def model(batch):
            calls.add(len(batch))
            return np.array([[len(t), sum(map(ord, t)), 1.0] for t in batch])

        return model

    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "id long, text string, n int").repartition(6)
    got = sorted(embed_distinct(df, load, keep=("n",), batch_size=7, hot=hot).collect(), key=lambda r: r.n)
    assert calls.value == len({t or "" for _, t in rows}) and loads.value <= 8
    assert [(r.id, r.text) for r in got] == rows
    for r in got:
        v = np.array([len(r.text or ""), sum(map(ord, r.text or "")), 1.0])
        assert r.features == pytest.approx((v / np.linalg.norm(v)).tolist())
    assert embed_distinct(df.limit(0), load).count() == 0


# ---- terms that tie --------------------------------------------------------------------------------


def test_very_many_tied_terms(spark):
    n = 200_000
    df = spark.range(n, numPartitions=8).select(
        F.concat(F.lit("t"), F.conv(F.col("id") + 36**4, 10, 36)).alias("text"), F.floor(F.col("id") / n).cast("int").alias("cluster")
    )
    top = labels.top_terms(df, k=1, top_n=3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 3, Partial" in plan and "row_number(), 3, Final" in plan  # a task sends 3 terms
    first = sorted(r.text for r in df.limit(n).collect())[:3]
    assert [r.term for r in top.orderBy("rank").collect()] == [t.lower() for t in first]


# ---- rows without ids ------------------------------------------------------------------------------


def test_rows_without_ids_or_with_one_id_have_a_map(spark):
    some = items(spark).withColumn("id", F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, 7).otherwise(F.col("id")))
    found = []
    for parts in (1, 4):
        m = build_map(some.repartition(parts), k=4).close()
        points = m.points.collect()
        assert len(points) == some.count() and sum(c["size"] for c in m.clusters.collect()) == len(points)
        found.append(sorted((p.text, str(p.id), round(p.x, 9), p.cluster) for p in points))
    assert found[0] == found[1]
