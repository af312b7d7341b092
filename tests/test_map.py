import csv
import io
import json
import math
from decimal import Decimal

import numpy as np
import pytest

from asterism.operators import export
from asterism.plans.semantic_map import FittedMap, build_map, clamp_k, line_items, map_documents
from asterism.session import durable
from asterism.sources.lines import read_documents
from asterism.sources.vectors import embed_with
from asterism.streaming.scoring import score_lines

# Four themes of five rows in five dimensions; rows of theme g lie near (g + 2) times axis g.
THEMES = {
    "kitchen": "oven whisk ladle skillet colander grater",
    "harbour": "anchor buoy rudder mast jetty tide",
    "weather": "drizzle thaw gust hail humid fog",
    "sewing": "thimble bobbin hem pleat zipper spool",
}
PER_THEME, DIM = 5, 5


def themed(seed=3):
    rng = np.random.default_rng(seed)
    vectors, texts = [], []
    for g, words in enumerate(THEMES.values()):
        for _ in range(PER_THEME):
            row = rng.normal(0, 0.05, DIM)
            row[g] += g + 2
            vectors.append(row.tolist())
            texts.append(" ".join(rng.choice(words.split(), size=3, replace=False)))
    return vectors, texts


VECTORS, TEXTS = themed()
N = len(TEXTS)


def expected_label(texts, others, top=3):
    """Best terms by count times ln(1 + N / df), equal ones by alphabet, counted plainly."""
    every = texts + others
    terms = {w for t in texts for w in t.split()}

    def score(w):
        return sum(w in t.split() for t in texts) * math.log(1 + len(every) / sum(w in t.split() for t in every))

    return " · ".join(sorted(terms, key=lambda w: (-round(score(w), 12), w))[:top])


def items(spark, vectors=VECTORS, texts=TEXTS, parts=1):
    rows = [(i, t, [float(x) for x in v]) for i, (v, t) in enumerate(zip(vectors, texts))]
    return spark.createDataFrame(rows, "id long, text string, features array<double>").repartition(parts)


@pytest.fixture(scope="module")
def built(spark):
    m = build_map(items(spark), k=len(THEMES))
    yield m
    m.close()


def rows_of(m):
    return m.points.orderBy("id").collect()


def check(m, n):
    points, clusters = rows_of(m), m.clusters.collect()
    assert len(points) == n and sum(c["size"] for c in clusters) == n
    assert {p.cluster for p in points} == {c.id for c in clusters}
    assert all(c["size"] > 0 and c.label for c in clusters)
    assert all(math.isfinite(v) and abs(v) <= 1.0001 for p in points for v in (p.x, p.y))
    return points, clusters


def test_points_clusters_and_labels_fit_together(built):
    points, clusters = check(built, N)
    assert built.k == len(THEMES) and [p.text for p in points] == TEXTS
    labels = {c.id: c.label for c in clusters}
    for g in range(len(THEMES)):
        part = slice(g * PER_THEME, (g + 1) * PER_THEME)
        assert len({p.cluster for p in points[part]}) == 1
        others = TEXTS[: part.start] + TEXTS[part.stop :]
        assert labels[points[part.start].cluster] == expected_label(TEXTS[part], others)
    assert [c.id for c in built.legend().collect()] == list(range(len(THEMES)))
    assert built.summary.first() == (len(THEMES), N, len(THEMES))


def test_no_rows_give_an_empty_map(spark):
    m = build_map(items(spark).limit(0))
    assert (m.k, m.points.count(), m.clusters.count()) == (0, 0, 0)
    assert m.reproject(1.0).points.count() == 0 and m.recluster(3).k == 0
    assert m.summary.first() == (0, 0, 0)


@pytest.mark.parametrize("dim,n,k", [(3, 7, 4), (6, 11, 2)])
def test_identical_rows_leave_no_empty_cluster(spark, dim, n, k):
    m = build_map(items(spark, [[0.25] * dim] * n, ["mend the fence"] * n), k=k).close()
    _, clusters = check(m, n)
    assert m.k == k and len(clusters) == 1 and clusters[0].label == "fence · mend"


def test_k_is_chosen_when_not_given(spark):
    m = build_map(items(spark)).close()
    check(m, N)
    assert 2 <= m.k <= 10
    assert build_map(items(spark, VECTORS[:1], TEXTS[:1])).close().k == 1


def test_clamp():
    assert [clamp_k(k, 7) for k in (-1, 0.4, 7.5, 1000, 4.5, 6.49)] == [1, 1, 7, 7, 5, 6]


def test_reproject_moves_points_only(built):
    before = rows_of(built)
    turned = built.reproject(0.77)
    after, clusters = check(turned, N)
    assert [p.cluster for p in after] == [p.cluster for p in before]
    assert sorted(clusters) == sorted(built.clusters.collect())
    assert any(abs(a.x - b.x) > 1e-6 for a, b in zip(after, before))
    assert rows_of(built) == before


def test_recluster_keeps_the_layout(built):
    other = built.recluster(2)
    check(other, N)
    assert other.k == 2
    assert [(p.x, p.y) for p in rows_of(other)] == [(p.x, p.y) for p in rows_of(built)]
    again = build_map(items(built.points.sparkSession), k=2).close()
    assert [p.cluster for p in rows_of(again)] == [p.cluster for p in rows_of(other)]


def test_same_map_for_every_partitioning(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 6))
    texts = [f"word{int(v[0] * 3)} other{int(v[1] * 3)}" for v in x]
    found = []
    for parts in (1, 3, 8):
        m = build_map(items(spark, x, texts, parts)).close()
        found.append((m.k, rows_of(m), sorted(m.clusters.collect())))
    assert found[0] == found[1] == found[2]


def planted_documents(spark):
    """Documents of themed lines with blank ones between, and one without text."""
    _, texts = themed(9)
    rows = [(10 * g + 7, "\n\n ".join(texts[g * PER_THEME : (g + 1) * PER_THEME])) for g in range(len(THEMES))]
    return spark.createDataFrame([*rows, (99, None)], "doc_id long, text string"), texts


def test_documents_become_a_map_and_new_lines_are_placed_on_it(spark, tmp_path):
    docs, texts = planted_documents(spark)
    with pytest.raises(ValueError):
        map_documents(docs.filter("doc_id = 99"))
    m = map_documents(docs, k=3)
    points, _ = check(m, len(texts))
    assert [p.text for p in points] == texts
    m.model.save(spark, str(tmp_path / "model"))
    model = FittedMap.load(spark, str(tmp_path / "model"))
    placed = [(p.text, p.x, p.y, p.cluster) for p in points]
    again = score_lines(docs, model).orderBy("doc_id", "pos").collect()
    assert [(r.text, r.x, r.y, r.cluster) for r in again] == placed
    docs.filter("doc_id < 50").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    query = (
        score_lines(stream, model).writeStream.format("memory").queryName("placed")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert [tuple(r)[2:] for r in spark.table("placed").orderBy("doc_id", "pos").collect()] == placed
    m.close()


def test_each_text_is_embedded_once(spark):
    docs, texts = planted_documents(spark)
    seen = spark.sparkContext.accumulator(0)

    def load():
        def model(batch):
            seen.add(len(batch))
            return np.array([[len(t), t.count("e"), t.count("a")] for t in batch], float)

        return model

    m = map_documents(docs, k=2, embed=lambda df: embed_with(df, load))
    m.legend().collect(), m.summary.collect(), m.points.collect()
    export.export_rows(m.reproject().points, m.clusters).collect()
    assert seen.value == len(set(texts)) or seen.value == len(texts)
    m.close()


def test_text_files_become_a_map(spark, tmp_path):
    _, texts = themed(4)
    for g in range(len(THEMES)):
        (tmp_path / f"file{g}.txt").write_text("\n".join(texts[g * PER_THEME : (g + 1) * PER_THEME]) + "\n")
    m = map_documents(read_documents(spark, str(tmp_path)), k=2).close()
    assert [p.text for p in rows_of(m)] == texts


@pytest.mark.parametrize("ids", [[5, 9, 5], [None, 3, None], [-(2**62), 0, 2**62], [1, 1 + 2**38, 2**62 + 1]])
def test_line_ids_never_collide(spark, ids):
    docs = spark.createDataFrame([(d, f"one{i}\ntwo{i}\nthree{i}") for i, d in enumerate(ids)], "doc_id long, text string")
    got = line_items(docs).orderBy("id").collect()
    assert len({r.id for r in got}) == 9 and {r.text for r in got} == {f"{w}{i}" for w in ("one", "two", "three") for i in range(3)}


def test_durable_frames_live_in_the_shared_folder(spark):
    df = durable(spark.range(5))
    assert df.count() == 5 and spark.sparkContext.getCheckpointDir()


# ---- exports -------------------------------------------------------------------------------------


def exported(spark, points, clusters):
    p = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(points)], "id long, text string, x double, y double, cluster int"
    )
    return p, spark.createDataFrame(clusters, "id int, label string, size long")


def sample(seed=31, n=12):
    """Generated points and clusters; texts and labels with signs that matter to CSV and JSON."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("bcdf")) + rng.choice(list("aou")) for _ in range(rng.integers(1, 4)))
    glue = [" ", "; ", ", ", ' "', "\n", "\r\n", " · ", "\\", "\t"]
    text = lambda k: "".join(word() + str(rng.choice(glue)) for _ in range(k)) + word()
    points = [(text(3), *map(float, rng.uniform(-1, 1, 2)), int(rng.integers(2, 6))) for _ in range(n)]
    return points, [(c, text(1), sum(p[3] == c for p in points)) for c in (5, 2, 3)]


SAMPLE = sample()


def plain_row(point, clusters):
    line, x, y, cluster = point
    label = {c: text for c, text, _ in clusters}.get(cluster, "")
    return line, cluster, label, *(math.floor(v * 1e4 + 0.5) / 1e4 for v in (x, y))


def test_rows_carry_labels_and_rounded_coordinates(spark):
    rows = export.export_rows(*exported(spark, *SAMPLE), keep=("id",)).orderBy("id").collect()
    assert [r[1:] for r in rows] == [plain_row(p, SAMPLE[1]) for p in SAMPLE[0]]
    assert export.export_rows(*exported(spark, [], [])).count() == 0


def records(spark, encode, sample=SAMPLE):
    rows = export.export_rows(*exported(spark, *sample), keep=("id",))
    return [r.record for r in encode(rows, ("id",)).orderBy("id").collect()]


def test_csv_records(spark):
    assert export.csv_header() == "line,cluster,label,x,y"
    number = lambda v: format(Decimal(repr(v)).quantize(Decimal("0.0001")), "f").rstrip("0").rstrip(".")
    want = []
    for line, cluster, label, x, y in (plain_row(p, SAMPLE[1]) for p in SAMPLE[0]):
        out = io.StringIO()
        csv.writer(out, lineterminator="").writerow([line, cluster, label, number(x), number(y)])
        want.append(out.getvalue())
    assert records(spark, export.export_csv) == want


def test_cells_that_a_spreadsheet_would_run_are_marked(spark):
    rng = np.random.default_rng(37)
    formulas = [sign + "".join(rng.choice(list("abc(1)+"), 5)) + "z" for sign in "=+-@" for _ in range(3)]
    numbers = [f"{rng.choice(['-', '+'])}{rng.integers(1, 99)}e{rng.integers(-9, 9)}" for _ in range(4)]
    points = [(text, 0.5, -0.25, 1) for text in formulas + numbers]
    got = records(spark, export.export_csv, (points, [(1, formulas[0], len(points))]))
    assert got == [f"'{t},1,'{formulas[0]},0.5,-0.25" for t in formulas] + [f"{t},1,'{formulas[0]},0.5,-0.25" for t in numbers]


def test_random_csv_parses_back_to_five_fields(spark):
    rng = np.random.default_rng(1)
    alphabet = list("ab,\"\n\r\t=+-@ '0é\\")
    points = [
        ("".join(rng.choice(alphabet, size=rng.integers(0, 12))), *map(float, rng.uniform(-1e6, 1e6, 2)), int(rng.integers(0, 5)))
        for _ in range(200)
    ]
    out = records(spark, export.export_csv, (points, [(c, f"c{c}", 1) for c in range(5)]))
    for record, point in zip(out, points):
        (fields,) = list(csv.reader(io.StringIO(record, newline="")))
        assert len(fields) == 5 and fields[0].lstrip("'") == point[0].lstrip("'")


def document(spark, points, clusters, k):
    pieces = export.json_document(*exported(spark, points, clusters), k).orderBy("part", "id").collect()
    return json.loads("".join(r.record for r in pieces))


def test_json_records_and_document(spark):
    got = [json.loads(r) for r in records(spark, export.export_json)]
    names = ("line", "cluster", "label", "x", "y")
    assert got == [dict(zip(names, plain_row(p, SAMPLE[1]))) for p in SAMPLE[0]]
    whole = document(spark, *SAMPLE, 6)
    assert whole["k"] == 6 and whole["points"] == got
    assert whole["clusters"] == [{"id": i, "label": t, "size": n} for i, t, n in sorted(SAMPLE[1])]
    assert document(spark, [], [], 0) == {"k": 0, "clusters": [], "points": []}


def test_written_files(spark, tmp_path):
    points, clusters = exported(spark, *SAMPLE)
    export.write_csv(points, clusters, str(tmp_path / "csv"))
    text = "".join(sorted(p.read_bytes().decode() for p in (tmp_path / "csv" / "records").glob("part-*")))
    back = [tuple(r) for r in csv.reader(io.StringIO(text, newline=""))]
    assert sorted(r[0] for r in back) == sorted(p[0] for p in SAMPLE[0])
    (header,) = (tmp_path / "csv" / "header").glob("part-*")
    assert header.read_bytes() == b"line,cluster,label,x,y\r\n"
    export.write_json(points, clusters, 2, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "points")).count() == len(SAMPLE[0])
    assert spark.read.json(str(tmp_path / "json" / "summary")).first().k == 2
