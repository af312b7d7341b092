"""Tokens, packing, quality, top-k search and the pipeline against libraries and brute force."""

import itertools
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from asterism.llm import packing, piece_tokens, quality, queries, topk_join
from asterism.llm.words import WordIds, space_words

public_tokenizers = pytest.importorskip("public_tokenizers")

ALPHABET = "ab  \n\t▁éßx0.,'_-=日本😀\x00\xa0　\r the"


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# ---- tokens --------------------------------------------------------------------------------------


def test_words_of_a_text_join_to_the_text():
    texts = [*odd_texts(300, 1), "", None, " ", "\n\nß"]
    codes, words, counts = space_words(pa.array(texts))
    at = iter(codes.tolist())
    assert ["".join(words[next(at)] for _ in range(n)) for n in counts] == [t or "" for t in texts]


def test_pieces_equal_the_library(frame):
    import sentencepiece

    path = public_tokenizers.path(queries.PIECE_VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(600, 2) + [" " * n for n in range(40)] + ["a" * n for n in range(40)] + ["ab" * 2000, "日本語" * 700, "", None, "the cat " * 900]
    got = {r.doc_id: r for r in piece_tokens.encode_pieces(frame(texts), path).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == model.decode(ids)
    assert piece_tokens.encode_pieces(frame([]), path).count() == 0


def test_any_ids_decode_like_the_library():
    import sentencepiece

    path = public_tokenizers.path(queries.PIECE_VOCABULARY)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_tokens.PieceModel(path)
    rng = random.Random(5)
    lists = [[rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))] for _ in range(300)]
    offsets = np.cumsum([0, *map(len, lists)])
    assert own.decode(np.array(list(itertools.chain(*lists))), offsets) == [library.decode(x) for x in lists]


def test_byte_level_ids_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    special = packing.special_tokens(public_tokenizers.path(queries.BYTE_TOKENIZER))
    (mark,) = special
    rng = random.Random(8)
    mixed = ["".join(rng.choice([mark, mark[:-1], " ", "\n", "a", "é", "ab. ", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    texts = odd_texts(1500, 3) + mixed + [mark, mark * 3, f"{mark} a", " ", "a " * 2000]
    coder = WordIds(packing.word_encoder(public_tokenizers.path(queries.BYTE_VOCABULARY), special), most=500)
    for part in itertools.batched(texts, 300):
        ids, offsets = coder(pa.array(part))
        want = [e.ids for e in library.encode_batch(list(part), add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(offsets)] == want


# ---- packing -------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_a_plan_uses_every_piece_once_and_fits(seed):
    rng = np.random.default_rng(seed)
    size = [16, 40, 100, 1024, 1024][seed]
    lengths = np.clip(rng.lognormal(np.log(size) - 1, 0.8, 500).astype(int), 1, size)
    counts = Counter(lengths.tolist())
    plan = packing.plan_packing(dict(counts), size)
    used = Counter()
    for combination, times in plan:
        assert sum(combination) <= size and times > 0
        for x in combination:
            used[x] += times
    assert used == counts
    least = max(-(-int(lengths.sum()) // size), int((lengths > size // 2).sum()))
    assert sum(t for _, t in plan) <= least * 1.03 + 1
    assert packing.plan_packing({}, size) == []


def test_exact_fillings_are_found_first():
    assert packing.plan_packing({6: 2, 4: 1, 3: 1, 1: 1}, 10) == [((6, 4), 1), ((6, 3, 1), 1)]
    assert packing.plan_packing({5: 4}, 10) == [((5, 5), 2)]


def test_pieces_and_places(frame, prose):
    from tokenizers import Tokenizer

    texts = [prose(n, n) for n in (1, 5, 30, 200, 900, 5, 5, 5)] + ["", None]
    ids = [*range(6), 5, 5, 8, 9]
    size = 64
    rows = packing.pack_documents(frame(texts, ids), public_tokenizers.path(queries.BYTE_VOCABULARY), size, with_ids=True).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in zip(ids, texts):
        tokens = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        first = len(tokens) % size or size
        cuts = [0, *range(first, len(tokens) + 1, size)]
        for p, (a, b) in enumerate(itertools.pairwise(cuts)):
            crc = zlib.crc32(np.array(tokens[a:b], "<u4").tobytes())
            want.append((i, p, a, b - a, crc, tuple(tokens[a:b])))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == sorted(want)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        end = 0
        for r in group:
            assert r.offset == end
            end += r.length
        assert end <= size
    assert packing.pack_documents(frame([]), public_tokenizers.path(queries.BYTE_VOCABULARY)).count() == 0


# ---- quality -------------------------------------------------------------------------------------


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_single_tables_and_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (6000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # no single feature tells anything
    model = quality.QualityModel(x[:4000], y[:4000])
    assert auc(y[4000:], model.score(x[4000:])) > 0.97 and (1, 0) in {(i, j) for i, j, _ in model.pairs}
    step = (x[:, 2] > 0.3).astype(float)
    assert auc(step[4000:], quality.QualityModel(x[:4000], step[:4000]).score(x[4000:])) > 0.99


def test_features_do_not_depend_on_the_batch():
    texts = [*odd_texts(50, 4), "", None, "A B\nA B\nA B"]
    whole = quality.features(pa.array(texts))
    assert np.allclose(whole, np.vstack([quality.features(pa.array([t], pa.string())) for t in texts]))
    assert whole.shape[1] == len(quality.FEATURES) and not whole[50].any()


def plain_features(text):
    """The numbers of one text, counted one character at a time."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n = len(raw)
    groups = [set(chars.encode()) for chars in quality._GROUPS]
    group = [len(groups) if b >= 128 else next((i for i, g in enumerate(groups) if b in g), -1) for b in raw]
    share = [sum(g == i for g in group) / n for i in range(len(groups) + 1)]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(raw).values())
    codes, words, _ = space_words(pa.array([text]))
    words = [words[c] for c in codes]
    pairs = list(zip(words, words[1:]))
    lines = text.split("\n")
    symbol, space, feed, upper = 7, 3, 4, 1
    after = sum(b == symbol and a not in (symbol, space) for a, b in zip(group, group[1:]))
    capital = sum(b == upper and a in (space, feed) for a, b in zip(group, group[1:]))
    letters = sum(g in (0, 1) for g in group)
    return [
        math.log1p(n), *share, share[1] / max(letters, 1) * n, entropy, n / len(words), len(set(words)) / len(words),
        len(set(pairs)) / max(len(pairs), 1), len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        after / len(words), capital / len(words),
    ]


def test_features_equal_plain_counting(prose):
    texts = [*odd_texts(80, 6), "", None, "A B\nA B", "x#y #z $$", "\n\n", *(prose(n, n) for n in (1, 9, 300))]
    texts += ["".join(random.Random(i).choice("aB3 \n.,!?#|é日\t") for _ in range(200)) for i in range(20)]
    assert np.allclose(quality.features(pa.array(texts)), [plain_features(t) for t in texts], rtol=0, atol=1e-12)


def plain_tree(gradient, weight, leaves):
    """Values by bin of a tree that cuts, each time, where the gain over all parts is largest."""
    worth = lambda a, b: sum(gradient[a:b]) ** 2 / (sum(weight[a:b]) + quality.SHRINK)
    ends = [0, len(gradient)]
    while len(ends) <= leaves:
        gains = [
            (worth(a, c) + worth(c, b) - worth(a, b), c) for a, b in zip(ends, ends[1:]) for c in range(a + 1, b)
        ]
        if not gains or max(gains)[0] <= 1e-9:
            break
        ends = sorted([*ends, max(gains)[1]])
    return [
        sum(gradient[a:b]) / (sum(weight[a:b]) + quality.SHRINK) for a, b in zip(ends, ends[1:]) for _ in range(a, b)
    ]


def plain_cuts_of_square(cells, residual, weight, size):
    """(gain, value of each row) of the best cut of pair bins into four parts."""
    best = (-1.0, None)
    for i in range(1, size):
        for j in range(1, size):
            sums = [[0.0, 0.0] for _ in range(4)]
            part = [2 * (a >= i) + (b >= j) for a, b in cells]
            for q, r, w in zip(part, residual, weight):
                sums[q][0] += r
                sums[q][1] += w
            gain = sum(r * r / (w + quality.SHRINK) for r, w in sums) - sum(residual) ** 2 / (sum(weight) + quality.SHRINK)
            if gain > best[0]:
                best = (gain, [sums[q][0] / (sums[q][1] + quality.SHRINK) for q in part])
    return best


def test_the_model_equals_plain_boosting(monkeypatch):
    for name, value in {"ROUNDS": 5, "PAIR_ROUNDS": 3, "PAIRS": 2, "BINS": 8, "PAIR_BINS": 4}.items():
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=150) > 0).astype(float)
    n, n_features = x.shape
    cuts = [sorted({float(np.quantile(x[:, f], q / 8)) for q in range(1, 8)}) for f in range(n_features)]
    bins = [[sum(c <= v for c in cuts[f]) for v in x[:, f]] for f in range(n_features)]
    score = [math.log(y.mean() / (1 - y.mean()))] * n
    sigmoid = lambda s: [1 / (1 + math.exp(-v)) for v in s]
    for _ in range(5):
        for f in range(n_features):
            p = sigmoid(score)
            by_bin = [[i for i in range(n) if bins[f][i] == b] for b in range(len(cuts[f]) + 1)]
            value = plain_tree([sum(y[i] - p[i] for i in m) for m in by_bin], [sum(p[i] * (1 - p[i]) for i in m) for m in by_bin], quality.LEAVES)
            score = [s + quality.RATE * value[bins[f][i]] for i, s in enumerate(score)]
    coarse = [[b * 4 // (len(cuts[f]) + 1) for b in bins[f]] for f in range(n_features)]

    def step(i, j):
        p = sigmoid(score)
        return plain_cuts_of_square(list(zip(coarse[i], coarse[j])), [a - b for a, b in zip(y, p)], [v * (1 - v) for v in p], 4)

    chosen = sorted(((step(i, j)[0], i, j) for i in range(n_features) for j in range(i)), reverse=True)[:2]
    for _ in range(3):
        for _, i, j in chosen:
            score = [s + quality.RATE * v for s, v in zip(score, step(i, j)[1])]
    model = quality.QualityModel(x, y)
    assert [(i, j) for i, j, _ in model.pairs] == [(i, j) for _, i, j in chosen]
    assert np.allclose(model.score(x), sigmoid(score), rtol=0, atol=1e-9)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").select("held_out", "score", "quality", "predicted", "doc_id").toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    held = scored[scored.held_out]
    assert auc(held.quality.to_numpy(), held.score.to_numpy()) > 0.95
    assert ((scored.score >= quality.KEEP_FROM) == scored.predicted).all()


def test_without_labels_every_score_is_the_same(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score_quality(frame(["a", None, "", "long " * 4000]), labels).collect()
    assert {r.score for r in got} == {0.5} and len(got) == 4
    one_kind = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 1 for r in quality.score_quality(frame(["a", "b"]), one_kind).collect())
    assert quality.score_quality(frame([]), labels).count() == 0


# ---- top-k ---------------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long").repartition(4)


def plain_topk(rows, k):
    whole = {}
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = [int(np.floor(64 * float(np.float32(x)))) for x in v]
    out = set()
    for q in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[x])), x) for x in whole if x != q)
            out |= {(q, r + 1, x, -s) for r, (s, x) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("pivots,block", [(256, 16384), (24, 50), (3, 40)])
def test_topk_equals_all_pairs(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(0, 1, (6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 5)).tolist()) for i in range(260)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]  # many copies, so many ties
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 5), (2060, [float("inf")] * 5), (2080, [0.0] * 5)]
    frame = vectors(spark, [(i, v, 0, 3) for i, v in rows] + [(1, rows[1][1], 0, 3)])
    whole = topk_join.whole_vectors(frame)
    got = topk_join.topk_inner(whole, whole.filter("id % 20 = 0"), 7, pivots, block)
    assert {tuple(r) for r in got.collect()} == plain_topk(rows, 7)


def plain_scores(rows, k):
    """Exact scores of (id, whole vector) in Python integers; the reported ones fit in a long."""
    out = set()
    for q, v in rows:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), x) for x, w in rows if x != q)
            out |= {(q, r + 1, x, max(-(2**63), min(-s, 2**63 - 1))) for r, (s, x) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("size", [2**10, 2**28, 2**30, 2**40, 2**62])
def test_topk_is_exact_for_components_of_any_size(spark, size):
    rng = random.Random(size)
    rows = [(i, [size - rng.randrange(4) if i < 60 else rng.randrange(-size, size) for _ in range(6)]) for i in range(140)]
    rows += [(500, [-(2**63)] * 6), (501, [2**63 - 1] * 6)] if size == 2**62 else []
    df = spark.createDataFrame(rows, "id long, v array<bigint>").repartition(3)
    for pivots, block in ((256, 16384), (5, 30)):
        got = topk_join.topk_inner(df, df.filter("id % 20 = 0"), 5, pivots, block).collect()
        assert {tuple(r) for r in got} == plain_scores(rows, 5)


def test_queries_go_only_where_they_matter(spark, monkeypatch):
    rng = np.random.default_rng(3)
    copies = []
    stored = topk_join.stored
    monkeypatch.setattr(topk_join, "stored", lambda df: copies.append(stored(df)) or copies[-1])
    per_query = []
    for n in (1000, 4000):
        directions = rng.normal(size=(20, 16)) * 40
        rows = [(i, np.rint(directions[i % 20] * (1 + i % 7) + rng.normal(size=16)).astype(int).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, v array<bigint>").repartition(3)
        found = topk_join.topk_inner(df, df.filter("id % 20 = 0"), 5, 400, n // 16)
        assert found.count() == n // 20 * 5
        (bounded,) = [c for c in copies if "blocks" in c.columns][-1:]
        per_query.append(bounded.select(F.avg(F.size("blocks"))).first()[0])
    assert max(per_query) < 8, per_query  # of 16 blocks or more


def test_few_or_no_vectors(spark):
    whole = topk_join.whole_vectors(vectors(spark, [(20, [0.5], 0, 0), (21, [0.25], 0, 0)]))
    assert [tuple(r) for r in topk_join.topk_inner(whole, whole.filter("id = 20"), 20).collect()] == [(20, 1, 21, 32 * 16)]
    empty = topk_join.whole_vectors(vectors(spark, []))
    assert topk_join.topk_inner(empty, empty, 20).count() == 0


# ---- queries and pipeline ------------------------------------------------------------------------

TABLES = ("documents", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, tables, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got = queries.QUERIES[name](spark, tables)
    rel = con.sql(queries.ORACLE[name])
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


def test_every_operator_has_a_query(spark, tables):
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages_take_odd_tables(spark, tables, prose):
    """Nulls, repeated rows, a very long text, clashing names and no rows at all."""
    import corpus_pipeline

    names = ["kept_text", "n_lines", "n_dropped", "score", "held_out", "predicted", "document", "spans", "key", "picks", "row", "__row"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    line = "shared line of all"
    texts = [f"{prose(60, i)}\n{line}" for i in range(14)] + [None, "", "x", prose(30000, 5), prose(60, 3) + "\n" + line]
    ids = [*range(12), None, None, 3, 3, None, 99, 3]
    rows = [(i, t, None, "s", len(t or ""), *range(len(names))) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows + rows[-1:], schema)
    for name, stage in corpus_pipeline.STAGES[1:]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, tables)
            if name != "packing":
                assert out.columns == docs.columns
                found = out.collect()
                assert all(tuple(r)[5:] == tuple(range(len(names))) for r in found)
                if name != "near_copies":
                    assert len(found) == df.count()
            else:
                assert out.select("doc_id").count() >= df.count()
    kept = corpus_pipeline.STAGES[0][1](spark, docs, tables)
    assert kept.columns == docs.columns and corpus_pipeline.STAGES[0][1](spark, docs.limit(0), tables).count() == 0
    cleaned = corpus_pipeline.STAGES[1][1](spark, docs, tables).collect()
    assert not any(line in (r.text or "") for r in cleaned)
    single = corpus_pipeline.STAGES[2][1](spark, docs, tables)
    assert texts[3] == texts[-1] and single.filter(F.col("text") == texts[3]).count() == 1


def test_stored_tables_of_a_block_are_emptied_but_for_those_taken_off(spark):
    from asterism.llm.common import scratch, stored

    rows = lambda path: spark.read.parquet(path).count()
    with scratch(spark) as outer:
        kept = stored(spark.range(5))
        with scratch(spark) as inner:
            stored(stored(spark.range(7)))
        gone = list(inner)
        assert len(gone) == 2 and [rows(p) for p in gone] == [0, 0]
        path = outer.pop()
    assert kept.count() == rows(path) == 5
    with pytest.raises(ZeroDivisionError), scratch(spark) as failed:
        stored(spark.range(3))
        raise ZeroDivisionError
    assert rows(failed[0]) == 3
    assert stored(spark.range(2)).count() == 2  # outside of a block nothing is noted


def test_pipeline_stages_take_effect(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "secrets", "packing"]
    from asterism.llm.common import stored
    from asterism.llm.ngram_join import near_groups

    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, tables))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.filter(F.char_length("text") != F.col("n_chars")).count() == 0
    assert seen["quality"].count() < spark.read.parquet(f"{tables}/documents.parquet").count()
    groups = near_groups(seen["lines"])
    assert seen["near_copies"].count() == groups.select("component_id").distinct().count()
    pieces = corpus_pipeline.run(spark, tables)
    assert sorted(map(tuple, pieces.drop("ids", "sequence_id", "offset").collect())) == sorted(
        map(tuple, seen["packing"].drop("ids", "sequence_id", "offset").collect())
    )
