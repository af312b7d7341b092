"""The n-gram join and the suffix-array dedup against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from asterism.llm import ngram_join, suffix_dedup
from asterism.llm.components import components
from asterism.llm.hashing import RangeHash
from asterism.llm.marks import only_marked


def shingles(text, n=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain_groups(texts, ids):
    sets = [shingles(t) for t in texts]
    group = list(range(len(ids)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    members = defaultdict(list)
    for i in range(len(ids)):
        members[top(i)].append(ids[i])
    return {ids[i]: (ids[i], len(sets[i]), min(members[top(i)])) for i in range(len(ids))}


def varied(text, rng, share):
    return " ".join(w if rng.random() > share else w[::-1] + "x" for w in text.split(" "))


def test_groups_equal_all_pairs(frame, prose):
    rng = random.Random(1)
    passage = prose(60, 99)
    bases = [prose(rng.randint(3, 120), i) for i in range(25)]
    texts = list(bases)
    for b in bases:
        texts += [varied(b, rng, s) for s in (0.004, 0.02, 0.04)]
    texts += [prose(40, 50 + i) + " " + passage for i in range(12)] + bases[:5] + [None, "", " \t\n", "one two", "ONE  two", "One two three four five"]
    chain = prose(150, 7).split(" ")
    texts += [" ".join(chain[i : i + 110]) for i in range(0, 40, 8)]
    ids = random.Random(3).sample(range(-500, 5000), len(texts))
    got = {r.doc_id: tuple(r) for r in ngram_join.near_groups(frame(texts, ids)).collect()}
    assert got == plain_groups(texts, ids)


def test_repeated_rows_missing_ids_and_no_rows(frame, prose):
    text = prose(50, 4)
    got = ngram_join.near_groups(frame([text, text, text, None], [5, 5, 9, None])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id) == [(5, 5), (5, 5), (9, 5)]
    assert len(got) == 4
    assert ngram_join.near_groups(frame([])).count() == 0
    assert {r.doc_id for r in ngram_join.keep_one_of_each(frame([text, text, "other words"], [3, 4, 6])).collect()} == {3, 6}


def test_one_row_of_each_group_with_missing_and_repeated_ids(frame, prose):
    one, two, three = (prose(50, i) for i in (4, 5, 6))
    rows = [(one, 5), (one, 5), (one + " end", 5), (one, None), (two, None), (two, None), (three, 7), ("", None), (None, None), ("", 9)]
    got = ngram_join.keep_one_of_each(frame([t for t, _ in rows], [i for _, i in rows])).collect()
    kept = sorted((str(r.doc_id), (r.text or "")[:20]) for r in got)
    assert kept == sorted([("5", one[:20]), ("None", two[:20]), ("7", three[:20]), ("None", ""), ("None", ""), ("9", "")])


@pytest.mark.parametrize("block,hot", [(8192, 1 << 18), (4, 1 << 18), (8192, 2), (5, 0)])
def test_links_equal_all_pairs(frame, prose, monkeypatch, block, hot):
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", block)
    monkeypatch.setattr(ngram_join, "HOT_LIST", hot)  # lists dealt out by class as well
    rng = random.Random(9)
    texts = [varied(prose(90, 1), rng, s) for s in [0.01] * 12] + [prose(30, 2)] * 3 + [None, "", prose(40, 3)]
    chain = prose(150, 7).split(" ")
    texts += [" ".join(chain[i : i + 110]) for i in range(0, 40, 8)] + texts[:2]
    sets = [shingles(t) for t in texts]
    want = {
        i: sum(1 for j, b in enumerate(sets) if i != j and a and 100 * len(a & b) >= 75 * len(a | b)) for i, a in enumerate(sets)
    }
    found = ngram_join.near_links(frame(texts)).collect()
    groups = plain_groups(texts, list(range(len(texts))))
    assert {r.doc_id: r.n_links for r in found} == want and max(want.values()) > 5
    assert {r.doc_id: tuple(r)[:3] for r in found} == groups
    assert {r.doc_id: r.class_id for r in found} == {i: sets.index(s) if s else i for i, s in enumerate(sets)}


@pytest.mark.parametrize("dense", [16, 10**9, 1])
@pytest.mark.parametrize("seed", range(4))
def test_divide_skip_finds_every_set_that_reaches_the_threshold(seed, dense, monkeypatch):
    monkeypatch.setattr(ngram_join, "DENSE", dense)  # all lists as bitmaps, or few
    rng = np.random.default_rng(seed)
    base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(300) < p, rng.integers(0, 10_000, 300).astype(np.uint64), base)) for p in rng.uniform(0, 0.5, 80)]
    sets += [np.unique(rng.integers(0, 10_000, n).astype(np.uint64)) for n in (1, 1, 2, 300)] + [sets[0], sets[1][:250], np.zeros(1, np.uint64)]
    lists = ngram_join.InvertedLists(sets)
    for at, query in enumerate(sets):
        alike = [i for i, s in enumerate(sets) if 4 * len(np.intersect1d(s, query)) >= 3 * len(np.union1d(s, query))]
        assert lists.search(at).tolist() == [i for i in alike if i != at]


def test_links_of_rows_with_missing_and_repeated_ids(frame, prose):
    rng = random.Random(12)
    base, other = prose(120, 1), prose(80, 2)
    rows = [(varied(base, rng, 0.01), None) for _ in range(3)] + [(varied(base, rng, 0.01), 4), (base, 4), (base, 4), (base, 9)]
    rows += [(other, 4), (other + " more", None), (prose(70, 3), None), ("", None), (None, 4), ("a b", 11), ("A  B", 10), ("a b c", 11)]
    texts, ids = zip(*rows)
    sets = [shingles(t) for t in texts]
    links = [sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    groups = plain_groups(texts, range(len(texts)))
    want = []
    for i, own in enumerate(ids):
        known = [ids[j] for j in range(len(ids)) if groups[j][2] == groups[i][2] and ids[j] is not None]
        want.append((own, len(sets[i]), min(known) if known else None, links[i]))
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.near_links(frame(texts, ids)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_line_in_all_texts_opens_no_class(spark, prose, monkeypatch):
    """A long passage that all texts share stays out of the prefixes, so texts are settled at once."""
    seen = []
    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: seen.append(stored(df)) or seen[-1])
    line = prose(40, 1)
    rows = [(i, f"{prose(60, 100 + i)}\n{line}") for i in range(400)] + [(900, prose(60, 100) + " " + line + " x")]
    got = ngram_join.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got if r.n_links} == {0: 1, 900: 1}
    (open_classes,) = [df for df in seen if df.columns == ["id", "n", "key", "docs"]]
    assert open_classes.count() < 20


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(5001, 5100)]
    want = {}
    for a, b in pairs:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            joined = want[a] | want[b]
            want.update(dict.fromkeys(joined, joined))
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: min(s) for i, s in want.items() if len(s) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- suffixes ------------------------------------------------------------------------------------


def plain_removed(texts, length):
    raws = [(t or "").encode() for t in texts]
    places = defaultdict(list)
    for i, raw in enumerate(raws):
        for p in range(len(raw) - length + 1):
            places[raw[p : p + length]].append((i, p))
    marks = [bytearray(len(r)) for r in raws]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                marks[i][p : p + length] = b"\1" * length
    out = []
    for raw, mark in zip(raws, marks):
        kept = bytes(x for x, m in zip(raw, mark) if not m)
        runs = sum(1 for j, m in enumerate(mark) if m and (j == 0 or not mark[j - 1]))
        out.append((len(raw), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [b"a", b"ab", b"abc"])
def test_two_stage_order(letters):
    rng = random.Random(len(letters))
    for length in (8, 16):
        for _ in range(15):
            n = rng.randint(1, 200)
            data = np.array([rng.choice(letters) for _ in range(n)] + [0] * length, np.uint8)
            name = RangeHash(data)(np.arange(n), np.arange(n) + length)
            order = suffix_dedup.suffix_order(data, name, length)
            keys = [data.tobytes()[i : i + length] for i in order]
            assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)


def test_repeats_equal_brute_force(frame, prose):
    rng = random.Random(2)
    passages = [prose(60, 20 + i) for i in range(5)]
    texts = [prose(rng.randint(0, 60), i) + passages[i % 5][rng.randint(0, 60) :] + prose(rng.randint(0, 40), 100 + i) for i in range(40)]
    texts += ["a" * 900, "ab" * 300, None, "", prose(5, 77), texts[3], texts[3], texts[7][:260], "日本" * 100 + texts[9][50:300]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.drop_repeats(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removed(texts, suffix_dedup.LENGTH)


def test_repeated_rows_and_no_rows(frame, prose):
    got = suffix_dedup.drop_repeats(frame([prose(90, 1)] * 2 + ["short"], [4, 4, None])).collect()
    assert sorted((r.n_bytes, r.n_bytes - r.n_removed) for r in got)[0] == (5, 5) and len(got) == 3
    assert all(r.n_removed == r.n_bytes for r in got if r.doc_id == 4)
    assert suffix_dedup.drop_repeats(frame([])).count() == 0


def test_rows_without_ids_or_with_one_id_are_documents_of_their_own(frame, prose):
    passage = prose(70, 1)  # above 200 bytes
    rows = [
        (passage, None), (passage, 2), (prose(60, 3) + passage, 2), (prose(50, 4), 2), (prose(80, 5), None), (prose(80, 5), None),
        (prose(40, 6) * 2, None), ("", None), (None, 2), (prose(80, 7), 9), (prose(80, 7), 9),
    ]
    texts, ids = zip(*rows)
    want = sorted(map(str, ((i, *w) for i, w in zip(ids, plain_removed(texts, 200)))))
    got = suffix_dedup.drop_repeats(frame(texts, ids)).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
    assert all(r.n_removed <= r.n_bytes for r in got)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij"])
def test_anchors_in_parts_are_those_of_the_whole_text(letters):
    rng = random.Random(len(letters))
    for n in (0, 199, 200, 700, 1000, 5000):
        data = np.frombuffer("".join(rng.choice(letters) for _ in range(n)).encode(), np.uint8)
        whole = suffix_dedup.anchors(data, np.array([0, n]))
        for part in (100, 250, 1000):
            found = list(suffix_dedup.anchors_in_parts(data, suffix_dedup.LENGTH, part))
            for name, values in whole.items():
                assert np.concatenate([f[name] for f in found] + [np.zeros(0, np.int64)]).tolist() == values.tolist()


def test_a_text_above_16_mb(frame, prose):
    rng = np.random.default_rng(5)
    passage = prose(60, 3)[:300]
    text = rng.integers(97, 123, 17_500_000, np.uint8).tobytes().decode()
    got = suffix_dedup.drop_repeats(frame([text[:17_000_000] + passage + text[17_000_000:], "Q" + passage + "Q"]))
    size = len(passage.encode())
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in got.drop("kept").collect()) == [
        (size + 2, size, 1), (17_500_000 + size, size, 1),
    ]


def test_a_crowded_gram_is_spread_and_equals_brute_force(frame, prose, monkeypatch):
    rng = random.Random(4)
    passage = prose(120, 31)
    texts = []
    for size in (60, 120, 170, 199, 230, 420):  # shared by many, with other text around it or alike on one side only
        for i in range(14):
            before = prose(20, 1000 + size + i) if i % 3 else prose(20, 7)
            texts.append(before + passage[:size] + (prose(20, 5000 + size + i) if i % 4 else prose(20, 8)[rng.randint(0, 9) :]))
    texts += ["x" + " " * n + "y" * i for i, n in enumerate((150, 199, 210, 260))]
    sizes = []
    monkeypatch.setattr(suffix_dedup, "_spread", lambda *a, f=suffix_dedup._spread: sizes.append(f(*a)) or sizes[-1])
    docs = frame(texts)
    spans = {}
    for crowd in (2, 5):
        rows = suffix_dedup.repeated_spans(docs.select("doc_id", "text"), crowd=crowd).collect()
        spans[crowd] = {(r.doc_id, p) for r in rows for p in range(r.start, r.end)}
        _, dealt, total = sizes[-1]
        groups = [r["count"] for d in dealt for r in d.groupBy("gram").count().collect()]
        assert groups and max(groups) <= crowd and sum(groups) == total
    want = set()
    places = defaultdict(list)
    for i, text in enumerate(texts):
        raw = text.encode()
        for p in range(len(raw) - suffix_dedup.LENGTH + 1):
            places[raw[p : p + suffix_dedup.LENGTH]].append((i, p))
    for found in places.values():
        if len(found) > 1:
            want |= {(i, q) for i, p in found for q in range(p, p + suffix_dedup.LENGTH)}
    assert spans[2] == spans[5] == want and want


def test_marks_keep_every_wanted_row_and_send_no_texts_to_python(frame):
    rows = frame(["text " * 50] * 20 + [None, "", "none"], [*range(22), None])
    wanted = frame(["x"] * 4, [3, 7, 21, None])
    kept, others = (only_marked(rows, "doc_id", wanted, marked=m) for m in (True, False))
    assert {3, 7, 21, None} <= {r.doc_id for r in kept.collect()}
    assert sorted(map(str, kept.union(others).collect())) == sorted(map(str, rows.collect()))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    sent = [line.split("passes(")[1].split("[pythonUDF")[0] for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert "MapInArrow" not in plan and sent and not any("text" in s for s in sent)


def test_anchors_of_a_part_take_little_memory():
    data = np.random.default_rng(1).integers(97, 123, suffix_dedup.PART_BYTES, np.uint8)
    offsets = np.arange(0, len(data) + 1, 2048)
    suffix_dedup.anchors(data, offsets)  # powers are kept
    tracemalloc.start()
    try:
        suffix_dedup.anchors(data, offsets)
        assert tracemalloc.get_traced_memory()[1] < 40 << 20
    finally:
        tracemalloc.stop()
