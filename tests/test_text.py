import math
import random
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from asterism.constants import STOPWORDS, WHITESPACE
from asterism.functions.csv import csv_cell
from asterism.functions.text import number_text, round4, tokenize, trim_ws
from asterism.sources import lines


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


def parsed(spark, *values, cap=None):
    rows = lines.cap_lines(texts(spark, *values), cap).orderBy("doc_id", "pos").collect()
    return [r.line for r in rows]


def test_lines_are_trimmed_and_blank_ones_dropped(spark):
    assert parsed(spark, "\t oak\n \n\n elm  \n\t\nash tree ") == ["oak", "elm", "ash tree"]
    assert parsed(spark, "up\r\n\r\ndown\r\n") == ["up", "down"]
    assert parsed(spark, "", "  \n\t\n ", None) == []


def test_unicode_blanks_are_trimmed_and_a_lone_return_does_not_split(spark):
    assert parsed(spark, " ﻿x y \n　", "p\rq") == ["x y", "p\rq"]


def test_positions_count_kept_lines(spark):
    rows = lines.parse_lines(texts(spark, "\n\na\n\nb")).orderBy("pos").collect()
    assert [(r.pos, r.line) for r in rows] == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("seed", range(5))
def test_cap_keeps_the_first_lines_and_reports_the_rest(spark, seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 90)
    cap = [0, n, rng.randrange(n), n + 7, n - 1][seed]
    docs = texts(spark, "\n".join(f" line {i} \n" for i in range(n)))
    got = lines.cap_lines(docs, cap).orderBy("pos").collect()
    assert [r.line for r in got] == [f"line {i}" for i in range(n)][:cap]
    stats = lines.line_stats(docs, cap).first()
    assert (stats.kept, stats.truncated) == (min(n, cap), max(n - cap, 0))


def test_cap_agrees_with_a_sort_over_scattered_documents(spark):
    rng = random.Random(5)
    docs = [(rng.randrange(-(10**12), 10**12), "\n".join(["w"] * rng.randrange(0, 9))) for _ in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    every = [(d, p) for d, t in sorted(docs) for p in range(len(t.split("\n")) if t else 0)]
    for cap in (1, 17, 400, len(every) - 1, len(every), len(every) + 5):
        got = sorted((r.doc_id, r.pos) for r in lines.cap_lines(df, cap).collect())
        assert got == every[:cap]


def test_too_few_lines_are_refused(spark):
    assert lines.line_stats(texts(spark, "a\nb")).first().enough is False
    with pytest.raises(ValueError):
        lines.require_lines(texts(spark, "a\nb"))
    assert lines.require_lines(texts(spark, "a\nb\nc")) == 3


def test_random_lines_never_exceed_the_cap_nor_stay_untrimmed(spark):
    rng = random.Random(11)
    alphabet = "ab'é7 " + WHITESPACE
    raw = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(8))) for _ in range(700)]
    docs = texts(spark, *["\n".join(raw[i : i + 70]) for i in range(0, 700, 70)])
    want = [s.strip(WHITESPACE) for s in "\n".join(raw).split("\n")]
    want = [s for s in want if s]
    assert [r.line for r in lines.parse_lines(docs).orderBy("doc_id", "pos").collect()] == want
    assert lines.cap_lines(docs, 50).count() == 50


def test_files_split_at_line_feeds_only(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" x \r\n\r\ny\rz\n\n")
    got = lines.read_lines(spark, str(tmp_path)).orderBy("path", "block_start", "seq").collect()
    assert [r.line for r in got] == ["x", "y\rz"]


def tokens(spark, text):
    return texts(spark, text).select(tokenize(F.col("text")).alias("t")).first().t


def plain_tokens(text):
    """Words of letters, numbers and apostrophes, told apart by Unicode category one character at a time."""
    kept = "".join(
        " " if c in WHITESPACE or not (c == "'" or unicodedata.category(c)[0] in "LN") else c for c in (text or "").lower()
    )
    return [
        t for t in kept.split(" ")
        if len(t.encode("utf-16-le")) > 4 and t not in STOPWORDS and not all(unicodedata.category(c)[0] == "N" for c in t)
    ]


CLASSES = {
    "small": "aenrt", "large": "AENRT", "accented": "\u00e9\u00f8\u0142\u00df\u0107", "far letters": "\u65e5\u0436\u05d0\U00020000\U00020001",
    "digits": "0123456789", "other numbers": "\u0664\u06f7\u00bd\u2167", "marks": "\u0301\u0327", "apostrophes": "''\u2019",
    "signs": "!;()#\u2026\u2014\u00a3", "pictures": "\u2602\U0001f600", "blanks": WHITESPACE,
}


def test_tokens_of_random_texts_of_all_character_classes(spark):
    rng = random.Random(17)
    names = list(CLASSES)
    cases = ["", None, " " * 5]
    for _ in range(900):
        some = rng.sample(names, rng.randint(1, 4)) + ["small"] * rng.randint(0, 3)
        words = ["".join(rng.choice(CLASSES[rng.choice(some)]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        words += rng.sample(STOPWORDS, rng.randint(0, 2))
        rng.shuffle(words)
        cases.append(rng.choice(" \t\u00a0").join(words))
    rows = texts(spark, *cases).select("doc_id", tokenize(F.col("text")).alias("t")).orderBy("doc_id").collect()
    for case, row in zip(cases, rows):
        assert row.t == plain_tokens(case), case


def is_number(text):
    """A finite decimal number, or whole number in base 2, 8 or 16, with blanks around it."""
    body = text.strip(WHITESPACE)
    base = {"0x": 16, "0o": 8, "0b": 2}.get(body[:2].lower())
    try:
        if base:
            return body[2:3].isalnum() and "_" not in body and int(body[2:], base) >= 0
        return set(body) <= set("0123456789+-.eE") and math.isfinite(float(body))
    except ValueError:
        return False


def plain_cell(text):
    text = text or ""
    if text[:1] in ("=", "+", "-", "@", "\t", "\r") and text and not is_number(text):
        text = "'" + text
    return '"' + text.replace('"', '""') + '"' if set(text) & set('",\r\n') else text


def test_csv_cells_of_random_texts(spark):
    rng = random.Random(23)
    alphabets = ["=+-@\t\r0129.eE", "0123456789xXobBfF\t+-", "ab\u00e9 \",\n'", "-+.5e97 d\u00a0", "=+-@\t\rInfinity"]
    cases = ["", None] + [
        rng.choice(["", "", "-", "+", "\t", "\t0x", "\r0b"]) + "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 6)))
        for _ in range(1500)
    ]
    cases += [f"{sign}{digits}e{power}" for sign in "+-" for digits in ("1", ".5", "9.") for power in (-400, 7, 308, 309)]
    rows = texts(spark, *cases).select("doc_id", csv_cell(F.col("text")).alias("c")).orderBy("doc_id").collect()
    for case, row in zip(cases, rows):
        assert row.c == plain_cell(case), repr(case)


def test_numbers_round_half_up_and_print_short(spark):
    rng = random.Random(29)
    values = [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 6) for _ in range(300)]
    values += [sign * (n + 0.5) / 1e4 for n in range(-3, 4) for sign in (1, -1)] + [float(n * 10**e) for n in (0, 3, -12) for e in range(4)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    rows = df.select("i", round4(F.col("v")).alias("r")).select("r", number_text(F.col("r")).alias("t"), "i")
    for v, r in zip(values, rows.orderBy("i").collect()):
        want = math.floor(v * 1e4 + 0.5) / 1e4
        assert r.r == want
        short = format(Decimal(repr(want)).quantize(Decimal("0.0001")), "f").rstrip("0").rstrip(".")
        assert r.t == ("0" if short in ("-0", "") else short)


def test_large_and_odd_numbers_stay_when_rounded(spark):
    values = [1e16, -3.5e15, float("inf"), float("-inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(round4(F.col("v"))).collect()]
    assert got[:4] == values[:4] and got[4] != got[4]


def test_cap_counts_lines_without_a_document_id(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (None, "d\ne\nf"), (1, "g\nh"), (2, "i\nj\nk")], "doc_id long, text string")
    for cap, want in ((4, 4), (6, 6), (8, 8), (10, 10), (20, 11)):
        got = lines.cap_lines(df, cap).collect()
        assert len(got) == want
        assert sum(r.doc_id is None for r in got) == min(cap, 6)


def test_long_digit_runs_take_linear_time(spark):
    assert tokens(spark, "7" * 200_000 + " end " + "8" * 200_000 + "x") == ["end", "8" * 200_000 + "x"]


def test_trim(spark):
    assert texts(spark, "  a b \x0b").select(trim_ws(F.col("text"))).first()[0] == "a b"
