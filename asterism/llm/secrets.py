"""Finds secrets in texts: fixed patterns, and strings whose characters look random.

Patterns give the base spans: assignments to secret names, access key ids and long hexadecimal
runs. For the rest, a window slides over every long run of key characters; the counts of its
characters change by one in and one out, and with them the window's Shannon entropy. Windows of a
class of characters (hexadecimal, letters and digits, base64) above the entropy of that class are
joined to spans, unless an allow-list rule says that the string is harmless or a base span has it already.

Defined cases: a null or empty text has no spans; spans count code points, the end is exclusive;
other columns are passed through by ``redact_secrets`` and ``keep``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

KINDS = ("assign", "access", "hex", "entropy")
MASK = "[secret]"

_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
_HEX = r"[0-9a-f]{32,}"
_RUN = r"[A-Za-z0-9+/_=-]{24,}"
# cheap tests over a whole batch; a text that passes none has no span of that kind
_MAYBE = {
    "assign": r"(?i)(passw|secret|token|api_?key)",
    "access": "AKIA",
    "hex": r"[0-9a-f]{32}",
    "entropy": r"[A-Za-z0-9+/_=-]{24}",
}

WINDOW = 24
# character class, least entropy of a window in bits, least number of different kinds of characters
CLASSES = (
    (frozenset("0123456789abcdefABCDEF"), 3.0, 2),
    (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.7, 2),
    (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.9, 3),
)
# harmless strings: UUIDs, dates and numbers, rulers
_ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[0-9+/_=-]+",
)
# slugs and paths: between separators there are plain words only; tested part by part, so in linear time
_SEPARATORS = r"[/_=+-]+"
_WORD = r"[A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,8}"


def _kind_of(char: str) -> int:
    return 0 if char.isdigit() else 1 if char.islower() else 2 if char.isupper() else 3


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Parts of one run of key characters in which some class has windows of high entropy."""
    if len(text) < window:
        return []
    part = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]  # one more, as a character enters before one leaves
    flagged = []
    for members, least, variety in CLASSES:
        counts: dict[str, int] = {}
        kinds = [0, 0, 0, 0]
        total, outside = 0.0, 0
        for end, char in enumerate(text):
            n = counts.get(char, 0)
            total += part[n + 1] - part[n]
            counts[char] = n + 1
            kinds[_kind_of(char)] += 1
            outside += char not in members
            if end >= window:
                old = text[end - window]
                n = counts[old]
                total += part[n - 1] - part[n]
                counts[old] = n - 1
                kinds[_kind_of(old)] -= 1
                outside -= old not in members
            if end >= window - 1 and not outside and sum(k > 0 for k in kinds) >= variety:
                if math.log2(window) - total / window >= least:
                    flagged.append((end - window + 1, end + 1))
    joined: list[tuple[int, int]] = []
    for start, end in sorted(flagged):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((start, end))
    return joined


def _finder():
    """Compiled once in each task: (text, which kinds may occur) -> spans by start, then kind."""
    assign = re.compile(_ASSIGN, re.IGNORECASE | re.ASCII)
    access, hexes, runs = re.compile(_ACCESS), re.compile(_HEX), re.compile(_RUN)
    listed = re.compile("|".join(f"(?:{p})" for p in _ALLOWED))
    separators, word = re.compile(_SEPARATORS), re.compile(_WORD)

    def allowed(run: str) -> bool:
        return bool(listed.fullmatch(run)) or all(word.fullmatch(p) for p in separators.split(run))

    def find(text: str, maybe: tuple[bool, bool, bool, bool]) -> list[tuple[int, int, int]]:
        found = []
        if maybe[0]:
            found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        if maybe[1]:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text) if len(m[0]) >= 16]
        if maybe[2]:
            found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        if maybe[3]:
            base = list(found)
            for m in runs.finditer(text):
                if allowed(m[0]):
                    continue
                for a, b in entropy_spans(m[0]):
                    a, b = a + m.start(), b + m.start()
                    if not any(s < b and a < e for s, _, e in base):
                        found.append((a, 3, b))
        return sorted(found)

    return find


_SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
]))


def _searched(batches: Iterator[pa.RecordBatch], column: str):
    """(part of a batch, its texts, spans of each text)."""
    find = _finder()
    for whole in batches:
        for batch in slices(whole, column):
            texts = pc.fill_null(batch.column(column), "")
            maybe = [pc.match_substring_regex(texts, p).to_pylist() for p in _MAYBE.values()]
            flags = list(zip(*maybe, strict=True))
            strings = texts.to_pylist()
            yield batch, strings, [find(t, f) if any(f) else [] for t, f in zip(strings, flags, strict=True)]


def find_secrets(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``spans`` (kind, start, end) by start, then kind; row by row, no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep]).add("spans", _SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, spans in _searched(batches, "__text"):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(rows, kind)], names=schema.names
            )

    return docs.select(*(docs[c] for c in keep), docs[text].alias("__text")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by the mask; other texts stay as they are."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, strings, spans in _searched(batches, text):
            clean = batch.column(text).to_pylist()
            for i, found in enumerate(spans):
                if found:
                    out, done = [], 0
                    for start, _, end in found:
                        if start >= done:
                            out += [strings[i][done:start], mask]
                        done = max(done, end)
                    clean[i] = "".join(out) + strings[i][done:]
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, schema)
