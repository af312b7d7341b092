"""Packs token pieces of documents into as few sequences of a fixed length as it can.

How many pieces there are of each length is all a plan needs, and that is a table of at most
``size`` rows. The plan takes the longest piece and looks for single, pair and triple lengths that
fill the rest exactly, as often as there are pieces of all of them; what finds no exact filling is packed by best
fit, longest first. Pieces then get their places by their rank inside a length. Ranks come from counts of
small hashed groups, so a length shared by most pieces is not ranked in one task.

Defined cases: a null text is an empty document and has the end id only; rows repeated in full get
places of their own; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stored
from .words import WordIds

SIZE = 1024
END_ID = 2
ROWS_PER_GROUP = 1000
MOST_GROUPS = 1 << 14

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Fixed value: how byte-level vocabularies of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def special_tokens(path: str) -> dict[str, int]:
    """Strings that a tokenizer's JSON file gives ids of their own, wherever they are in a text."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def word_encoder(path: str, special: dict[str, int] | None = None):
    """Ids of words with a byte-level vocabulary; ``special`` strings, which have no blanks, are one id each.

    Words that start with a space and end visibly are encoded as one text: no token crosses from
    one to the next, so the bytes of the tokens tell where each word ends.
    """
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    special = special or {}
    model = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    size = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
    size[list(ranks.values())] = [len(token) for token in ranks]
    for token, number in special.items():
        size[number] = len(token.encode())

    def ids_of(text: str) -> list[int]:
        if any(token in text for token in special):
            return model.encode(text, allowed_special="all")
        return model.encode_ordinary(text)

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([w[0] == " " and not w[-1].isspace() for w in words], bool)
        joined = [w for w, p in zip(words, plain, strict=True) if p]
        others = [ids_of(w) for w, p in zip(words, plain, strict=True) if not p]
        ids = np.array(ids_of("".join(joined)), np.int64)
        ends = np.cumsum(pc.binary_length(pa.array(joined, pa.string())).to_numpy(zero_copy_only=False))
        upto = np.searchsorted(np.cumsum(size[ids]), ends, side="right")
        lengths = np.zeros(len(words), np.int64)
        lengths[plain] = np.diff(upto, prepend=0)
        lengths[~plain] = [len(x) for x in others]
        owner = np.repeat(np.arange(len(words)), lengths)
        flat = np.zeros(len(owner), np.int64)
        flat[plain[owner]] = ids
        flat[~plain[owner]] = [i for x in others for i in x]
        return flat, lengths

    return encode


def token_pieces(
    docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, special: dict[str, int] | None = None,
) -> DataFrame:
    """One row per piece: its document's ids cut so that only the first piece is shorter than ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(word_encoder(path, special))
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                ids, offsets = coder(batch.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                offsets = offsets + np.arange(len(offsets))
                lengths = np.diff(offsets)
                n_pieces = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                short = lengths - (n_pieces - 1) * size
                start = np.where(piece == 0, 0, short[row] + (piece - 1) * size)
                length = np.where(piece == 0, short[row], size)
                first = offsets[:-1][row] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start), "length": pa.array(length),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(
                        pa.array(np.append(first, first[-1] + length[-1]).astype(np.int32)), pa.array(ids.astype(np.int32))
                    )
                yield pa.RecordBatch.from_pydict(columns)

    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


class _Fillings:
    """Which lengths fill a gap exactly, given how many pieces of each length are left."""

    def __init__(self, left: np.ndarray):
        self.left = left
        self._refresh()

    def _refresh(self) -> None:
        self.there = self.left > 0
        marks = self.there.astype(np.float32)
        self.pair_sums = np.convolve(marks, marks) > 0.5

    def take(self, combination: tuple[int, ...], times: int) -> None:
        for length in combination:
            self.left[length] -= times
        if not all(self.left[x] > 0 for x in combination):
            self._refresh()

    def _pair(self, gap: int) -> tuple[int, int] | None:
        a = np.arange(gap - 1, (gap - 1) // 2, -1)  # the larger one first
        fits = self.there[a] & self.there[gap - a]
        for x in a[fits].tolist():
            if self.left[x] >= 1 + (2 * x == gap):
                return x, gap - x
        return None

    def find(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that add up to the gap, the largest first."""
        if self.left[gap] > 0:
            return (gap,)
        if gap < 2:
            return None
        if self.pair_sums[gap] and (pair := self._pair(gap)):
            return pair
        a = np.arange(gap - 2, 0, -1)
        for x in a[self.there[a] & self.pair_sums[gap - a]].tolist():
            self.left[x] -= 1
            was, self.there[x] = self.there[x], self.left[x] > 0
            pair = self._pair(gap - x)
            self.left[x] += 1
            self.there[x] = was
            if pair:
                return (x, *pair)
        return None


def plan_packing(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for pieces counted by length.

    Work and memory depend on ``size`` and the variety of lengths, not on the number of pieces.
    """
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        plan.append(((size,), int(left[size])))
        left[size] = 0
    fill = _Fillings(left)
    for length in range(size - 1, 0, -1):
        while left[length] > 0:
            left[length] -= 1
            fill.there[length] = left[length] > 0
            found = fill.find(size - length)
            left[length] += 1
            fill.there[length] = True
            if found is None:
                break
            whole = (length, *found)
            times = min(int(left[x]) // n for x, n in Counter(whole).items())
            fill.take(whole, times)
            plan.append((whole, times))
    return plan + _best_fit(left, size)


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the open sequence with the smallest gap that takes it."""
    open_at: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    n_open = np.zeros(size + 1, np.int64)

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = size - sum(lengths)
        open_at[gap][lengths] = open_at[gap].get(lengths, 0) + times
        n_open[gap] += times

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            gaps = np.flatnonzero(n_open[length:])
            if not len(gaps):
                per = size // length
                if n >= per:
                    put((length,) * per, n // per)
                n %= per
                if n:
                    put((length,) * n, 1)
                break
            gap = length + int(gaps[0])
            lengths, there = next(iter(open_at[gap].items()))
            times = min(there, n)
            open_at[gap][lengths] -= times
            if not open_at[gap][lengths]:
                del open_at[gap][lengths]
            n_open[gap] -= times
            put((*lengths, length), times)
            n -= times
    return [(lengths, times) for at in open_at for lengths, times in at.items()]


def _ranked(pieces: DataFrame, total: int) -> DataFrame:
    """``rank`` of every piece among those of its length, from 0, whatever their number."""
    groups = min(MOST_GROUPS, max(1, total // ROWS_PER_GROUP))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    before = (
        dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(
            Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        ))
        .select("length", "part", F.coalesce("before", F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return (
        dealt.withColumn("rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    )


def place_pieces(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Pieces with sequence_id and offset; ``pieces`` is read three times, so store it first."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used: Counter[int] = Counter()
    table = []  # length, first rank, first sequence, offset
    sequences = 0
    for lengths, times in plan_packing(counts, size):
        offset = 0
        for length in lengths:
            table.append((length, used[length], sequences, offset))
            used[length] += times
            offset += length
        sequences += times
    table.sort()
    lengths, ranks, firsts, offsets = (np.array(x, np.int64) for x in zip(*table)) if table else [np.zeros(0, np.int64)] * 4
    key = (lengths << 48) + ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 48) + rank, side="right") - 1
            rest = batch.drop_columns(["rank"])
            yield rest.append_column("sequence_id", pa.array(firsts[at] + rank - ranks[at])).append_column(
                "offset", pa.array(offsets[at])
            )

    schema = T.StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long")
    ranked = _ranked(pieces, sum(counts.values()))
    return ranked.select(*pieces.columns, F.col("rank").cast("long").alias("rank")).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, special: dict[str, int] | None = None,
) -> DataFrame:
    """Every piece of every document with its sequence and place; text is read once, never shuffled."""
    return place_pieces(stored(token_pieces(docs, path, size, end_id, doc_id, text, with_ids, special)), size)
