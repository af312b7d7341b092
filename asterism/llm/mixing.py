"""Mixing sources to target weights: how often a mix takes every document.

Sources in order of their code points (rows without a source last) weigh 5, 2, 1, 5, 2, 1, ... and share all words of
the table by weight. A target stops at MOST times its source; what is over is shared again by weight among
the others. A source first takes all its documents as often as the target holds it whole. What is left is a
subset-sum problem over document sizes: documents are counted by exact size, every size gives its
proportional share, and a bounded knapsack over the sizes finds the rest, some EXACT words of it. Which
documents of a size are taken is a seeded draw.

Only counts by (source, size) reach a planning task. A source of w words has at most sqrt(2 w) different
sizes, so that a source with a third of 10^13 words gives one task some million pairs of numbers, however many rows
it has. Documents are ranked inside hashed parts of one size, so that many copies of a text do not meet in
one task either.

Defined cases: a text that is null counts as empty; an empty text has size 0 and takes no words; rows
without a source are one source of their own, the last; a source of only empty texts has target 0; an empty
table gives no rows; repeated rows are documents of their own, and rows alike in doc_id, text, source are
exchangeable. Where no set of whole documents meets a target, the nearest found one is taken, with further
copies (up to MOST) of some documents if that comes nearer. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and its source's size in its target
SEED = 11
EXACT = 1 << 16  # words that the knapsack settles; twice the longest document where that is more,
MOST_EXACT = 1 << 22  # up to this many
PARTS = 1024  # hashed parts of the documents of one size

_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def count_words(texts: pa.Array) -> np.ndarray:
    """The number of runs of characters other than ASCII white space in every text."""
    data, offsets = text_bytes(texts)
    solid = _SOLID[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    starts = offsets[filled]
    first[starts] = solid[starts]
    counts = np.zeros(len(offsets) - 1, np.int64)
    if len(filled):
        counts[filled] = np.add.reduceat(first.view(np.uint8), starts, dtype=np.int64)
    return counts


# ---- targets -------------------------------------------------------------------------------------


def _weighed(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """``sources`` and ``weight``, dealt out in order of ``key``; sources are numbered in sorted ranges."""
    ranged = stored(sources.repartitionByRange("key").withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))  # one row per range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy("key")) - 1
    listed = F.array(*[F.lit(int(w)) for w in weights])
    return ranged.join(F.broadcast(starts), "range").select(
        "key", "source_size", F.get(listed, F.pmod(place, F.lit(len(weights))).cast("int")).alias("weight")
    )


def _level(weighed: DataFrame, most: int) -> float:
    """Words for a weight of 1: no target is above ``most`` times its source, and together they are all words."""
    total, weight = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    level = total / weight
    limit = F.col("source_size") * most
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        held, free = weighed.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        raised = (total - held) / free if free else level
        if raised <= level:
            return level
        level = raised


# ---- the plan of one source ------------------------------------------------------------------------


def nearest_sum(sizes: Sequence[int], room: Sequence[int], goal: int) -> list[int]:
    """How many of each size, at most ``room``, sum up nearest to ``goal``; the lower sum on ties.

    Bounded knapsack: counts are split into powers of two, reachable sums are the bits of one number, and a
    part that reaches no new sum is left out. Stops at the first set that meets the goal.
    """
    taken = [0] * len(sizes)
    window = (1 << (2 * goal + 1)) - 1
    steps, reach = [], [1]
    for i, (size, n) in enumerate(zip(sizes, room)):
        n = min(n, 2 * goal // size)
        part = 1
        while n > 0 and not reach[-1] >> goal & 1:
            part = min(part, n)
            more = (reach[-1] | reach[-1] << (size * part)) & window
            if more != reach[-1]:
                steps.append((i, part))
                reach.append(more)
            n, part = n - part, part * 2
    at = (reach[-1] & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> goal
    if above:
        higher = goal + (above & -above).bit_length() - 1
        at = higher if higher - goal < goal - at else at
    for (i, part), before in zip(reversed(steps), reversed(reach[:-1])):
        if not before >> at & 1:
            taken[i] += part
            at -= sizes[i] * part
    return taken


def _fit(sizes: list[int], counts: list[int], room: list[int], goal: int, total: int, exact: int, open_part: int) -> list[int]:
    """How many documents of each size (ascending), at most ``room``, hold about ``goal`` of ``total`` words.

    The knapsack gets one ``open_part``-th of the goal, and at most some ``exact`` words.
    """
    exact = max(exact, min(2 * sizes[-1], MOST_EXACT))
    shared = goal - min(-(-goal // open_part), exact // 2)
    taken, owed = [0] * len(sizes), 0
    for i in reversed(range(len(sizes))):  # what a size cannot give goes on to the next shorter one
        owed += shared * counts[i] * sizes[i]
        taken[i] = min(room[i], owed // (sizes[i] * total))
        owed -= taken[i] * sizes[i] * total
    rest = goal - sum(t * s for t, s in zip(taken, sizes))
    for i in reversed(range(len(sizes))):
        if rest <= exact:
            break
        more = min(room[i] - taken[i], (rest - exact // 2) // sizes[i])
        taken[i] += more
        rest -= more * sizes[i]
    left = [r - t for r, t in zip(room, taken)]
    if 0 < rest <= exact:
        for i, more in enumerate(nearest_sum(sizes, left, rest)):
            taken[i] += more
    elif rest and any(left):  # only documents longer than most of the rest are left
        near, i = min((abs(s - rest), i) for i, s in enumerate(sizes) if left[i])
        taken[i] += near < rest
    return taken


def _extra(sizes: list[int], counts: list[int], room: list[int], goal: int, exact: int) -> tuple[list[int], int]:
    """(how many of each size, distance from the goal); the knapsack gets more only where less does not meet the goal."""
    total = sum(s * n for s, n in zip(sizes, counts))
    most = sum(s * n for s, n in zip(sizes, room))
    out = most == total and 2 * goal > total  # choose the documents to leave out, which are fewer
    asked = most - goal if out else goal
    best, gap = [0] * len(sizes), asked
    for open_part in (16, 4, 1):
        if gap:
            taken = _fit(sizes, counts, room, asked, total, exact, open_part)
            off = abs(asked - sum(t * s for t, s in zip(taken, sizes)))
            if off < gap:
                best, gap = taken, off
    return [r - t for r, t in zip(room, best)] if out else best, gap


def plan_source(
    sizes: Sequence[int], counts: Sequence[int], target: float, most: int = MOST, exact: int = EXACT
) -> list[tuple[int, int]]:
    """(copies of every document, documents with one copy more) of each size, for ascending sizes above 0."""
    sizes, counts = [int(s) for s in sizes], [int(n) for n in counts]
    total = sum(s * n for s, n in zip(sizes, counts))
    goal = math.floor(target + 0.5)
    repeats = min(goal // total, most) if total else 0
    rest = goal - repeats * total
    best, gap = [0] * len(sizes), rest
    for extra in sorted({min(1, most - repeats), most - repeats}):
        if gap > 0 and extra:
            taken, off = _extra(sizes, counts, [n * extra for n in counts], rest, exact)
            if off < gap:
                best, gap = taken, off
    return [(repeats + t // n, t % n) for t, n in zip(best, counts)]


def _planned(lengths: DataFrame, most: int, exact: int) -> DataFrame:
    """(key, size, copies, extra, source_size, target) from counts by (key, size)."""

    def plan(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("size")
        sizes, counts = rows.column("size").to_numpy(), rows.column("n").to_numpy()
        full = sizes > 0
        found = plan_source(sizes[full], counts[full], rows.column("target")[0].as_py(), most, exact)
        copies, extra = np.zeros((2, len(sizes)), np.int64)
        if found:
            copies[full], extra[full] = np.array(found, np.int64).T
        return rows.select(["key", "size", "source_size", "target"]).append_column(
            "copies", pa.array(copies)
        ).append_column("extra", pa.array(extra))

    return lengths.groupBy("key").applyInArrow(
        plan, "key string, size long, source_size long, target double, copies long, extra long"
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    seed: int = SEED,
    keep: Sequence[str] = (),
    exact: int = EXACT,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row; ``taken`` is copies * size.

    ``keep`` names columns of ``docs`` that come along in the struct ``document``.
    """
    known = F.concat(F.lit("="), F.col("source").cast("string"))
    fields = ["doc_id long", "key string", "draw long"]
    columns = [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(known, F.lit("~")).alias("key"),  # sorts behind every known source
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("draw"),
    ]
    if keep:
        columns.append(F.struct(*[F.col(c) for c in keep]).alias("document"))
        fields.append(f"document {docs.select(columns[-1]).schema[0].dataType.simpleString()}")
    names = [f.split(" ", 1)[0] for f in fields]

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.select(names).append_column("size", pa.array(count_words(part.column("text"))))

    rows = stored(
        docs.select(*columns, F.col("text").cast("string").alias("text")).mapInArrow(sized, ", ".join([*fields, "size long"]))
    ).withColumn("part", F.pmod("draw", F.lit(PARTS)).cast("int"))
    counts = stored(rows.groupBy("key", "size", "part").agg(F.count("*").alias("n")))
    sources = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    weighed = stored(_weighed(sources, weights))
    target = F.least(
        (F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(_level(weighed, most))
    )
    targets = weighed.select("key", "source_size", target.alias("target"))
    lengths = counts.groupBy("key", "size").agg(F.sum("n").alias("n")).join(targets, "key")
    plan = _planned(lengths, most, exact)
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    share = counts.join(plan, ["key", "size"]).select(  # at most PARTS rows for one size of a source
        "key", "size", "part", "source_size", "target", "copies",
        (F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("more"),
    )
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("draw", "doc_id"))
    copies = F.col("copies") + (F.col("_rank") <= F.col("more")).cast("long")
    source = F.when(F.col("key") != "~", F.substring("key", 2, 1 << 30))
    return (
        rows.join(share, ["key", "size", "part"]).withColumn("_rank", rank)
        .select(
            "doc_id", source.alias("source"), "size", "source_size", "target", copies.alias("copies"),
            (copies * F.col("size")).alias("taken"), *(["document"] if keep else []),
        )
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    planned = mix_sources(docs, keep=docs.columns, **options).filter("copies > 0")
    return planned.select("document", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("document.*")
