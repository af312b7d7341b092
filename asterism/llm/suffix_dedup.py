"""Removes passages of ``LENGTH`` bytes that are somewhere else too, exactly.

Every LENGTH-byte string (a multiple of 8) holds an anchor: of its K-byte grams the one with the smallest hash, the rightmost
of equal ones. Equal strings have equal anchors, so it is enough to compare the surroundings of anchors with
the same gram. Surroundings are hashed first:

* a gram with one place only has no repeat;
* surroundings met twice or more are repeated throughout, which settles most copies without moving text;
* a gram with different surroundings sends one piece of text for each to a bucket. A suffix array of the bucket is built in
  two stages: suffixes smaller than their successor are sorted, all others are induced by scanning
  the buckets of first bytes in order. Adjacent suffixes with LENGTH bytes in common are repeats.

* a gram with more than CROWD different surroundings is not taken to one bucket. Its strings are halved by the number of
  bytes before the gram, again and again; each half has some bytes on both sides of the gram in common, so it is dealt
  by their hash, counted before the shuffle. A half met once has no partner, equal pieces are settled, and
  a half with at most CROWD different pieces goes to a bucket.

Only the first LENGTH bytes of a suffix decide its place here, which is all that the comparison needs.

Defined cases: a null or empty text has no bytes; texts below LENGTH bytes lose nothing; matches never
cross documents; a row repeated in full is another document with the same bytes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes, text_or_empty
from .hashing import RangeHash, mix
from .marks import only_marked

LENGTH = 200
K = 48
BUCKET_BYTES = 600_000
SORT_BYTES = 300_000
CROWD = SORT_BYTES // (2 * LENGTH - K)  # pieces that are sorted together
PART_BYTES = 1 << 19  # longer texts are looked at in parts; anchors take 56 times this
_PLACE = np.uint64((1 << 24) - 1)


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray]:
    """Anchors of texts laid one after the other: text number, place, reach to both sides, hashes of gram and surroundings."""
    none = np.zeros(0, np.int64)
    empty = {"text": none, "place": none, "left": none, "right": none, "gram": none, "around": none}
    if len(data) < length:
        return empty
    of = RangeHash(data)
    grams = of.every(K)
    least = _window_least((grams & ~_PLACE) | (_PLACE - np.arange(len(grams), dtype=np.uint64)), length - K + 1)
    starts, ends = offsets[:-1], offsets[1:]
    # windows that would cross the end of a text
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, np.maximum(ends - length + 1, starts), 1)
    np.add.at(change, ends, -1)
    valid = np.cumsum(change)[: len(least)] == 0
    place = (_PLACE - (least[valid] & _PLACE)).astype(np.int64)
    if not len(place):
        return empty
    place = place[np.append(True, place[1:] != place[:-1])]  # the least of later windows is never further left
    text = np.searchsorted(ends, place, side="right")
    low, high = np.maximum(starts[text], place - (length - K)), np.minimum(ends[text], place + length)
    around = mix(of(low, high) + (place - low).astype(np.uint64))
    return {
        "text": text, "place": place - starts[text], "left": place - low, "right": high - place,
        "gram": grams[place].view(np.int64), "around": around.view(np.int64),
    }


def anchors_in_parts(data: np.ndarray, length: int = LENGTH, part: int = PART_BYTES) -> Iterator[dict[str, np.ndarray]]:
    """The anchors of one text of any length, a part at a time; memory is bounded by the part.

    Parts overlap so far that every anchor of a string that starts in a part is met there with all of its surroundings.
    """
    n, done = len(data), -1
    for begin in range(0, n, part):
        low, high = max(begin - 2 * length, 0), min(begin + part + 2 * length, n)
        a = anchors(data[low:high], np.array([0, high - low]), length)
        place = a["place"] + low
        whole = ((place - (length - K) >= low) | (low == 0)) & ((place + length <= high) | (high == n))
        keep = whole & (place > done)  # the part before has given the others
        if keep.any():
            done = int(place[keep][-1])
            yield {name: values[keep] for name, values in (a | {"place": place}).items()}


_ANCHORS = "doc_id long, place int, reach_left short, reach_right short, gram long, around long"


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", PART_BYTES):
                data, offsets = text_bytes(batch.column("text"))
                # a batch above PART_BYTES is one text
                for a in [anchors(data, offsets, length)] if len(data) <= PART_BYTES else anchors_in_parts(data, length):
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(a["text"])), pa.array(a["place"].astype(np.int32)),
                            pa.array(a["left"].astype(np.int16)), pa.array(a["right"].astype(np.int16)),
                            pa.array(a["gram"]), pa.array(a["around"]),
                        ],
                        ["doc_id", "place", "reach_left", "reach_right", "gram", "around"],
                    )

    return docs.mapInArrow(run, _ANCHORS)


def _sorted_directly(data: np.ndarray, at: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """The suffixes at ``at`` in order of their first ``length`` bytes; equal names are equal bytes.

    Sorts by eight bytes; those that tie are sorted by the next eight, and so on.
    """
    words = np.zeros(len(data) - 7, np.uint64)  # the eight bytes at each place as one number
    for i in range(8):
        words |= data[i : len(data) - 7 + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    _, once, again = np.unique(name[at], return_index=True, return_inverse=True)
    places = at[once]
    order = np.argsort(words[places], kind="stable")
    first = words[places[order]]
    group = np.cumsum(np.concatenate([[0], first[1:] != first[:-1]]))
    for step in range(8, length, 8):
        open_ = np.flatnonzero(np.bincount(group)[group] > 1)
        if not len(open_):
            break
        rows, of = order[open_], group[open_]
        # length is a multiple of 8, and ``length`` bytes follow the last suffix
        inner = np.lexsort((words[places[rows] + step], of))
        order[open_] = rows = rows[inner]
        of, now = of[inner], words[places[rows] + step]
        cut = np.zeros(len(group), bool)
        cut[open_[1:]] = (of[1:] == of[:-1]) & (now[1:] != now[:-1])
        group = group + np.cumsum(cut)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return at[np.argsort(rank[again], kind="stable")]


def suffix_order(data: np.ndarray, name: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """All suffixes in order of their first ``length`` bytes, by two-stage sorting.

    ``data`` ends with ``length`` zero bytes that are not sorted; ``name`` names the first bytes of each suffix.
    """
    n = len(data) - length
    text = data[:n].astype(np.int64)
    # smaller than the successor: a greater byte follows, at the end of a run of equal ones
    change = np.flatnonzero(data[:n] != data[1 : n + 1])
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)] if len(change) else np.full(n, n - 1)
    rises = data[run_end] < data[run_end + 1]
    direct = np.flatnonzero(rises)
    direct = _sorted_directly(data, direct, name, length) if len(direct) else direct
    by_byte = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def hand_on(found: np.ndarray, byte: int) -> np.ndarray:
        """Gives the predecessors of suffixes in order to their buckets; returns those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~rises[before]]
        first = text[before]
        turn = np.argsort(first, kind="stable")
        before, first = before[turn], first[turn]
        for b, part in zip(*_split(first, before), strict=True):
            if b > byte:
                induced[b].append(part)
        return before[first == byte]

    last = np.array([n - 1])  # the end of the text is smaller than anything
    if n and not rises[n - 1]:
        induced[int(text[n - 1])].append(last)
    for byte in range(256):
        same = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        while len(same):
            order.append(same)
            same = hand_on(same, byte)
        sorted_ones = direct[by_byte[byte] : by_byte[byte + 1]]
        if len(sorted_ones):
            order.append(sorted_ones)
            hand_on(sorted_ones, byte)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def _split(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[at].tolist(), np.split(values, at[1:]) if len(at) else []


def repeated_places(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, often: np.ndarray, length: int = LENGTH):
    """(piece, place) of every ``length``-byte string that another place holds too.

    ``owner`` and ``start`` say where a piece lies; one place met in two pieces is one place.
    ``often`` marks pieces that stand for several places.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces) + bytes(length), np.uint8)
    n = int(sizes.sum())
    piece = np.repeat(np.arange(len(pieces)), sizes)
    ends = np.cumsum(sizes)
    at = np.arange(n)
    name = RangeHash(data)(at, at + length)
    order = suffix_order(data, name, length)
    order = order[order + length <= ends[piece[order]]]  # whole strings only
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    alike = np.concatenate([[False], name[order[1:]] == name[order[:-1]]])
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    checked = np.flatnonzero(alike)
    for i in range(0, len(checked), 4096):  # the common prefix itself, where hashes agree
        part = checked[i : i + 4096]
        alike[part] = (view[order[part]] == view[order[part - 1]]).all(1)
    first = np.flatnonzero(~alike)
    size = np.diff(np.append(first, len(order)))
    of = piece[order]
    where = start[of] + order - (ends[of] - sizes[of])
    documents = owner[of]
    several = (
        (np.minimum.reduceat(documents, first) != np.maximum.reduceat(documents, first))
        | (np.minimum.reduceat(where, first) != np.maximum.reduceat(where, first))
        | np.maximum.reduceat(often[of].astype(np.int64), first).astype(bool)
    )
    keep = np.repeat(several, size)
    return of[keep], where[keep]


def _runs(owner: np.ndarray, where: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings at (owner, where) joined to spans wherever they overlap."""
    order = np.lexsort((where, owner))
    owner, where = owner[order], where[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (where[1:] > where[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], where[first], where[last] + length


def _alike_segments(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, start, end) of the runs of strings whose hash occurs twice or more among the pieces.

    All other strings are unlike each other. Hashes are made a few pieces at a time.
    """
    counts = np.array([max(len(p) - length + 1, 0) for p in pieces], np.int64)
    names, first = [], 0
    ends = np.cumsum([len(p) for p in pieces])
    while first < len(pieces):
        most = (ends[first - 1] if first else 0) + SORT_BYTES
        last = max(int(np.searchsorted(ends, most, side="right")), first + 1)
        data = np.frombuffer(b"".join(pieces[first:last]), np.uint8)
        n = counts[first:last]
        begin = np.cumsum([0, *(len(p) for p in pieces[first : last - 1])])
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        names.append(RangeHash(data)(at, at + length))
        first = last
    flat = np.concatenate(names) if names else np.zeros(0, np.uint64)
    _, again, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(pieces)), counts)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    hit = np.flatnonzero(times[again] > 1)
    if not len(hit):
        return hit, hit, hit
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(hit)) - 1
    return owner[hit[head]], place[hit[head]], place[hit[tail]] + length


def _part_spans(pieces: list[bytes], owner: np.ndarray, start: np.ndarray, often: np.ndarray, length: int):
    """(owner, start, end) of the repeats among pieces.

    Only segments that hold a string met twice are sorted, each different segment once; what is found in
    it holds for all places where it occurs. So a passage in very many documents is sorted once.
    """
    none = (np.zeros(0, np.int64),) * 3
    piece, low, high = _alike_segments(pieces, length)
    if not len(piece):
        return none
    known: dict[bytes, int] = {}
    segment = np.array([
        known.setdefault(pieces[p][a:b], len(known)) for p, a, b in zip(piece.tolist(), low.tolist(), high.tolist(), strict=True)
    ])
    owners, starts = owner[piece], start[piece] + low
    order = np.argsort(segment, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], segment[order][1:] != segment[order][:-1]]))
    by = lambda f, x: f.reduceat(x[order], first)
    several = (
        (by(np.minimum, owners) != by(np.maximum, owners)) | (by(np.minimum, starts) != by(np.maximum, starts))
        | (by(np.maximum, often[piece].astype(np.int64)) > 0)
    )
    one = order[first]  # a place of each segment
    found, where = repeated_places(list(known), owners[one], starts[one], several, length)
    if not len(found):
        return none
    which, a, b = _runs(found, where - starts[one][found], length)
    size = np.diff(np.append(first, len(order)))
    repeat = size[which]
    members = order[np.repeat(first[which] - (np.cumsum(repeat) - repeat), repeat) + np.arange(int(repeat.sum()))]
    return owners[members], starts[members] + np.repeat(a, repeat), starts[members] + np.repeat(b, repeat)


_SPANS = "doc_id long, start long, end long"
_HALVES = (
    "gram long, low short, high short, key long, whole long, doc_id long, start long, reach_left short, often boolean, piece binary"
)


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Both halves of each piece whose strings have ``low`` to ``high`` bytes before the gram.

    ``key`` names the bytes that all strings of a half have in common, ``whole`` all of its bytes.
    """
    slack = length - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for large in batches:
            for batch in slices(large, "piece", PART_BYTES):
                raw = batch.column("piece").to_pylist()
                data = np.frombuffer(b"".join(raw), np.uint8)
                size = np.array([len(p) for p in raw], np.int64)
                low, high, left, begin = (
                    batch.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "reach_left", "start")
                )
                right = size - left - K
                at = np.cumsum(size) - size + left
                of = RangeHash(data)
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    before, after = np.minimum(left, b), np.minimum(right, slack - a)
                    has = np.flatnonzero(np.maximum(a, slack - right) <= before)
                    a, b, before, after, g = a[has], b[has], before[has], after[has], at[has]
                    key = of(g - a, g + K + slack - b)
                    whole = mix(of(g - before, g + K + after) + before.astype(np.uint64))
                    cut = [data[x:y].tobytes() for x, y in zip((g - before).tolist(), (g + K + after).tolist(), strict=True)]
                    rows = pa.array(has)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("gram").take(rows), pa.array(a.astype(np.int16)), pa.array(b.astype(np.int16)),
                            pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), batch.column("doc_id").take(rows),
                            pa.array(begin[has] + left[has] - before), pa.array(before.astype(np.int16)),
                            batch.column("often").take(rows), pa.array(cut, pa.binary()),
                        ],
                        [f.split(" ")[0] for f in _HALVES.split(", ")],
                    )

    return pieces.mapInArrow(run, _HALVES)


def _spread(pieces: DataFrame, length: int, crowd: int) -> tuple[list[DataFrame], list[DataFrame], int]:
    """(spans that are settled, pieces for buckets, number of the latter) of grams with more than ``crowd`` pieces.

    Ends after as many rounds as ``length - K`` can be halved: the strings of the last halves are one each.
    """
    part = ["gram", "low", "high", "key"]
    cells = pieces.withColumns({"low": F.lit(0).cast("short"), "high": F.lit(length - K).cast("short")})
    settled, dealt, total = [], [], 0
    while True:
        halves = stored(_halved(cells, length))
        kinds = stored(
            halves.groupBy(*part, "whole")
            .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "reach_left", "often", "piece")).alias("one"))
            .select(*part, "whole", "n", "one.doc_id", "one.start", "one.reach_left", (F.col("one.often") | (F.col("n") > 1)).alias("often"), "one.piece")
        )
        twice = kinds.filter("n > 1").select(*part, "whole")
        settled.append(
            halves.join(twice, [*part, "whole"]).select("doc_id", "start", (F.col("start") + F.length("piece")).alias("end"))
        )
        sizes = stored(kinds.groupBy(*part).agg(F.count("*").alias("kinds")).filter("kinds > 1"))
        few, crowded = sizes.filter(F.col("kinds") <= crowd).select(*part), sizes.filter(F.col("kinds") > crowd).select(*part)
        total += sizes.filter(F.col("kinds") <= crowd).agg(F.sum("kinds")).first()[0] or 0
        dealt.append(kinds.join(few, part).select(F.xxhash64(*part).alias("gram"), "doc_id", "often", "start", "piece"))
        if crowded.isEmpty():
            return settled, dealt, total
        cells = kinds.join(crowded, part).select("gram", "doc_id", "often", "start", "reach_left", "piece", "low", "high")


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, distinct: bool = False) -> DataFrame:
    """(doc_id, start, end) of bytes covered by repeated strings; spans of one document may overlap.

    Rows of one doc_id have one text; ``distinct`` says that there is one row for each, which spares looking for others.
    """
    found = stored(_anchored(docs, length))
    around = stored(
        found.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "place", "reach_left", "reach_right")).alias("one"))
    )
    twice = around.filter("n > 1").select("gram", "around", F.hash("gram", "around").alias("pair"))
    settled = (
        only_marked(found.withColumn("pair", F.hash("gram", "around")), "pair", twice)
        .join(twice.drop("pair"), ["gram", "around"]).filter(F.col("reach_left") + F.col("reach_right") >= length)
        .select(
            "doc_id", (F.col("place") - F.col("reach_left")).cast("long").alias("start"),
            (F.col("place") + F.col("reach_right")).cast("long").alias("end"),
        )
    )
    mixed = stored(around.groupBy("gram").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    few, crowded = mixed.filter(F.col("kinds") <= crowd).select("gram"), mixed.filter(F.col("kinds") > crowd).select("gram")
    wide = around.filter(F.col("one.reach_left") + F.col("one.reach_right") >= length)
    with_text = lambda rows: rows.select("gram", (F.col("n") > 1).alias("often"), "one.*")
    wanted = stored(with_text(only_marked(wide, "gram", few).join(few, "gram")))
    total = wanted.count()

    def cut(wanted: DataFrame) -> DataFrame:
        by_document = wanted.groupBy("doc_id").agg(
            F.collect_list(F.struct("gram", "often", "place", "reach_left", "reach_right")).alias("cut")
        )
        texts = only_marked(docs, "doc_id", wanted.select("doc_id"))
        return (texts if distinct else texts.dropDuplicates(["doc_id"])).join(by_document, "doc_id").select(
            "doc_id", F.encode("text", "utf-8").alias("raw"), F.explode("cut").alias("c")
        ).select(
            "c.gram", "doc_id", "c.often", (F.col("c.place") - F.col("c.reach_left")).cast("long").alias("start"), "c.reach_left",
            F.substring("raw", F.col("c.place") - F.col("c.reach_left") + 1, (F.col("c.reach_left") + F.col("c.reach_right")).cast("int")).alias("piece"),
        )

    pieces = cut(wanted).drop("reach_left")
    if not crowded.isEmpty():
        hot = stored(with_text(wide.join(crowded, "gram")))
        spans, dealt, more = _spread(cut(hot), length, crowd)
        total += more
        for part in dealt:
            pieces = pieces.union(part)
        for part in spans:
            settled = settled.union(part)
    buckets = max(1, -(-total * (2 * length - K) // BUCKET_BYTES))
    pieces = pieces.withColumn("bucket", F.pmod("gram", F.lit(buckets)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gram")  # pieces of one gram stay together, so parts can be sorted one by one
        gram = table.column("gram").to_numpy()
        size = np.cumsum(pc.binary_length(table.column("piece")).to_numpy())
        ends = np.append(np.flatnonzero(gram[1:] != gram[:-1]) + 1, len(gram))
        found, start = [(np.zeros(0, np.int64),) * 3], 0
        while start < len(gram):
            most = (size[start - 1] if start else 0) + SORT_BYTES
            fits = ends[(ends > start) & (size[ends - 1] <= most)]
            stop = int(fits[-1] if len(fits) else ends[np.searchsorted(ends, start, side="right")])
            part = table.slice(start, stop - start)
            found.append(_part_spans(
                part.column("piece").to_pylist(), part.column("doc_id").to_numpy(),
                part.column("start").to_numpy(), part.column("often").to_numpy(), length,
            ))
            start = stop
        ids, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"doc_id": ids, "start": start, "end": end})

    return settled.union(pieces.groupBy("bucket").applyInArrow(run, _SPANS))


def drop_repeats(
    docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256) of every document; ``kept``, the remaining bytes, on request.

    Rows with a null or repeated id are documents of their own: where there are any, rows are told apart by a
    hash of id and text, which takes more room than the ids. Rows alike in both share a hash and its spans, and
    their whole text is repeated.
    """
    number = F.col(doc_id).cast("long")
    rows, ids = docs.agg(F.count("*"), F.count_distinct(number)).first()
    distinct = rows == ids
    key = number if distinct else F.xxhash64(number, F.col(text))
    read = docs.select(key.alias("key"), number.alias("doc_id"), F.col(text).alias("text"))
    found = repeated_spans(read.select(F.col("key").alias("doc_id"), "text"), length, distinct=distinct)
    spans = stored(found).withColumnRenamed("doc_id", "key")
    lists = spans.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "raw", PART_BYTES):
                out = []
                for ident, raw, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "spans")), strict=True):
                    kept, done, removed, n = [], 0, 0, 0
                    last = -1
                    for s in found or []:
                        start, end = s["start"], s["end"]
                        if start > last:  # touching spans are one run
                            n += 1
                            kept.append(raw[done:start])
                            done = start
                        if end > done:
                            removed += end - max(done, start)
                            done = max(done, end)
                        last = max(last, end)
                    kept = b"".join(kept) + raw[done:]
                    row = (ident, len(raw), removed, n, hashlib.sha256(kept).hexdigest())
                    out.append((*row, kept) if with_kept else row)
                columns = zip(*out, strict=True)
                kinds = (*(pa.int64(),) * 4, pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_kept else "")
    names = [f.split(" ")[0] for f in result.split(", ")]
    # texts without a span are not moved
    joined = only_marked(read, "key", spans).join(lists, "key", "left").select("key", "doc_id", "text", "spans")
    others = only_marked(read, "key", spans, marked=False).withColumn("spans", F.lit(None).cast(joined.schema["spans"].dataType))
    every = joined.union(others).select(
        "doc_id", F.encode(text_or_empty(F.col("text")), "utf-8").alias("raw"), "spans"
    )
    return every.mapInArrow(run, result)
