"""Groups documents whose sets of word shingles are alike, exactly.

Texts with the same set are one class. Two classes link when their Jaccard likeness is at least
``ALIKE`` (as whole numbers, UP / DOWN). The search is a T-occurrence search: an inverted list names the classes that
have a shingle, and a partner must be in at least T of a query's lists.

* Linked classes share at least f shingles among the first n - T + f of each, in any order of all shingles. Only
  these prefixes are dealt out by shingle, and a class with fewer shared prefix shingles than f is settled: it has
  no link. The order goes from rare to common, so that passages of very many texts stay out of the prefixes.
* At first the order is a coarse one, from counts in SLOTS hashed slots, a table of fixed size. It settles most
  classes. Among those left open shingles are counted exactly, and the prefixes in the order of these counts are
  dealt out again, ROUNDS times, each time without the classes settled before.
* Classes that share a list, directly or over others, are a candidate group. Groups are searched in blocks, all
  classes with all, and DivideSkip finds the partners of a class: short lists are merged, long ones are
  probed. That gives the number of links of every class, and enough links to make the components.

Blocks hold a bounded number of classes and of shingles. A list that very many texts share is dealt out by class as
well, and counts as shared wherever it is.

Defined cases: null and empty texts have no shingles and link with nothing; texts below ``WORDS`` words have
one shingle, the whole sequence; repeated rows and copies fall in one class, and each of them is a
document; rows with a null or repeated id are documents of their own: texts are found by a hash of id and text.
The component of rows that all have a null id is null, as is that of a text without shingles and without id;
other columns are not read. Classes are told apart by 128 bits of hashes and named by 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_bytes
from .components import components
from .hashing import RangeHash, mix
from .marks import only_marked

WORDS = 5
UP, DOWN = 3, 4
SPARE = 16  # the prefix holds n // SPARE shingles more than one shared shingle asks for
FINE_SPARE = 8
ENTRIES_PER_BUCKET = 400_000
SLOTS = 1 << 18  # hashed counts of shingles
_CHUNK = 1 << 10
HOT_LIST = 1 << 18  # a prefix list of more texts is dealt out by class
ROUNDS = 2
_COMMON = 1 << 40  # stands for the count of a shingle that was not counted exactly
GROUP_BLOCK = 8192  # a candidate group is copied once for every so many classes in it
BLOCK_SHINGLES = 1_500_000  # and for so many shingles
PROBES = 64  # long lists probed at a time
DENSE = 16  # lists with a DENSE-th of a block are kept as bitmaps as well


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted different 64-bit shingle hashes of every text."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    inside = ~white
    starts = inside.copy()
    starts[1:] &= white[:-1]
    firsts = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[firsts] = inside[firsts]
    start = np.flatnonzero(starts)
    ends = white.copy()
    ends[firsts] = True  # a text's end also ends a word
    after = np.append(np.flatnonzero(ends), len(data))
    end = after[np.searchsorted(after, start, side="right")]
    word = RangeHash(data)(start, end)
    counts = np.diff(np.searchsorted(start, offsets))
    factors = mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)
    n = max(len(word) - words + 1, 0)
    full = np.zeros(n, np.uint64)
    for j in range(words):
        full += word[j : j + n] * factors[j]
    full = mix(full)
    out = []
    at = 0
    for count in counts.tolist():
        if count >= words:
            out.append(np.unique(full[at : at + count - words + 1]))
        elif count:
            out.append(mix((word[at : at + count] * factors[:count]).sum(keepdims=True) + np.uint64(count)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += count
    return out


def least_shared(n: np.ndarray) -> np.ndarray:
    """Shingles that any partner of a set of n must share with it."""
    return -(-UP * n // DOWN)


def _spare(n: np.ndarray, spare: int) -> np.ndarray:
    return np.maximum(n // spare, 1)


def prefix_length(n: np.ndarray, spare: int) -> np.ndarray:
    return np.minimum(n, n - least_shared(n) + _spare(n, spare))


def needed(n, spare: int):
    """Shared prefix shingles below which a set of n has no link; a partner may be smaller, but not below 3/4 n."""
    return F.greatest(F.floor(F.ceil(F.lit(UP) * n / DOWN) / spare), F.lit(1))


def _set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, and two independent sums over hashed members) of each set: 128 bits that name it."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    ends = np.concatenate([[0], np.cumsum(n)])
    names = []
    for salt in (1, 2):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(salt << 40)))])
        names.append(mix(total[ends[1:]] - total[ends[:-1]] + n.astype(np.uint64)).view(np.int64))
    return n, names[0], names[1]


def _sets_of(batches: Iterator[pa.RecordBatch]):
    for whole in batches:
        for batch in slices(whole, "text", 2 << 20):
            yield batch, shingle_sets(batch.column("text"))


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(SLOTS - 1)).astype(np.int64)


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n, ref, ref2, chunk, counts): size and name of every document's set.

    Every task adds its counts of shingles by slot, in rows with a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "key", "n", "ref", "ref2", "chunk", "counts"]
        seen = np.zeros(SLOTS, np.int64)
        for batch, sets in _sets_of(batches):
            n, ref, ref2 = _set_names(sets)
            if n.any():
                seen += np.bincount(_slots(np.concatenate(sets)), minlength=SLOTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(n), pa.array(ref), pa.array(ref2),
                 pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names
            )
        if seen.any():
            parts = seen.reshape(-1, _CHUNK)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none] * 5 + [pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
                names,
            )

    return docs.mapInArrow(run, "doc_id long, key long, n long, ref long, ref2 long, chunk int, counts binary")


def _ranks(named: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rank, hot) of every slot: half powers of two above the mean count, and whether a list may be very long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(_CHUNK, np.int64), None
        for b in batches:
            chunk = b.column("chunk")[:1]
            for raw in b.column("counts"):
                total += np.frombuffer(raw.as_buffer(), np.int64)
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([chunk, pa.array([total.tobytes()], pa.binary())], ["chunk", "counts"])

    rows = (
        named.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk")
        .applyInArrow(add, "chunk int, counts binary").collect()  # SLOTS counts, whatever the data
    )
    counts = np.zeros(SLOTS, np.int64)
    for r in rows:
        counts[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.int64)
    mean = max(counts.mean(), 1.0)
    return np.clip(2 * np.log2(np.maximum(counts, 1) / mean), 0, 120).astype(np.uint8), counts > HOT_LIST


_ENTRIES = "bucket int, shingles binary, ids binary"


def _packed(shingles: np.ndarray, ids: np.ndarray, buckets: int, hot: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries dealt out by shingle, one row per bucket; those of very long lists by shingle and id, in
    buckets from ``buckets`` on."""
    dealt_by, crowded = shingles, np.zeros(len(shingles), bool)
    if hot is not None:
        crowded = hot[_slots(shingles)]
        dealt_by = np.where(crowded, mix(shingles ^ mix(ids.view(np.uint64))), shingles)
    bucket = (mix(dealt_by) % np.uint64(buckets)).astype(np.int64) + crowded * buckets
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    parts = list(zip(first, np.append(first, len(order))[1:], strict=True))
    columns = [pa.array(there.astype(np.int32))]
    for values in (shingles, ids):
        dealt = values[order]
        columns.append(pa.array([dealt[a:b].tobytes() for a, b in parts], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["bucket", "shingles", "ids"])


def _prefixes(sets: list[np.ndarray], spare: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the rarest shingles of all sets one after the other, how many of each)."""
    sizes = prefix_length(np.array([len(s) for s in sets], np.int64), spare)
    found = [np.zeros(0, np.uint64)]
    for s, size in zip(sets, sizes.tolist(), strict=True):
        own = rank[_slots(s)]
        found.append(s[np.argsort(own, kind="stable")[:size]] if own.any() else s[:size])
    return np.concatenate(found), sizes


def _text_entries(docs: DataFrame, spare: int, buckets: int, order) -> DataFrame:
    """Prefix entries of every text; copies met in one batch are entered once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets_of(batches):
            n, ref, _ = _set_names(sets)
            _, once = np.unique(ref[n > 0], return_index=True)
            once = np.flatnonzero(n > 0)[once]
            if len(once):
                rank, hot = order.value
                shingles, sizes = _prefixes([sets[i] for i in once], spare, rank)
                yield _packed(shingles, np.repeat(ref[once], sizes), buckets, hot)

    return docs.mapInArrow(run, _ENTRIES)


def _shared(entries: DataFrame, buckets: int) -> DataFrame:
    """(id, leader, n): in how many shared lists an id has this leader.

    A list is shared when it holds two ids; its leader is the smallest. What a list gives is as long as the
    list, not its square. Parts of a very long list all count as shared, and the shingle itself stands for
    their leader.
    """

    def run(table: pa.Table) -> pa.Table:
        shingle, ident = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("shingles", np.uint64), ("ids", np.int64))
        )
        order = np.lexsort((ident, shingle))
        shingle, ident = shingle[order], ident[order]
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (ident[1:] != ident[:-1])
        shingle, ident = shingle[new], ident[new]
        first = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]])[: len(shingle)])
        size = np.diff(np.append(first, len(shingle)))
        if table.column("bucket")[0].as_py() >= buckets:
            leader = mix(shingle).view(np.int64)
        else:
            keep = np.repeat(size > 1, size)
            ident, leader = ident[keep], np.repeat(ident[first], size)[keep]
        return pa.table({"id": ident, "leader": leader})

    # one row per entry of a shared list, added up in the task before anything is shuffled
    found = entries.groupBy("bucket").applyInArrow(run, "id long, leader long")
    return found.groupBy("id", "leader").agg(F.count("*").alias("n"))


class InvertedLists:
    """Which sets of a block hold a shingle, and the T-occurrence search of its sets in them.

    Lists of one set are left out: they say nothing about other sets.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, of_entry, length = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        several = length > 1
        number = np.cumsum(several) - 1
        keep = several[of_entry]
        of_entry, owner = number[of_entry[keep]].astype(np.int32), owner[keep]
        self.length = length[several]
        self.ends = np.cumsum(self.length)
        self.first = self.ends - self.length
        self.own_ends = np.searchsorted(owner, np.arange(len(sets)), side="right")  # lists of every set
        self.own = of_entry
        order = np.argsort(of_entry, kind="stable")
        self.members = owner[order]  # ascending inside a list
        # lists one after the other as one ascending array, so that many probes are one search
        self.probed = of_entry[order].astype(np.int64) * len(sets) + self.members
        dense = np.flatnonzero(self.length * DENSE >= len(sets))
        self.bitmap_of = np.full(len(self.length), -1, np.int32)
        self.bitmap_of[dense] = np.arange(len(dense))
        self.bitmaps = np.zeros((len(dense), len(sets)), np.uint8)
        for row, i in enumerate(dense.tolist()):
            self.bitmaps[row, self.members[self.first[i] : self.ends[i]]] = 1

    def search(self, at: int) -> np.ndarray:
        """The other sets whose likeness with set ``at`` is at least UP / DOWN, by DivideSkip.

        The lists are divided: at most T - 1 long ones are left out at first. The short ones are
        merged (counted by set, in place of a heap); whoever is in T - long of them is then
        probed for in the long lists: in a bitmap where a list has one, by binary search elsewhere.
        """
        size = int(self.sizes[at])
        lists = self.own[self.own_ends[at - 1] if at else 0 : self.own_ends[at]]
        least = int(least_shared(np.int64(size)))
        if len(lists) < least:
            return np.zeros(0, np.int64)
        length = self.length[lists]
        lists = lists[np.argsort(length, kind="stable")]
        n_long = min(least - 1, int(least / (0.01 * np.log2(max(int(length.max()), 2)) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([self.members[self.first[i] : self.ends[i]] for i in short.tolist()])
        seen = np.bincount(merged, minlength=len(self.sizes))
        # overlap >= UP / (UP + DOWN) * (both sizes), as the likeness asks
        asked = -(-UP * (self.sizes + size) // (UP + DOWN))
        candidates = np.flatnonzero((seen > 0) & (seen >= asked - n_long))
        candidates = candidates[candidates != at]
        seen, asked = seen[candidates], asked[candidates]
        bitmap = self.bitmap_of[long]
        if len(candidates) and (bitmap >= 0).any():
            rows = self.bitmaps[bitmap[bitmap >= 0]]
            seen = seen + (rows.sum(0, dtype=np.int32)[candidates] if 4 * len(candidates) > rows.shape[1] else rows[:, candidates].sum(0, dtype=np.int32))
        long = long[bitmap < 0]
        for i in range(0, len(long), PROBES):
            open_ = seen >= asked - (len(long) - i)
            candidates, seen, asked = candidates[open_], seen[open_], asked[open_]
            if not len(candidates):
                break
            probes = long[i : i + PROBES, None].astype(np.int64) * len(self.sizes) + candidates[None, :]
            place = np.minimum(np.searchsorted(self.probed, probes), len(self.probed) - 1)
            seen = seen + (self.probed[place] == probes).sum(0)
        return candidates[seen >= asked]


def _sets_column(table: pa.Table, name: str) -> list[np.ndarray]:
    return shingle_sets(table.column(name).combine_chunks())


def _blocks(active: DataFrame, *carried: str) -> DataFrame:
    """Each candidate group (id, n, group, text) in pairs of bounded blocks; every two blocks meet once."""
    sizes = active.groupBy("group").agg(F.count("*").alias("classes"), F.sum("n").alias("total")).filter("classes > 1").select(
        "group", F.greatest(F.ceil(F.col("classes") / GROUP_BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("parts")
    )
    dealt = active.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "group", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", *carried, "text"
    )
    # pairs of blocks are much work each: they are dealt out evenly, not gathered by their few bytes
    width = max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), met.sparkSession.sparkContext.defaultParallelism)
    return met.repartition(width, "group", "low", "high")


def _group_links(active: DataFrame) -> DataFrame:
    """(id, other, linked) of the classes (id, docs, n, group, text) of candidate groups.

    Without ``other``: how many documents of other classes the class links with inside one pair of blocks. With
    it: a link; of the links in one pair of blocks as many as it takes to join what they join.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, docs, part = (table.column(c).to_numpy() for c in ("id", "docs", "part"))
        lists = InvertedLists(_sets_column(table, "text"))
        linked = np.zeros(len(ids), np.int64)
        across = part.min() != part.max()  # then pairs inside a block are met where it meets itself
        above = np.arange(len(ids))

        def top(x: int) -> int:
            while above[x] != x:
                above[x] = above[above[x]]
                x = above[x]
            return x

        a, b = [], []
        for i in range(len(ids)):
            found = lists.search(i)
            found = found[part[found] != part[i]] if across else found
            linked[i] = docs[found].sum()
            for j in found[above[found] != above[i]].tolist():
                x, y = top(i), top(j)
                if x != y:
                    above[max(x, y)] = min(x, y)
                    a.append(ids[i])
                    b.append(ids[j])
        some = np.flatnonzero(linked)
        return pa.table({
            "id": np.concatenate([ids[some], np.array(a, np.int64)]),
            "other": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
            "linked": np.concatenate([linked[some], np.zeros(len(a), np.int64)]),
        })

    return _blocks(active, "docs").groupBy("group", "low", "high").applyInArrow(run, "id long, other long, linked long")


def _buckets(total: int | None) -> int:
    return max(1, -(-(total or 0) // ENTRIES_PER_BUCKET))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return near_links(docs, doc_id, text).select("doc_id", "n_shingles", "component_id")


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links) of every document.

    ``class_id`` is the smallest id with the same set, null where all of them are; ``n_links`` is the number of other
    documents whose likeness reaches ALIKE, copies among them; without shingles there is no link.
    """
    named, classes, links = _solved(docs, doc_id, text)
    final = components(links.filter("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    linked = links.filter("other IS NULL").groupBy("id").agg(F.sum("linked").alias("linked"))
    placed = classes.join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = placed.join(least, "component").join(linked, "id", "left").select(
        "n", "ref", "ref2", "component_id", F.col("doc").alias("class_id"),
        (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
    )
    return named.join(of_class, ["n", "ref", "ref2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
    )


def _solved(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named sets of all documents, their classes, and links and numbers of links of classes."""
    number = F.col(doc_id).cast("long")
    read = docs.select(number.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(number, text).alias("key"))
    both = stored(_named(read))
    named = both.filter("chunk IS NULL").drop("chunk", "counts")
    order = docs.sparkSession.sparkContext.broadcast(_ranks(both))
    classes = stored(
        named.filter("n > 0").groupBy("n", "ref", "ref2")
        .agg(F.min("doc_id").alias("doc"), F.min("key").alias("key"), F.count("*").alias("docs"))
        .withColumn("id", F.col("ref"))
    )
    buckets = _buckets(classes.agg(F.sum(_prefix("n", SPARE))).first()[0])
    open_classes = stored(
        _open(_shared(_text_entries(read, SPARE, buckets, order), buckets), classes, SPARE).select("id", "n", "key", "docs")
    )
    # Rows alike in id and text have one key: one of them is enough.
    marked = only_marked(read.select("key", "text"), "key", open_classes).dropDuplicates(["key"])
    texts = stored(marked.join(open_classes, "key").select("id", "n", "docs", "text"))

    prefixes = stored(_exact_prefixes(texts, order))
    for _ in range(ROUNDS):
        buckets = _buckets(prefixes.agg(F.sum(_prefix("n", FINE_SPARE))).first()[0])
        shared = stored(_shared(_entries_of(prefixes, buckets, order), buckets))
        prefixes = stored(_open(shared, prefixes, FINE_SPARE).select("id", "n", "prefix"))
    inside = shared.join(prefixes.select("id"), "id", "left_semi")
    groups = components(inside.select(F.col("id").alias("a"), F.col("leader").alias("b")))
    active = texts.join(groups.withColumnRenamed("component", "group"), "id").join(prefixes.select("id"), "id", "left_semi")
    return named, classes, stored(_group_links(active))


def _prefix(n: str, spare: int):
    """``prefix_length`` as a column."""
    n = F.col(n)
    return F.least(n, F.floor(n / DOWN) + F.greatest(F.floor(n / spare), F.lit(1)))


def _open(shared: DataFrame, classes: DataFrame, spare: int) -> DataFrame:
    """The classes with enough shared prefix shingles for a link."""
    found = shared.groupBy("id").agg(F.sum("n").alias("shared"))
    return found.join(classes, "id").filter(F.col("shared") >= needed(F.col("n"), spare))


def _exact_prefixes(texts: DataFrame, order) -> DataFrame:
    """(id, n, prefix): the rarest shingles of every class, by how many classes of ``texts`` have a shingle.

    Sets are dealt out by shingle and counted; classes get back the counts above one. Shingles of very long
    lists are not dealt out and count as common.
    """
    buckets = _buckets(texts.agg(F.sum("n")).first()[0])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = order.value
        for batch, sets in _sets_of(batches):
            if not len(sets):
                continue
            shingles = np.concatenate(sets)
            ids = np.repeat(batch.column("id").to_numpy(), [len(s) for s in sets])
            rare = ~hot[_slots(shingles)]
            yield _packed(shingles[rare], ids[rare], buckets)

    def count(table: pa.Table) -> pa.Table:
        shingle, ident = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("shingles", np.uint64), ("ids", np.int64))
        )
        _, at, n = np.unique(shingle, return_inverse=True, return_counts=True)
        several = n[at] > 1
        shingle, ident, n = shingle[several], ident[several], n[at][several]
        to = _group_of(ident, buckets)
        by_group = np.argsort(to, kind="stable")
        there, first = np.unique(to[by_group], return_index=True)
        ends = np.append(first, len(to))[1:].tolist()
        columns = {"to": pa.array(there)}
        for name, values in (("ids", ident), ("shingles", shingle), ("counts", n.astype(np.int64))):
            dealt = values[by_group]
            columns[name] = pa.array([dealt[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())
        return pa.table(columns)

    def choose(asked: pa.Table, answers: pa.Table) -> pa.Table:
        rank, hot = order.value
        sets = _sets_column(asked, "text") if asked.num_rows else []
        ident, shingle, n = (
            np.frombuffer(b"".join(answers.column(c).to_pylist()), kind)
            for c, kind in (("ids", np.int64), ("shingles", np.uint64), ("counts", np.int64))
        )
        by_id = np.lexsort((shingle, ident))
        ident, shingle, n = ident[by_id], shingle[by_id], n[by_id]
        ids = asked.column("id").to_numpy()
        low, high = np.searchsorted(ident, ids), np.searchsorted(ident, ids, side="right")
        lengths = prefix_length(np.array([len(s) for s in sets], np.int64), FINE_SPARE)
        found = []
        for s, a, b, length in zip(sets, low.tolist(), high.tolist(), lengths.tolist()):
            counts = np.ones(len(s), np.int64)
            counts[np.searchsorted(s, shingle[a:b])] = n[a:b]
            slot = _slots(s)
            common = hot[slot]
            counts[common] = _COMMON + rank[slot[common]].astype(np.int64)
            found.append(s[np.argsort(counts, kind="stable")[:length]].tobytes())
        return pa.table({"id": ids, "n": asked.column("n").to_numpy(), "prefix": pa.array(found, pa.binary())})

    counted = texts.select("id", "text").mapInArrow(deal, _ENTRIES).groupBy("bucket").applyInArrow(
        count, "to long, ids binary, shingles binary, counts binary"
    )
    asked = texts.select("id", "n", "text").mapInArrow(_with_group(buckets), "id long, n long, text string, to long")
    return asked.groupBy("to").cogroup(counted.groupBy("to")).applyInArrow(choose, "id long, n long, prefix binary")


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _with_group(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("to", pa.array(_group_of(batch.column("id").to_numpy(), groups)))

    return run


def _entries_of(prefixes: DataFrame, buckets: int, order) -> DataFrame:
    """Stored prefixes dealt out by shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, hot = order.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                found = [np.frombuffer(p.as_buffer(), np.uint64) for p in batch.column("prefix")]
                ids = np.repeat(batch.column("id").to_numpy(), [len(p) for p in found])
                yield _packed(np.concatenate(found), ids, buckets, hot)

    return prefixes.select("id", "prefix").mapInArrow(run, _ENTRIES)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, a missing id being the largest.

    Rows with a missing or repeated id are compared like any others; of rows with one id the one with the smallest
    hashed text stays. Texts without words are in no group, so all of their rows stay.
    """
    rows, ids = docs.agg(F.count("*"), F.count_distinct(F.col("doc_id").cast("long"))).first()
    if rows == ids:
        kept = near_groups(docs).filter("doc_id = component_id").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi")
    # all columns in one struct, so that no name can clash
    numbered = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text",
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"),
    ))
    groups = near_groups(numbered, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    named = numbered.select("row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "row").alias("name"))
    kept = groups.join(named, "row").groupBy("component_id").agg(F.min("name").alias("name")).select("name.row")
    return numbered.join(kept, "row", "left_semi").select("document.*")
