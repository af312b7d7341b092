"""Encoding and decoding with the vocabulary of a byte-fallback piece model.

A text gets one leading space, spaces become the space mark, every character is a symbol, and the
adjacent pair whose union has the best score is merged, the leftmost first, until none is
left. This is done for all different words of a batch at once: flat numpy arrays of symbols, the
best pair of every word by a segmented minimum, all its leftmost places merged together, finished
words taken out. Where a merge would make a pair of the same or a better rank, only
the leftmost place of that word is merged in that round, so the order is the sequential one.
Characters outside the vocabulary become their UTF-8 bytes.

Defined cases: a null or empty text has no ids and decodes to an empty text; other columns
are passed through; long words only take more rounds.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices
from .words import WordIds, spread

MARK = "▁"
NONE = np.iinfo(np.int64).max


class PieceModel:
    """Arrays made from the vocabulary; small enough for a broadcast (a few MB)."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.array([i for i in range(n) if model.is_byte(i)], np.int64)
        special = {i for i in range(n) if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}
        self.n = n
        of = {p: i for i, p in enumerate(pieces) if i not in special}
        for char in sorted({c for p in of for c in p} - of.keys()):
            of[char] = len(pieces) + len(of) - (n - len(special))
        chars = sorted((ord(p), i) for p, i in of.items() if len(p) == 1)
        self.points = np.array([c for c, _ in chars], np.int64)
        self.point_symbols = np.array([i for _, i in chars], np.int64)
        extra = sorted((i, p) for p, i in of.items() if i >= n)
        self.extra = [p for _, p in extra]
        self.base = n + len(extra)  # symbols from here on: an unknown character's code point
        scores = {p: model.get_score(i) for p, i in of.items() if i < n}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = sorted(
            (of[p[:cut]] * self.base + of[p[cut:]], order[scores[p]], i)
            for p, i in of.items() if i < n
            for cut in range(1, len(p)) if p[:cut] in of and p[cut:] in of
        )
        self.pair, self.rank, self.union = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        surface = [
            bytes([int(p[3:5], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i)
            else " ⁇ ".encode() if model.is_unknown(i)
            else p.replace(MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.surface_length = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_length) - self.surface_length
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    @classmethod
    def of(cls, arrays: dict) -> PieceModel:
        """The model again from its arrays, ``vars(model)``; tasks get these, not the class."""
        model = cls.__new__(cls)
        vars(model).update(arrays)
        return model

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, union) of pairs of symbols; NONE where they don't make a piece."""
        known = (left < self.base) & (right < self.base)
        key = np.where(known, left * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.union[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word); spaces in the words stand for the space mark."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        symbols = np.where(self.points[at] == points, self.point_symbols[at], self.base + points)
        symbols, lengths = self._merge(symbols, sizes)
        return self._to_ids(symbols, lengths)

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_words, done_symbols = [], []

        def ranked(symbols, word):
            rank, union = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            inside = np.flatnonzero(word[1:] == word[:-1])
            rank[inside], union[inside] = self._rank(symbols[inside], symbols[inside + 1])
            return rank, union

        rank, union = ranked(symbols, word)
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(first, len(symbols)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            live = best < NONE
            if not live.all():
                done_words.append(word[~live])
                done_symbols.append(symbols[~live])
                symbols, word, rank, union, best = (x[live] for x in (symbols, word, rank, union, best))
                if not len(symbols):
                    break
            hit = rank == best
            # of places that overlap in a row, every second one from the left
            places = np.flatnonzero(hit)
            new_run = np.concatenate([[True], np.diff(places) > 1])
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run_start) % 2 == 0]
            next_state = self._merged(symbols, word, rank, union, best, places)
            again = next_state[-1]
            if len(again):  # words in which order matters: only their leftmost place
                owner = word[places]
                leftmost = np.concatenate([[True], owner[1:] != owner[:-1]])
                places = places[leftmost | ~np.isin(owner, again)]
                next_state = self._merged(symbols, word, rank, union, best, places)
            symbols, word, rank, union, _ = next_state
        if not done_words:
            return symbols, sizes * 0
        words, flat = np.concatenate(done_words), np.concatenate(done_symbols)
        return flat[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(sizes))

    def _merged(self, symbols, word, rank, union, best, places):
        """State after the merges at ``places``, and the words with a new pair not worse than the merged."""
        after = places[places + 2 < len(symbols)]
        after = after[word[after] == word[after + 2]]  # as met when only the left one is merged
        next_rank, _ = self._rank(union[after], symbols[after + 2])
        eager = word[after[next_rank <= best[after]]]
        symbols, rank, union = symbols.copy(), rank.copy(), union.copy()
        symbols[places] = union[places]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        shift = np.cumsum(~keep)
        symbols, word, rank, union, best = (x[keep] for x in (symbols, word, rank, union, best))
        made = places - shift[places]
        near = np.unique(np.concatenate([made, made[made > 0] - 1]))
        inside = near[(near + 1 < len(symbols))]
        inside = inside[word[inside] == word[inside + 1]]
        rank[near] = NONE
        rank[inside], union[inside] = self._rank(symbols[inside], symbols[inside + 1])
        return symbols, word, rank, union, np.union1d(word[near[rank[near] <= best[near]]], eager)

    def _to_ids(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        strange = np.flatnonzero(symbols >= self.n)
        if not len(strange):
            return symbols, lengths
        raw = [
            (self.extra[s - self.n] if s < self.base else chr(s - self.base)).encode()
            for s in symbols[strange]
        ]
        width = np.ones(len(symbols), np.int64)
        width[strange] = [len(r) for r in raw]
        ids = np.repeat(symbols, width)
        first = (np.cumsum(width) - width)[strange]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids[np.repeat(first, width[strange]) + np.concatenate([np.arange(len(r)) for r in raw])] = self.byte_ids[flat]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        return ids, np.bincount(owner, weights=width, minlength=len(lengths)).astype(np.int64)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each run of ids, without the leading space that encoding adds."""
        data = spread(self.surface, self.surface_start[ids], self.surface_length[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.surface_length[ids])])[offsets]
        codecs.register_error("each-byte", lambda error: ("\N{REPLACEMENT CHARACTER}", error.start + 1))
        found = (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "each-byte") for x in found]


def _joined(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids of each text in decimal digits, with commas."""
    digits = pa.array(ids).cast(pa.string())
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), digits)
    return pc.binary_join(lists, ",").cast(pa.binary()).to_pylist()


def encode_pieces(
    docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True,
) -> DataFrame:
    """``keep`` columns and n_tokens, ids_sha256, decoded_sha256; ids and decoded text with ``with_ids``.

    Row by row: nothing is shuffled. The vocabulary's arrays are sent to the tasks once.
    """
    arrays = docs.sparkSession.sparkContext.broadcast(vars(PieceModel(path)))
    schema = T.StructType([docs.schema[c] for c in keep])
    for name in ("n_tokens", "ids_sha256", "decoded_sha256"):
        schema = schema.add(name, T.LongType() if name == "n_tokens" else T.StringType())
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(arrays.value)
        coder = WordIds(pieces.encode_words)
        for whole in batches:
            for batch in slices(whole, "__text", 2 << 20):
                texts = pc.fill_null(batch.column("__text"), "")
                empty = pc.equal(texts, "")
                spaced = pc.if_else(empty, "", pc.binary_join_element_wise(" ", texts, ""))
                ids, offsets = coder(spaced)
                decoded = pieces.decode(ids, offsets)
                columns = [batch.column(c) for c in keep] + [
                    pa.array(np.diff(offsets)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in _joined(ids, offsets)]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ]
                if with_ids:
                    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                    columns += [lists, pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    read = docs.select(*(docs[c] for c in keep), docs[text].alias("__text"))
    return read.mapInArrow(run, schema)
