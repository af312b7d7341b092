"""Quality of texts by a generalised additive model with pairwise interactions.

Every text gets numbers that describe its characters, words and lines. Each number is cut into
quantile bins, and the model is one table of values per feature and a small one per pair of
features. Training goes round the features again and again; each turn fits a tree of a few leaves to
the gradients summed by bin and adds a small part of it to the table. Pairs follow in the same way, on
what the single tables leave over. A score is the sum of the tables' values at a text's bins.

The model is fitted on at most ``MOST_ROWS`` labelled rows, those with the smallest hashed id, the
one bounded sample here; every document is scored. Held-out rows never train it.

Defined cases: a null or empty text has features of zero and gets a score like any other; without a
label of each kind the score is the share of label 1, or 0.5; labels of unknown documents are not used;
repeated rows are scored alike; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_bytes
from .words import space_words

MOST_ROWS = 20_000
KEEP_FROM = 0.3
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 10
LEAVES = 4
RATE = 0.1
SHRINK = 1.0
FOLDS = 5

_GROUPS = (  # characters whose share of the text is a feature
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", ".,;:'-", "!?",
    "#$%&*", "|/\\_=+~^@<>{}[]()\"`",
)
FEATURES = (
    "length", "lower", "upper", "digit", "space", "feed", "stop", "shout", "symbol", "bracket", "beyond_ascii",
    "upper_of_letters", "entropy", "word_length", "new_words", "new_word_pairs", "new_lines", "line_length",
    "symbol_after_word", "capital_words",
)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _different(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many different codes each text has."""
    if not len(codes):
        return np.zeros(len(counts))
    owner = np.repeat(np.arange(len(counts)), counts)
    width = int(codes.max()) + 1
    return np.bincount(np.unique(owner * width + codes) // width, minlength=len(counts))


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = text_bytes(texts)
    n = np.diff(offsets)
    some = np.maximum(n, 1)
    group = np.full(256, len(_GROUPS), np.uint8)
    for i, chars in enumerate(_GROUPS):
        group[[ord(c) for c in chars]] = i
    of = group[data]
    of[data >= 128] = len(_GROUPS) + 1
    shares = [_sums(of == i, offsets) for i in [*range(len(_GROUPS)), len(_GROUPS) + 1]]
    owner = np.repeat(np.arange(len(n)), n)
    seen = np.bincount(owner * 256 + data, minlength=256 * len(n)).reshape(len(n), 256) / some[:, None]
    entropy = -(seen * np.log2(np.where(seen > 0, seen, 1))).sum(1)

    codes, words, counts = space_words(texts)
    n_words = np.maximum(counts, 1)
    codes = codes.astype(np.int64)
    pairs = codes[:-1] * max(len(words), 1) + codes[1:]
    first = np.cumsum(counts)[:-1]
    inside = np.ones(max(len(codes) - 1, 0), bool)
    inside[first[(first > 0) & (first < len(codes))] - 1] = False
    pair_counts = np.maximum(counts - 1, 0)
    _, pair_codes = np.unique(pairs[inside], return_inverse=True)

    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_counts = lines.value_lengths().to_numpy(zero_copy_only=False)
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)

    letter_then = np.zeros(len(data), bool)
    letter_then[1:] = (of[1:] == 7) & (of[:-1] != 7) & (of[:-1] != 3)
    capital = np.zeros(len(data), bool)
    capital[1:] = (of[1:] == 1) & ((of[:-1] == 3) | (of[:-1] == 4))
    starts = offsets[:-1][n > 0]  # what stands before a text is no part of it
    letter_then[starts] = capital[starts] = False
    letters = np.maximum(shares[0] + shares[1], 1)
    columns = [
        np.log1p(n), *(s / some for s in shares), shares[1] / letters, entropy, n / n_words,
        _different(codes, counts) / n_words, _different(pair_codes, pair_counts) / np.maximum(pair_counts, 1),
        _different(line_codes, line_counts) / np.maximum(line_counts, 1), np.log1p(n / np.maximum(line_counts, 1)),
        _sums(letter_then, offsets) / n_words, _sums(capital, offsets) / n_words,
    ]
    return np.where((n == 0)[:, None], 0.0, np.stack(columns, axis=1).astype(np.float64))


def _leaves(gradient: np.ndarray, weight: np.ndarray, most: int = LEAVES) -> np.ndarray:
    """Value of each bin from a tree of at most ``most`` leaves over ordered bins."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (w[b] - w[a] + SHRINK)

    parts = [(0, len(gradient))]
    while len(parts) < most:
        best = (1e-9, None, None)
        for i, (a, b) in enumerate(parts):
            cuts = np.arange(a + 1, b)
            if len(cuts):
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], i, int(cuts[at]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + SHRINK)
    return out


def _quarters(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the best cut of a square table into four parts, one cut per axis."""
    g = np.pad(gradient, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    w = np.pad(weight, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    inner = slice(1, -1)

    def quarters(t):
        a, rows, columns, all_ = t[inner, inner], t[inner, -1:], t[-1:, inner], t[-1, -1]
        return np.stack([a, rows - a, columns - a, all_ - rows - columns + a])

    qg, qw = quarters(g), quarters(w)
    gain = (qg**2 / (qw + SHRINK)).sum(0) - g[-1, -1] ** 2 / (w[-1, -1] + SHRINK)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    value = qg[:, i, j] / (qw[:, i, j] + SHRINK)
    out = np.empty(gradient.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :] = value[0], value[1]
    out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value[2], value[3]
    return float(gain[i, j]), out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class QualityModel:
    """Tables of an additive model; a few kilobytes, shipped to tasks as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = y.mean() if len(y) else 0.5
        self.base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        n_features = x.shape[1]
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], levels)) if len(x) else np.zeros(0) for f in range(n_features)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if len(np.unique(y)) == 2:
            self._fit(self._bins(x), y)

    def _bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]

    def _coarse(self, bins: list[np.ndarray], f: int) -> np.ndarray:
        return bins[f] * PAIR_BINS // (len(self.cuts[f]) + 1)

    def _fit(self, bins: list[np.ndarray], y: np.ndarray) -> None:
        score = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f, b in enumerate(bins):
                p = _sigmoid(score)
                size = len(self.tables[f])
                step = RATE * _leaves(np.bincount(b, y - p, size), np.bincount(b, p * (1 - p), size))
                self.tables[f] += step
                score += step[b]
        p = _sigmoid(score)
        cells = {}
        gains = []
        for i in range(len(bins)):
            for j in range(i):
                cells[i, j] = self._coarse(bins, i) * PAIR_BINS + self._coarse(bins, j)
                gains.append((self._step(cells[i, j], y, p)[0], i, j))
        chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        tables = {c: np.zeros((PAIR_BINS, PAIR_BINS)) for c in chosen}
        for _ in range(PAIR_ROUNDS):
            for c in chosen:
                step = RATE * self._step(cells[c], y, _sigmoid(score))[1]
                tables[c] += step
                score += step.ravel()[cells[c]]
        self.pairs = [(i, j, tables[i, j]) for i, j in chosen]

    @staticmethod
    def _step(cell: np.ndarray, y: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
        size = PAIR_BINS * PAIR_BINS
        shape = (PAIR_BINS, PAIR_BINS)
        return _quarters(
            np.bincount(cell, y - p, size).reshape(shape), np.bincount(cell, p * (1 - p), size).reshape(shape)
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: values looked up by bin and added."""
        bins = self._bins(x)
        total = np.full(len(x), self.base)
        for table, b in zip(self.tables, bins, strict=True):
            total += table[b]
        for i, j, table in self.pairs:
            total += table[self._coarse(bins, i), self._coarse(bins, j)]
        return _sigmoid(total)


def held_out(doc_id):
    """Rows whose crc32 of the id's digits is divisible by FOLDS; they never train."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> QualityModel:
    """A model from at most ``most_rows`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    sample = known.select("doc_id", "quality").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "quality").limit(most_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                x = features(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), lists], ["doc_id", "quality", "x"]
                )

    found = rows.mapInArrow(run, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x = found.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
    return QualityModel(x, found.column("quality").to_numpy().astype(np.float64))


def quality_score(model: QualityModel):
    """A column function: text -> score."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        parts = [model.score(features(b.column(0))) for b in slices(batch, "text", 2 << 20)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score.asNondeterministic()  # it is not, but a filter on it must not compute it twice


def score_quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """``docs`` with held_out, score and predicted, in the place of columns of these names.

    A row without an id never trains, so it is held out.
    """
    model = fit_quality(docs, labels)
    return docs.withColumn("score", quality_score(model)(F.col("text"))).withColumns({
        "held_out": F.coalesce(held_out(F.col("doc_id")), F.lit(True)),
        "predicted": (F.col("score") >= keep_from).cast("int"),
    })
