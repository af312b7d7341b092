"""Cutting texts into words and giving every different word its token ids once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import text_bytes


def space_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(code of each word, different words, words of each text).

    The words of a text joined are the text. A word starts at a space or line feed after a
    visible character, or at a visible character after a line feed. Only ASCII and the Latin
    letters U+00C0 to U+00FF count as visible here, so that no tokenizer joins across a cut; other
    places stay uncut, which is always right.
    """
    data, offsets = text_bytes(texts)
    n = len(data)
    visible = (data > 0x20) & (data < 0x7F)
    ends = visible.copy()  # a visible character ends at this byte
    ends[1:] |= (data[1:] >= 0x80) & (data[:-1] == 0xC3)
    begins = visible | (data == 0xC3)
    start = np.zeros(n, bool)
    feed = data == 0x0A
    start[1:] = ((data[1:] == 0x20) | feed[1:]) & ends[:-1]
    after_feed = np.zeros(n, bool)
    after_feed[2:] = begins[2:] & feed[1:-1] & ends[:-2]
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    after_feed[np.minimum(filled + 1, n - 1)] = False  # the feed opens its text
    start |= after_feed
    start[filled] = True
    at = np.flatnonzero(start)
    words = pa.LargeStringArray.from_buffers(
        len(at), pa.py_buffer(np.append(at, n).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))
    ).dictionary_encode()
    return (
        words.indices.to_numpy(zero_copy_only=False),
        words.dictionary.to_pylist(),
        np.diff(np.searchsorted(at, offsets)),
    )


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] of each pair (s, n), one after the other."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return values[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]


class WordIds:
    """Token ids of texts from the ids of their words; words already seen are not encoded again.

    ``encode`` gives (flat ids, ids of each word) for a list of words. ``most`` bounds the words
    kept; beyond it the memory starts afresh, which changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 300_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = (np.zeros(0, np.int64) for _ in range(3))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets)."""
        codes, words, counts = space_words(texts)
        if len(self.known) > self.most:
            self._clear()
        new = [w for w in words if w not in self.known]
        if new:
            flat, lengths = self.encode(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.start = np.append(self.start, len(self.flat) + np.cumsum(lengths) - lengths)
            self.length = np.append(self.length, lengths)
            self.flat = np.append(self.flat, flat)
        at = np.fromiter((self.known[w] for w in words), np.int64, len(words))[codes]
        lengths = self.length[at]
        ids = spread(self.flat, self.start[at], lengths)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, total[np.concatenate([[0], np.cumsum(counts)])]
