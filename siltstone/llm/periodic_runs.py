"""Periodic stretches of words: repeated k-grams mask what cannot be part of one, Main-Lorentz finds the rest.

A run of period q and length n repeats n - q words at distance q.  With n at
least ``least`` and ``times`` q, that overlap has at least
``least - least // times`` words, so that every word of a run lies in a k-gram
of so many words that stands twice or more in its document.  Words outside such
k-grams are masked.  The surviving segments of a slice of documents are searched
together by Main-Lorentz: words are split at the multiples of growing powers of
two, and for each split and period the repetition that crosses it reaches as far
as the longest common extensions to both sides.  Extensions come from names of
blocks of 1, 2, 4, ... words, which are equal only for equal blocks; the k-grams
are compared by hash, which can only let more survive.

Defined results: a null or empty text has no words and no runs; equal rows and
null ids are searched row by row; an empty table gives an empty result; other
columns are ignored.  A document is one row, and is held whole by its task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

LEAST, TIMES = 24, 3
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def gram_length(least: int = LEAST, times: int = TIMES) -> int:
    """The fewest words that a run and itself, one period on, have in common."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def repeated_grams(codes: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """True for words in a k-gram that its document has more than once; ``doc`` is sorted."""
    n = len(codes) - k + 1
    covered = np.zeros(len(codes), bool)
    if n <= 1:
        return covered
    # a k-gram is the sum of two overlapping blocks of a power of two
    size, h = 1, A.mix(codes.astype(np.uint64) + np.uint64(1))
    while 2 * size <= k:
        h = h[: len(h) - size] * np.uint64(A._BASES[1]) + A.mix(h[size:])
        size *= 2
    h = A.mix(h[:n] * np.uint64(A._BASES[0]) + A.mix(h[k - size : k - size + n] ^ A.mix(doc[:n].astype(np.uint64))))
    inside = doc[:n] == doc[k - 1 :]
    own = np.sort(h[inside])
    twice = np.unique(own[1:][own[1:] == own[:-1]])
    if not len(twice):
        return covered
    at = np.flatnonzero(inside & (twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h))
    step = np.zeros(len(codes) + 1, np.int32)
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return np.cumsum(step[:-1]) > 0


class Extensions:
    """Longest common extensions of places in an array, by names of its blocks of 2**j codes."""

    def __init__(self, codes: np.ndarray):
        self.n, self.names = len(codes), []
        names, size = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
        while True:
            # no block that would pass the end, nor the place behind it, equals another
            own = np.arange(self.n, 2 * self.n + 1, dtype=np.int64)
            own[: len(names)] = names
            self.names.append(own.astype(np.int32))
            if len(names) <= size or names.max(initial=0) + 1 == len(names):
                return
            names = np.unique(names[:-size] * np.int64(self.n + 1) + names[size:], return_inverse=True)[1].astype(np.int64)
            size *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes from a on equal those from b on; a < b."""
        a, b, start = a.copy(), b.copy(), a
        for j in reversed(range(len(self.names))):
            same = self.names[j][a] == self.names[j][b]
            a[same] += 1 << j
            b[same] += 1 << j
        return a - start

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes up to a equal those up to b; a < b, and a can be -1."""
        a, b, start = a.copy(), b.copy(), a
        for j in reversed(range(len(self.names))):
            x, y = a - (1 << j) + 1, b - (1 << j) + 1
            same = (x >= 0) & (self.names[j][np.maximum(x, 0)] == self.names[j][np.maximum(y, 0)])
            a[same] -= 1 << j
            b[same] -= 1 << j
        return start - a


def main_lorentz(codes: np.ndarray, first: np.ndarray, last: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, end, period) of the runs in the segments [first, last) of ``codes``, sorted.

    A code that no segment holds stands behind each.  Every run holds a multiple
    of the largest power of two that it reaches across; there at least one of
    its sides has a whole period.
    """
    ext, found = Extensions(codes), []
    segment = np.full(len(codes) + 1, -1, np.int64)
    for k, (a, b) in enumerate(zip(first, last)):
        segment[a:b] = k
    j = max(0, (least - 1).bit_length() - 1)  # a run of that length holds a multiple of 2**j besides its start
    while 1 << j < len(codes):
        m = np.arange(1 << j, len(codes), 2 << j, dtype=np.int64)
        m = m[(segment[m] >= 0) & (segment[m] == segment[m - 1])]
        most = np.minimum(2 << j, (last - first)[segment[m]]) // times
        at, q = np.repeat(m, most), np.arange(most.sum(), dtype=np.int64) - np.repeat(np.cumsum(most) - most, most) + 1
        lo, hi = first[segment[at]], last[segment[at]]
        left = np.flatnonzero((at - q >= lo) & (codes[np.maximum(at - q, 0)] == codes[at]))
        right = np.flatnonzero((at + q <= hi) & (codes[at - 1] == codes[np.minimum(at - 1 + q, len(codes) - 1)]))
        x, p = at[left], q[left]
        found.append(np.stack([x - p - ext.backward(x - p - 1, x - 1), x + ext.forward(x - p, x), p], 1))
        x, p = at[right], q[right]
        found.append(np.stack([x - ext.backward(x - 1, x - 1 + p), x + p + ext.forward(x, x + p), p], 1))
        found[-2:] = [f[f[:, 1] - f[:, 0] >= np.maximum(least, times * f[:, 2])] for f in found[-2:]]
        j += 1
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # of one stretch's periods the smallest
    return runs[A.group_starts(runs[:, 0], runs[:, 1])] if len(runs) else runs


def runs_of(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """For each document of words the rows (start, length, period) of its runs, by start and period."""
    table: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.r_[0, np.cumsum(sizes)]
    codes = np.fromiter((table[w] for d in docs for w in d), np.int64, starts[-1])
    doc = np.repeat(np.arange(len(docs)), sizes)
    covered = repeated_grams(codes, doc, gram_length(least, times))
    edge = np.flatnonzero(A.group_starts(covered, doc)) if len(codes) else np.zeros(0, np.int64)
    ends = np.r_[edge[1:], len(codes)]
    keep = covered[edge] & (ends - edge >= least) if len(edge) else np.zeros(0, bool)
    first, last = edge[keep], ends[keep]
    if not len(first):
        return [np.zeros((0, 3), np.int64)] * len(docs)
    # the segments behind each other, a code of its own behind each
    size = last - first
    to = np.cumsum(size + 1) - size - 1
    packed = np.empty(int(to[-1] + size[-1] + 1), np.int64)
    packed[to + size] = len(table) + np.arange(len(first))
    from_ = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    packed[np.repeat(to - (np.cumsum(size) - size), size) + np.arange(size.sum())] = codes[from_]
    runs = main_lorentz(packed, to, to + size, least, times)
    where = np.searchsorted(to, runs[:, 0], "right") - 1
    start = runs[:, 0] - to[where] + first[where]
    owner = doc[start] if len(start) else np.zeros(0, np.int64)
    rows = np.stack([start - starts[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], 1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
    return np.split(rows, np.searchsorted(np.sort(owner), np.arange(1, len(docs))))


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that stand in no run behind its first period."""
    if not len(runs):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def find_runs(docs: DataFrame, *, least: int = LEAST, times: int = TIMES, id_col: str = "doc_id", text_col: str = "text", rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """Returns doc_id, n_words, runs (by start, then period) and collapsed, the words left when each run is cut to its first period.

    A run is a stretch of words with smallest period q, at least ``least`` words
    and ``times`` q long, that no neighbouring word extends keeping q.
    ``rewrite`` changes a document's words before the search.
    """

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "text"):
                ids = batch.column(0).to_pylist()
                words = [(t or b"").split() for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids, words)]
                runs = runs_of(words, least, times)
                ends = np.r_[0, np.cumsum([len(r) for r in runs])].astype(np.int32)
                flat = np.concatenate(runs)
                spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(_RUNS.value_type)))
                left = [b" ".join(kept_words(w, r)) for w, r in zip(words, runs)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()), spans, pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
            A.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(fn, FOUND)
