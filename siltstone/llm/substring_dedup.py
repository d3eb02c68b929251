"""Removal of word sequences that an earlier document has, by difference-cover anchors.

Of every seven consecutive words, three start an anchor: those at positions 0,
1 and 3 modulo 7, a set whose differences are all of 0 to 6.  Two equal windows
of 13 words, wherever they start, therefore share an anchor of 7 words at the
same distance from their starts.  Anchors that two documents share are found
first; around them the windows are extended to 13 words, hashed whole, and kept
where a document with a smaller id has the same.

Defined results: a null text has no words; a null id counts as larger than all
others; rows with equal ids do not remove each other's words; a text shorter
than a window stays; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from . import repeats as R

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
GRAM = WINDOW - PERIOD + 1
_FACTORS = A.mix(np.arange(1, 2 * WINDOW + 1, dtype=A.U)) | A.U(1)


def _grams(h: np.ndarray, at: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hashes of the k words from each place on."""
    out = np.zeros(len(at), A.U)
    for j in range(k):
        out += h[at + j] * _FACTORS[which * WINDOW + j]
    return A.mix(out)


def anchors(batch: pa.RecordBatch, n: int) -> list:
    """Anchors of a slice by part; those that its documents share are settled here."""
    data, offs = A.text_bytes(batch.column(1))
    start, end, first = A.spans(data, offs)
    row, doc = A.rows_of(first), A.ids(batch.column(0))
    pos = np.arange(len(row)) - first[row]
    left = first[1:][row] - np.arange(len(row))
    long = (np.diff(first) >= WINDOW)[row]
    at = np.flatnonzero(np.isin(pos % PERIOD, COVER) & (left >= GRAM) & long)
    key = _grams(A.span_hashes(data, start, end), at, GRAM)
    order = np.argsort(key)
    key, at = key[order], at[order]
    return _shared(key, doc[row[at]], pos[at].astype(np.int32), n, True)


def _shared(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: int, send: bool) -> list:
    """Of sorted keys: places whose key another document has; others are sent on, or end here."""
    if not len(key):
        return []
    new = A.group_starts(key)
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    low, high = np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin)
    both = (low != high)[group]
    ones = np.ones(int(both.sum()), np.int32)
    out = R.placed(R.OPEN, n, doc[both], pos[both], ones, np.zeros(len(ones), np.uint32))
    if send:
        # of a shared key, the places of the smallest and of the largest id stand for all in this slice:
        # with both, other texts under one of these ids are looked at as well
        stays, many = ~both, np.flatnonzero(both)
        many = many[np.lexsort((doc[many], group[many]))]
        new = A.group_starts(group[many])
        stays[many[new | np.r_[new[1:], True][: len(many)]]] = True
        out += R.keyed(key[stays], n, doc[stays], pos[stays])
    return out


def match_anchors(table: pa.Table, n: int) -> list:
    key, doc, pos = R.unkeyed(R.of_kind(table, R.KEYS), np.int64, np.int32)
    return R.passed(table, R.OPEN) + _shared(key, doc, pos, n, False)


def extend(batch: pa.RecordBatch, places: R.Places, n: int) -> list:
    """Whole windows around shared anchors; later ones of the slice are settled here."""
    data, offs = A.text_bytes(batch.column(1))
    doc = A.ids(batch.column(0))
    at_row, pos, many = places.of(doc, None)
    if not len(at_row):
        return []
    start, end, first = A.spans(data, offs)
    lo = np.maximum(first[at_row] + pos - (PERIOD - 1), first[at_row])
    hi = np.minimum(first[at_row] + pos + many - 1, first[1:][at_row] - WINDOW)
    fits = lo <= hi
    w = np.flatnonzero(R.covered(lo[fits], hi[fits] + 1, len(start)))
    h = A.span_hashes(data, start, end)
    key, other = _grams(h, w, WINDOW), _grams(h, w, WINDOW, 1)
    row = A.rows_of(first)[w]
    order = np.lexsort((doc[row], other, key))
    key, other, row, w = key[order], other[order], row[order], w[order]
    return _later(key, other, doc[row], (w - first[row]).astype(np.int32), R.row_checks(data, offs)[row], n, True)


def _later(key, other, doc, pos, check, n: int, send: bool) -> list:
    """Of windows sorted by key and document: those that a smaller id has; the first ones are sent on."""
    if not len(key):
        return []
    new = A.group_starts(key, other)
    low = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = doc > low
    out = R.placed(R.DONE, n, doc[later], pos[later], np.ones(int(later.sum()), np.int32), check[later])
    return out + R.keyed(key[~later], n, other[~later], doc[~later], pos[~later], check[~later]) if send else out


def match_windows(table: pa.Table, n: int) -> list:
    key, other, doc, pos, check = R.unkeyed(R.of_kind(table, R.KEYS), np.uint64, np.int64, np.int32, np.uint32)
    order = np.lexsort((doc, other, key))
    return R.passed(table, R.DONE) + _later(key[order], other[order], doc[order], pos[order], check[order], n, False)


def kept_words(batch: pa.RecordBatch, places: R.Places) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words, removed words, and the kept words joined by one space, of each row."""
    data, offs = A.text_bytes(batch.column(1))
    start, end, first = A.spans(data, offs)
    row, pos, many = places.of(A.ids(batch.column(0)), R.row_checks(data, offs))
    a = first[row] + pos
    gone = R.covered(a, a + many - 1 + WINDOW, len(start))
    of = A.rows_of(first)
    kept = ~gone
    bytes_kept = R.covered(start[kept], end[kept], len(data))
    space = end[kept][end[kept] < offs[1:][of[kept]]]
    flat = data.copy()
    flat[space] = 32
    bytes_kept[space] = True
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(bytes_kept, out=to[1:])
    flat = flat[bytes_kept].tobytes()
    texts = [flat[i:j] for i, j in zip(to[offs[:-1]].tolist(), to[offs[1:]].tolist())]
    return np.diff(first), np.bincount(of[gone], minlength=len(offs) - 1), [t.removesuffix(b" ") for t in texts]


def dedup(docs: DataFrame, *, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as text."""

    def apply(batch: pa.RecordBatch, places: R.Places) -> pa.RecordBatch:
        words, gone, kept = kept_words(batch, places)
        cols = [batch.column(0), pa.array(words.astype(np.int64)), pa.array(gone.astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            cols, names = [*cols, pa.array([t.decode() for t in kept], pa.string())], [*names, "text"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return R.run(R.narrowed(docs, id_col, text_col), anchors, match_anchors, extend, match_windows, apply, schema)
