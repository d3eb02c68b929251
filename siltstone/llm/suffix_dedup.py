"""Removal of repeated 200-byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered only through their first 200 bytes, most significant digit
first, and a group that has one member leaves the sort at once.

The first digit of a suffix is the least hash of the 64-byte strings within its
200 bytes: a function of those bytes, so equal suffixes share it.  Consecutive
suffixes mostly share it too, through the same place in the text, and travel as
one run; no two suffixes of a run are equal.  The second digit is the content of
the whole run: runs with equal content are equal suffix by suffix.  The third
digit, for runs that share the first but not the second, is the hash of each
suffix's 200 bytes.  Groups of equal digits are the repeated windows.

(All suffixes of a text with their positions are many times the text; a run
stands for 69 suffixes on average.)

Defined results: a null text is empty; texts below 200 bytes stay; matches never
cross documents and equal rows repeat each other, equal ids or not; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from . import repeats as R

DEPTH, GRAM = 200, 64
REACH = DEPTH - GRAM + 1

#: What runs of a slice say of themselves.
ALONE, TWICE, MIXED = 0, 1, 2


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    m, w = h, 1
    while 2 * w <= width:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return m if w == width else np.minimum(m[: len(h) - width + 1], m[width - w : width - w + len(h) - width + 1])


def first_digits(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of suffixes: first byte, number of suffixes, first digit, row."""
    n, none = len(data), np.zeros(0, np.int64)
    if n < DEPTH:
        return none, none, none.astype(A.U), none
    size = np.diff(offs)
    rows = np.flatnonzero(size >= DEPTH)
    valid = R.covered(offs[rows], offs[rows] + size[rows] - DEPTH + 1, n)[: n - DEPTH + 1]
    grams = A.window_hashes(data, GRAM)
    least = _least(grams, REACH)
    new = valid.copy()
    # a run ends where the digit changes and where its place falls out of reach
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    start = np.flatnonzero(new)
    row = np.searchsorted(offs, start, "right") - 1
    last = np.minimum(np.r_[start[1:], n], offs[row + 1] - DEPTH + 1)
    # least values lie close to 0; scrambled, they fill all parts alike
    return start, last - start, A.mix(least[start]), row


def runs(batch: pa.RecordBatch, n: int) -> list:
    data, offs = A.text_bytes(batch.column(1))
    start, many, digit, row = first_digits(data, offs)
    content = A.span_hashes(data, start, start + many - 1 + DEPTH)
    check = R.row_checks(data, offs)[row]
    order = np.lexsort((content, digit))
    start, many, digit, row, content, check = start[order], many[order], digit[order], row[order], content[order], check[order]
    doc, at = A.ids(batch.column(0))[row], (start - offs[row]).astype(np.int32)
    return settle(digit, content, doc, at, many.astype(np.uint8), check, np.zeros(len(digit), np.uint8), n, True)


def settle(digit, content, doc, at, many, check, state, n: int, send: bool) -> list:
    """Of runs sorted by both digits: repeated ones, ones to compare, and one for each first digit to send on."""
    if not len(digit):
        return []
    new = A.group_starts(digit, content)
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    twice = np.diff(np.r_[begin, len(digit)]) > 1
    twice |= np.maximum.reduceat(state == TWICE, begin)
    outer = A.group_starts(digit)
    top, head = np.cumsum(outer) - 1, np.flatnonzero(outer)
    kinds = np.add.reduceat(new.astype(np.int64), head)
    mixed = (kinds > 1) | np.maximum.reduceat(state == MIXED, head)
    known = twice[group]
    out = R.placed(R.DONE, n, doc[known], at[known], many[known], check[known])
    # one of each content stands for the rest
    ask = mixed[top] & (new if send else new & (state != MIXED))
    out += R.placed(R.OPEN, n, doc[ask], at[ask], many[ask], check[ask])
    if send:
        says = np.where(mixed, MIXED, np.where(twice[group[head]], TWICE, ALONE)).astype(np.uint8)
        out += R.keyed(digit[head], n, content[head], doc[head], at[head], many[head], check[head], says)
    return out


def match_runs(table: pa.Table, n: int) -> list:
    cols = R.unkeyed(R.of_kind(table, R.KEYS), np.uint64, np.int64, np.int32, np.uint8, np.uint32, np.uint8)
    order = np.lexsort((cols[1], cols[0]))
    return R.passed(table, R.DONE) + R.passed(table, R.OPEN) + settle(*[c[order] for c in cols], n, False)


def suffixes(batch: pa.RecordBatch, places: R.Places, n: int) -> list:
    """The third digit of the suffixes that are still to compare."""
    data, offs = A.text_bytes(batch.column(1))
    doc = A.ids(batch.column(0))
    checks = R.row_checks(data, offs)
    row, at, many = places.of(doc, checks)
    if not len(row):
        return []
    p, of = R.stretch(offs[row] + at, many)
    p, pick = np.unique(p, return_index=True)
    row = row[of[pick]]
    key, other = A.span_hashes(data, p, p + DEPTH), A.span_hashes(data, p, p + DEPTH, 1)
    order = np.lexsort((other, key))
    key, other, row, p = key[order], other[order], row[order], p[order]
    return repeated(key, other, doc[row], (p - offs[row]).astype(np.int32), checks[row], n, True)


def repeated(key, other, doc, pos, check, n: int, send: bool) -> list:
    if not len(key):
        return []
    new = A.group_starts(key, other)
    group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    twice = (np.diff(np.r_[begin, len(key)]) > 1)[group]
    out = R.placed(R.DONE, n, doc[twice], pos[twice], np.ones(int(twice.sum()), np.int32), check[twice])
    return out + R.keyed(key[new], n, other[new], doc[new], pos[new], check[new]) if send else out


def match_suffixes(table: pa.Table, n: int) -> list:
    key, other, doc, pos, check = R.unkeyed(R.of_kind(table, R.KEYS), np.uint64, np.int64, np.int32, np.uint32)
    order = np.lexsort((other, key))
    return R.passed(table, R.DONE) + repeated(key[order], other[order], doc[order], pos[order], check[order], n, False)


def kept_bytes(batch: pa.RecordBatch, places: R.Places) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bytes, removed bytes, removed runs and the remaining bytes of each row."""
    data, offs = A.text_bytes(batch.column(1))
    row, at, many = places.of(A.ids(batch.column(0)), R.row_checks(data, offs))
    a = offs[row] + at
    gone = R.covered(a, a + many - 1 + DEPTH, len(data))
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    begins = gone & (edge[:-1] | np.r_[True, ~gone[:-1]]) if len(data) else gone
    of = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    count = lambda x: np.bincount(of[x], minlength=len(offs) - 1)
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~gone, out=to[1:])
    flat = data[~gone].tobytes()
    return np.diff(offs), count(gone), count(begins), [flat[i:j] for i, j in zip(to[offs[:-1]].tolist(), to[offs[1:]].tolist())]


def dedup(docs: DataFrame, *, with_bytes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""

    def apply(batch: pa.RecordBatch, places: R.Places) -> pa.RecordBatch:
        size, gone, spans, kept = kept_bytes(batch, places)
        cols = [batch.column(0), *[pa.array(x.astype(np.int64)) for x in (size, gone, spans)], pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_bytes:
            cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
        return pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return R.run(R.narrowed(docs, id_col, text_col), runs, match_runs, suffixes, match_suffixes, apply, schema)
