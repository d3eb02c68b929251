"""Finding repeated windows in two passes, for any kind of window.

Pass 1 deals short keys to parts and keeps what can be repeated; pass 2 brings
those places to their documents' texts and deals the hashes of their windows; a
last step brings the repeated windows to the texts once more.  Everything moves
as arrays: (bucket, kind, data), with ``encode``d columns in ``data``.

Each slice first settles what it can by itself and sends one row for a key that
it holds more than once, so a key that fills a third of all rows arrives once
for each slice.  Parts grow in number with the bytes of all texts, so that each stays small.

Rows are told apart by id and 32 bits of a hash of the text.  Windows are equal if 48
and 64 bits of two hashes are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

KEYS, DONE, OPEN = 0, 1, 2
SCHEMA = "bucket int, kind int, data binary"
#: What is known about places of a document: id, first window, windows, check of the text.
PLACES = (np.int64, np.int32, np.int32, np.uint32)


def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "data"])


def keyed(key: np.ndarray, n: int, *cols: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows by part of the sorted keys; keys are sent as their differences, less 16 bits."""
    short, out = key >> A.U(16), []
    for b, (k, *rest) in A.split(A.bucket_of(key, n), short, *cols):
        out.append((b, KEYS, A.encode(np.diff(k, prepend=A.U(0)), *rest)))
    return out


def unkeyed(blobs: list[bytes], *types: type) -> list[np.ndarray]:
    """The rows of a part, sorted by key."""
    got = [A.decode(b, np.uint64, *types) for b in blobs]
    if not got:
        return [np.zeros(0, t) for t in (np.uint64, *types)]
    cols = [np.concatenate([np.cumsum(g[0], dtype=np.uint64) if i == 0 else g[i] for g in got]) for i in range(len(types) + 1)]
    order = np.argsort(cols[0], kind="stable")
    return [c[order] for c in cols]


def placed(kind: int, n: int, doc: np.ndarray, start: np.ndarray, many: np.ndarray, check: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Rows of places by their documents' parts; neighbouring windows become one place."""
    if not len(doc):
        return []
    part = A.id_bucket(doc, n)
    order = np.lexsort((start, check, doc, part))
    part, doc, start, many, check = part[order], doc[order], start[order].astype(np.int64), many[order].astype(np.int64), check[order]
    same = ~A.group_starts(doc, check)
    if not len(many) or many.max() == 1:  # single windows: joined where they follow each other
        new = ~(same & np.r_[False, np.diff(start) <= 1])
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(start)] - 1
        many = start[last] - start[first] + 1
        part, doc, start, check = part[first], doc[first], start[first], check[first]
    return [(b, kind, A.encode(d, s.astype(np.int32), m.astype(np.int32), c)) for b, (d, s, m, c) in A.split(part, doc, start, many, check)]


def of_kind(table: pa.Table, kind: int) -> list[bytes]:
    kinds = np.asarray(table["kind"]) if table.num_rows else np.zeros(0, int)
    return [x.as_py() for x, k in zip(table["data"], kinds) if k == kind]


def passed(table: pa.Table, kind: int) -> list[tuple[int, int, bytes]]:
    return [(b, k, d) for b, k, d in zip(table["bucket"].to_pylist(), table["kind"].to_pylist(), table["data"].to_pylist()) if k == kind]


class Places:
    """Places of documents, to be looked up by document."""

    def __init__(self, blobs: list[bytes]):
        got = [A.decode(b, *PLACES) for b in blobs]
        self.doc, self.start, self.many, self.check = [np.concatenate([g[i] for g in got]) if got else np.zeros(0, t) for i, t in enumerate(PLACES)]
        order = np.argsort(self.doc, kind="stable")
        self.doc, self.start, self.many, self.check = self.doc[order], self.start[order].astype(np.int64), self.many[order].astype(np.int64), self.check[order]

    def of(self, doc: np.ndarray, check: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first window, windows) of the rows with these ids and, if given, checks."""
        lo, hi = np.searchsorted(self.doc, doc, "left"), np.searchsorted(self.doc, doc, "right")
        many = hi - lo
        row = np.repeat(np.arange(len(doc)), many)
        at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + lo[row]
        if check is not None:
            fits = self.check[at] == check[row]
            row, at = row[fits], at[fits]
        return row, self.start[at], self.many[at]


def stretch(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges, and the range of each."""
    of = np.repeat(np.arange(len(first)), many)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of


def covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n items lie in some range [first, end)."""
    step = np.bincount(first, minlength=n + 1).astype(np.int64) - np.bincount(end, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def row_checks(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return (A.span_hashes(data, offs[:-1], offs[1:]) & A.U(0xFFFFFFFF)).astype(np.uint32)


def run(
    docs: DataFrame,
    local: Callable[[pa.RecordBatch, int], list],
    first: Callable[[pa.Table, int], list],
    windows: Callable[[pa.RecordBatch, Places, int], list],
    second: Callable[[pa.Table, int], list],
    apply: Callable[[pa.RecordBatch, Places], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """The whole search; ``docs`` is (doc_id, text)."""
    n = A.parts_for(docs, "text")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, "text"):
                yield batch(local(b, n))
            A.trim()

    def reduced(fn):
        def whole(table: pa.Table) -> pa.Table:
            out = pa.Table.from_batches([batch(fn(table, n))])
            A.trim()
            return out

        return whole

    def meet(places: pa.Table, texts: pa.Table) -> pa.Table:
        rows, known = passed(places, DONE), Places(of_kind(places, OPEN))
        for b in A.read_streams(x.as_py() for x in texts["data"]):
            rows += windows(b, known, n)
        A.trim()
        return pa.Table.from_batches([batch(rows)])

    def close(places: pa.Table, texts: pa.Table) -> pa.Table:
        known = Places(of_kind(places, DONE))
        return pa.Table.from_batches([apply(b, known) for b in A.read_streams(x.as_py() for x in texts["data"])])

    texts = A.text_exchange(docs, n)
    found = docs.select("doc_id", "text").mapInArrow(one, SCHEMA).groupBy("bucket").applyInArrow(reduced(first), SCHEMA)
    hashed = found.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(meet, SCHEMA)
    repeated = hashed.groupBy("bucket").applyInArrow(reduced(second), SCHEMA)
    return A.compact(repeated.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(close, schema))


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
