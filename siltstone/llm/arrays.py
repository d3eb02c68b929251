"""Vectorised helpers over Arrow string columns, and a compact exchange of arrays.

Texts are handled as one byte buffer per slice, so that words, hashes and
windows are computed by numpy for many documents at once.  ``encode`` and
``decode`` turn parallel arrays into one binary value whose bytes lie in
planes (all low bytes together), which Spark's block compression shrinks well.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
NULL_ID = np.iinfo(np.int64).max

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    return _scramble(x.astype(U, copy=True))


def _scramble(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_TABLE = mix((np.arange(256, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15))
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 16), base, U)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def trim() -> None:
    """Gives freed memory back to the system: workers are kept between tasks."""
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def visible(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (env.get("PYTHONPATH") or "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints: the session's; a temporary one only where all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir names no folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="siltstone-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Written as Parquet in the shared folder, and read again; with the path, for ``dropped``."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """A stored table that nothing reads any more is deleted."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def buckets(spark: SparkSession, at_least: int = 8) -> int:
    """How many parts an exchange has: the session's shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bytes of text in a part that a task holds whole.
PART_BYTES = 64 << 20


def parts_for(docs: DataFrame, text_col: str) -> int:
    """Parts of at most about ``PART_BYTES`` of text, and no fewer than ``buckets``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(buckets(docs.sparkSession), -(-size // PART_BYTES))


def compact(df: DataFrame) -> DataFrame:
    """Narrow results in few files, whatever dealt them out before: a partition for each core.

    Where cores are still to come (dynamic allocation), the shuffle partitions tell the size of the job.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, buckets(df.sparkSession) // 32))


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text; a longer text is alone."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pc.binary_length(col).fill_null(0)).astype(np.int64)
    ends = np.cumsum(size)
    at, n = 0, len(size)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the n + 1 offsets of the rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def ids(col: pa.Array) -> np.ndarray:
    """64-bit ids; null becomes the largest value."""
    return np.asarray(col.cast(pa.int64()).fill_null(NULL_ID)).astype(np.int64)


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes, which never cross rows,
    and for each row the number of the first run at or after it (n + 1 values)."""
    n = len(data)
    word = ~_WS[data] if inside is None else inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], after[-1] = True, True
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
    start = np.flatnonzero(word & (before | edge[:-1]))
    end = np.flatnonzero(word & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes; ``which`` of two independent ones."""
    base = _BASES[which]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * _powers(base, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(pow(base, -1, 1 << 64), len(data) + 1)[start] + (end - start).astype(U))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The same for every ``width`` consecutive bytes, in place."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    base = _BASES[0]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * _powers(base, len(data)), out=sums[1:])
    out = sums[width:] - sums[:-width]
    out *= _powers(pow(base, -1, 1 << 64), len(data) + 1)[:n]
    out += U(width)
    return _scramble(out)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def encode(*cols: np.ndarray) -> bytes:
    """Parallel arrays as one binary value, byte planes apart."""
    n = len(cols[0])
    return n.to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T.tobytes() for c in cols if n)


def decode(blob: bytes, *types: type) -> list[np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 8, []
    for t in types:
        width = np.dtype(t).itemsize
        planes = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t) if n else np.zeros(0, t))
        at += n * width
    return out


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """The part of 64-bit keys; rising keys have rising parts."""
    return ((key >> U(32)) * U(n) >> U(32)).astype(np.int64)


def id_bucket(doc: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(doc.view(U) if doc.dtype == np.int64 else doc), n)


def split(part: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows by part; ``part`` is sorted."""
    if len(part):
        cut = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(part)]):
            yield int(part[a]), [c[a:b] for c in cols]


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = keys[0][1:] != keys[0][:-1]
        for k in keys[1:]:
            new[1:] |= k[1:] != k[:-1]
    return new


def blob_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def text_exchange(docs, n: int, columns: tuple[str, ...] = ("doc_id", "text")):
    """Rows of ``docs`` as compressed Arrow streams in n parts by the first column.

    Returns (bucket, data); ``read_streams`` gives the record batches back.
    """

    def fn(batches):
        for whole in batches:
            for batch in slices(whole, columns[1]):
                part = id_bucket(ids(batch.column(0)), n)
                order = np.argsort(part, kind="stable")
                rows = []
                for b, (pick,) in split(part[order], order):
                    sink = pa.BufferOutputStream()
                    took = batch.take(pa.array(pick))
                    with pa.ipc.new_stream(sink, took.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(took)
                    rows.append((b, sink.getvalue().to_pybytes()))
                yield blob_batch(rows)

    return docs.select(*columns).mapInArrow(fn, "bucket int, data binary")


def read_streams(blobs: Iterable[bytes], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the streams, in batches of about ``most`` bytes."""
    got, size = [], 0
    for blob in blobs:
        with pa.ipc.open_stream(blob) as r:
            for b in r:
                got.append(b)
                size += b.nbytes
        if size >= most:
            yield from pa.Table.from_batches(got).combine_chunks().to_batches()
            got, size = [], 0
    if got:
        yield from pa.Table.from_batches(got).combine_chunks().to_batches()
