"""Packing whole documents into as few windows as can be, by patterns of few documents.

Only the histogram of lengths is needed to plan.  Patterns of one, two or three
lengths that fill a window exactly are listed; for each longest length at most
``WAYS`` middle ones, spread evenly.  How often each is used is fitted to the
histogram by non-negative least squares (accelerated projected gradients) and
rounded along the patterns of one longest length, so that these are used up.
What is left is packed by best fit, longest first, over windows grouped by their
room.  Steps and tables depend on the number of different lengths, at most
``capacity``, and not on the number of documents; those find their places by
their position among pieces of equal length.

Defined results: a null or empty text is one end id; a document longer than a
window is cut into whole windows and a last piece, no other is cut; equal rows
are packed once each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .ranking import ranked

CAPACITY, END_ID = 4096, 1
#: Middle lengths listed for each longest length.
WAYS = 16
#: Words whose ids a task remembers at a time.
REMEMBERED = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

Group = tuple[int, dict[int, int]]


def public_words() -> str:
    """The vocabulary whose ids are the result."""
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


#: Words of these characters alone are split and lowered here: their case, composition and class are the same in all Unicode versions.
_PLAIN = re.compile("[!-~\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u017f\u0410-\u044f\u2010-\u2027\u20ac\u3041-\u3093\u30a1-\u30f6\u4e00-\u9fa5\uac00-\ud7a3]*")
# fixed value: how the vocabulary splits words, for plain characters
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def byte_names() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes are themselves, the others follow from 256 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case and drops blanks; each different word is encoded once.

    Texts are split at ASCII blanks.  Plain words are parted here and go to the
    tokenizer's model, others to the tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.names = self.tokenizer.model.tokenize, byte_names()
        with open(vocabulary, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        if part not in self.parts:
            ids = [t.id for t in self.model(part.encode().decode("latin-1").translate(self.names))]
            self.parts[part] = np.array(ids, "<u4").tobytes()
        return self.parts[part]

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join([self.part(p) for p in _PARTS.findall(text.lower())])
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit values."""
        for text in texts:
            words = (text or b"").split()
            if len(self.known) + len(self.parts) > REMEMBERED:
                self.known, self.parts = {}, {}
            try:
                yield b"".join([self.known[w] for w in words])
            except KeyError:
                for w in words:
                    if w not in self.known:
                        self.known[w] = self.word(w)
                yield b"".join([self.known[w] for w in words])


def cut(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", vocabulary: Callable[[], str] = public_words) -> DataFrame:
    """One row for each piece: a document's ids and the end id, in windows where they are longer than one."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = WordEncoder(vocabulary()), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in A.slices(whole, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).cast(pa.large_binary()).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        rows.append((doc, k, k * capacity, len(piece) // 4, zlib.crc32(piece)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])
            A.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(fn, PIECES)


def patterns(have: np.ndarray, ways: int = WAYS) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths that fill a window exactly, longest first; unused places are 0.

    ``have[n]`` is how many pieces have length n; the last length is the capacity.
    """
    capacity, rows = len(have) - 1, []
    lengths = np.flatnonzero(have)
    for a in lengths[::-1].tolist():
        rest = capacity - a
        if rest == 0:
            rows.append([(a, 0, 0)])
            continue
        if rest <= a and have[rest] >= 1 + (rest == a):
            rows.append([(a, rest, 0)])
        b = lengths[np.searchsorted(lengths, (rest + 1) // 2) : np.searchsorted(lengths, min(a, rest - 1), "right")]
        c = rest - b
        # as many of each as the pattern holds
        b = b[(have[c] >= 1 + (c == b) + ((c == b) & (b == a))) & (have[b] >= 1 + (b == a))]
        if len(b) > ways:
            b = b[np.linspace(0, len(b) - 1, ways).astype(np.int64)]
        rows.append(np.stack([np.full(len(b), a), b, rest - b], 1))
    rows = [np.asarray(r, np.int64).reshape(-1, 3) for r in rows]
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def fitted(rows: np.ndarray, have: np.ndarray, steps: int = 400) -> np.ndarray:
    """How often each pattern is to be used: least squares over lengths, none below zero.

    A miss counts by the piece's share of a window, since long pieces are the hard ones to place later.
    """
    capacity, target = len(have) - 1, have.astype(np.float64)
    weight = np.arange(capacity + 1) / capacity
    weight[0] = 0.0
    flat = rows.ravel()
    uses = lambda x: np.bincount(flat, np.repeat(x, 3), capacity + 1)
    # A'WA has no entry below zero: the diagonal of its rows' sums bounds it, one step length for each pattern
    bound = np.maximum((weight * uses(np.ones(len(rows))))[rows].sum(1), 1e-9)
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        slope = (weight * (uses(y) - target))[rows].sum(1)
        new = np.maximum(y - slope / bound, 0.0)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / after * (new - x), new, after
    return x


def rounded(rows: np.ndarray, x: np.ndarray, have: np.ndarray) -> tuple[list[Group], np.ndarray]:
    """Whole numbers near x that the histogram has pieces for, as groups of equal windows, and the pieces left.

    Each is what the running sum over the patterns passes of whole numbers.
    """
    left, out = have.copy(), []
    ends = np.floor(np.cumsum(x) + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.diff(ends, prepend=0)).tolist():
        lengths, many = np.unique(rows[k][rows[k] > 0], return_counts=True)
        times = int(min(ends[k] - (ends[k - 1] if k else 0), (left[lengths] // many).min()))
        if times > 0:
            left[lengths] -= times * many
            out.append((times, dict(zip(lengths.tolist(), many.tolist()))))
    return out, left


def best_fit(have: np.ndarray) -> list[Group]:
    """Pieces longest first, each into the fullest window with room for it; windows that hold the same are one group."""
    capacity = len(have) - 1
    by_room: dict[int, list[tuple[int, tuple]]] = {}
    rooms, out = 0, []  # one bit for each room that some window has

    def keep(times: int, room: int, content: tuple) -> None:
        nonlocal rooms
        if times and not room:
            out.append((times, content))
        elif times:
            by_room.setdefault(room, []).append((times, content))
            rooms |= 1 << room

    for length in np.flatnonzero(have)[::-1].tolist():
        left = int(have[length])
        while left:
            if fits := rooms >> length:
                room = length + (fits & -fits).bit_length() - 1
                times, content = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, content = capacity, ()
                times = max(1, left // (capacity // length))
            most = room // length
            full = min(times, left // most)
            keep(full, room - most * length, (content, length, most))
            left -= full * most
            if full < times and left:  # fewer are left than one window takes
                keep(1, room - left * length, (content, length, left))
                full, left = full + 1, 0
            keep(times - full, room, content)
    out += [g for groups in by_room.values() for g in groups]
    groups = []
    for times, content in out:
        holds: dict[int, int] = {}
        while content:
            content, length, many = content
            holds[length] = holds.get(length, 0) + many
        groups.append((times, holds))
    return groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY, ways: int = WAYS) -> list[Group]:
    """(how many windows, what each holds) until every piece is placed."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        have[length] = n
    rows = patterns(have, ways)
    first, left = rounded(rows, fitted(rows, have), have)
    return first + best_fit(left)


def places(groups: list[Group]) -> np.ndarray:
    """Rows (length, first position, first window, how many in a window, offset), sorted."""
    rows, seen, window = [], {}, 0
    for times, holds in groups:
        offset = 0
        for length, many in sorted(holds.items(), reverse=True):
            rows.append((length, seen.get(length, 0), window, many, offset))
            seen[length] = seen.get(length, 0) + times * many
            offset += length * many
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, ways: int = WAYS, **how) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = A.checkpointed(A.compact(cut(docs, capacity=capacity, **how)))
    # at most ``capacity`` rows
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table, total = places(plan(histogram, capacity, ways)), sum(histogram.values())
    numbered = ranked(pieces, ["length"], [], F.concat_ws(":", "doc_id", "piece", "ids_crc32"), ["doc_id", "piece", "ids_crc32"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table[:, 0] * (total + 1) + table[:, 1]
        for b in batches:
            length, rank = A.ids(b.column(3)), A.ids(b.column(5)) - 1
            row = table[np.searchsorted(keys, length * (total + 1) + rank, "right") - 1]
            k = rank - row[:, 1]
            arrays = [*b.columns[:5], pa.array(row[:, 2] + k // row[:, 3]), pa.array(row[:, 4] + k % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return A.compact(numbered).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(fn, PIECES + ", sequence_id long, offset long")
