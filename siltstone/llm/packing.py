"""Packing documents into fixed windows by minimum bin slack.

A document's ids are cut into whole windows and a remainder.  How many
remainders have each length is all that packing needs: for each window the
longest remaining length is taken and a subset-sum over the remaining multiset
(one bit for each reachable sum) finds the lengths that fill the rest closest
to capacity; counts are read back from the steps' bit sets.  A filling is used
as often as its lengths last, so the number of fillings depends on the number
of different lengths and not on the number of documents.  The table of fillings
has at most a few entries for each length, so it goes to every task; documents
find their place by their position among those of equal length.

Defined results: a null or empty text is one end id; equal rows are packed once
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .ranking import ranked

CAPACITY = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def load_tokenizer(ranks_file: str, pattern: str):
    """A byte-level BPE from its ranks; to itself, strings of special tokens are ordinary text."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def public_ranks() -> tuple[str, str]:
    """The ranks of ``byte_bpe_50k.json``, which give the same ids several times faster."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def public_json() -> str:
    """The vocabulary whose ids are the result."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


#: Characters from which texts are searched for long runs; tiktoken fails on about a million blanks.
LONG_RUN = 100_000
_RUN = re.compile(rf"\s{{{LONG_RUN}}}")


class Encoder:
    """The ids that the vocabulary in ``whole`` gives, by ranks where they can be used.

    Texts are cut at the vocabulary's added tokens, which are one id each.  Texts
    with a long run of blanks go to the tokenizers library.
    """

    def __init__(self, ranks_file: str, pattern: str, whole: str):
        self.ranks, self.whole, self.slow = load_tokenizer(ranks_file, pattern), whole, None
        with open(whole, encoding="utf-8") as f:
            self.added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.cuts = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    def encode(self, text: str) -> list[int]:
        if len(text) >= LONG_RUN and _RUN.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.whole)
            return self.slow.encode(text, add_special_tokens=False).ids
        if not any(t in text for t in self.added):
            return self.ranks.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(self.cuts.split(text)):
            out += [self.added[part]] if k % 2 else self.ranks.encode_ordinary(part)
        return out


def cut(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", tokenizer=public_ranks, vocabulary=public_json) -> DataFrame:
    """One row for each piece: whole windows, then the remainder."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(*tokenizer(), vocabulary())
        for whole in batches:
            for batch in A.slices(whole, "text"):
                rows: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    got = np.array([*enc.encode(text or ""), end_id], dtype="<u4")
                    for at in range(0, len(got), capacity):
                        piece = got[at : at + capacity]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), len(got)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fn, PIECES)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset within ``counts`` whose sum is the largest not above ``room``.

    One bit stands for each sum.  Lengths are added largest first, each as often
    as it is there and fits, doubling the number added at once; the walk ends
    early when ``room`` itself is reached, and goes back step by step.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many, the sums before
    for length in sorted((n for n in counts if n <= room and counts[n] > 0), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left:
            many = min(many, left)
            new = reach | (reach << (length * many)) & mask
            if new != reach:
                steps.append((length, many, reach))
                reach = new
            left -= many
            many *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + many
            at -= length * many
    return used


def padding(filled: list[tuple[int, dict[int, int]]], capacity: int) -> int:
    """Tokens that pad the windows; one of a power of two is not padded."""
    out = 0
    for times, used in filled:
        total = sum(n * c for n, c in used.items())
        out += times * (capacity - total) if total & (total - 1) else 0
    return out


def beside(top: int, rest: dict[int, int], capacity: int, powers: bool) -> dict[int, int]:
    """What is put beside ``top``: as close to capacity as can be; with ``powers``, where
    that leaves room, a filling of exactly a smaller power of two if there is one."""
    used = best_fill(rest, capacity - top)
    total = top + sum(n * c for n, c in used.items())
    if powers and total < capacity and total & (total - 1):
        power = 1 << (capacity - 1).bit_length() - 1
        while power >= top:
            exact = best_fill(rest, power - top)
            if top + sum(n * c for n, c in exact.items()) == power:
                return exact
            power //= 2
    return used


def fillings(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(how many windows, what each holds) until every length is used up: with or
    without smaller powers of two, whichever pads less."""
    ways = []
    for powers in (False, True):
        left, out = {n: c for n, c in histogram.items() if c > 0}, []
        while left:
            top = max(left)
            rest = dict(left)
            rest[top] -= 1
            used = beside(top, rest, capacity, powers)
            used[top] = used.get(top, 0) + 1
            times = min(left[n] // c for n, c in used.items())
            out.append((times, used))
            for n, c in used.items():
                left[n] -= times * c
                if not left[n]:
                    del left[n]
        ways.append(out)
    return min(ways, key=lambda w: padding(w, capacity))


def places(filled: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first position, first window, how many in a window, offset), sorted."""
    rows, seen, window = [], {}, 0
    for times, used in filled:
        offset = 0
        for length in sorted(used, reverse=True):
            many = used[length]
            rows.append((length, seen.get(length, 0), window, many, offset))
            seen[length] = seen.get(length, 0) + times * many
            offset += length * many
        window += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, **how) -> DataFrame:
    """Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = A.checkpointed(A.compact(cut(docs, capacity=capacity, **how)))
    # at most ``capacity`` rows
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    table = places(fillings(histogram, capacity))
    spread = F.concat_ws(":", "doc_id", "start", "ids_crc32")
    numbered = ranked(pieces, ["length"], [], spread, ["doc_id", "start", "ids_crc32"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # positions of one length lie below those of the next
        top = int(table[:, 1].max(initial=0)) + sum(histogram.values()) + 1
        keys = table[:, 0] * top + table[:, 1] if len(table) else np.zeros(0, np.int64)
        for b in batches:
            length, rank = A.ids(b.column(2)), A.ids(b.column(5)) - 1
            row = table[np.searchsorted(keys, length * top + rank, "right") - 1]
            k = rank - row[:, 1]
            seq, off = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return A.compact(numbered).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(fn, PIECES + ", sequence_id long, offset long")
