"""Quality rules by distribution divergence.

Each document has a histogram of character classes and one of common words.
A language's common words are its most frequent ones, counted over all documents.
Its references are the sums of the histograms over all its documents that pass the
base rules.  A document fails when either histogram is
further from its language's reference, by Jensen-Shannon distance (base 2, 0 to
1), than a limit; documents with few words, and languages whose reference holds
few words, are not judged by it.

Defined results: a null text has no words and fails the base rules; a null
language is a language of its own; a document of a language without a reference
keeps the base verdict; equal rows are judged alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A

#: Words of a language that count as common: its most frequent ones.
COMMON = 30
#: Languages up to which their table is broadcast.
MOST_SENT = 2000
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
CLASSES = ("lower", "upper", "digit", "white", "punctuation", "symbol", "wide")

_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 6
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[list(PUNCTUATION)] = 4
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _totals(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of rows: which equal an earlier one of their row, which have an equal in it."""
    key = A.mix(h ^ A.mix(row.astype(A.U) + A.U(1)))
    order = np.argsort(key, kind="stable")
    new = A.group_starts(key[order])
    later, shared = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = ~new
    shared[order] = ~new | np.r_[~new[1:], False] if len(new) else new
    return later, shared


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased runs of letters and digits, and the first one of each text (n + 1 values)."""
    data, offs = A.text_bytes(texts)
    low = _LOWER[data]
    s, e, first = A.spans(low, offs, _TOKEN)
    return A.span_hashes(low, s, e), first


def lang_codes(lang: pa.Array) -> tuple[list, np.ndarray]:
    """The languages of a slice, null last, and each row's place in them."""
    coded = lang.dictionary_encode()
    return [*coded.dictionary.to_pylist(), None], np.asarray(coded.indices.fill_null(len(coded.dictionary)))


def common_words(docs: DataFrame, most: int = COMMON) -> DataFrame:
    """(lang, words): hashes of each language's most frequent tokens over all documents, the most frequent first."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "text"):
                names, code = lang_codes(batch.column(0))
                h, first = tokens(batch.column(1))
                of = code[A.rows_of(first)]
                order = np.lexsort((h, of))
                h, of = h[order], of[order]
                begin = np.flatnonzero(A.group_starts(of, h)) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(of[begin])), pa.array(h[begin].view(np.int64)), pa.array(np.diff(np.r_[begin, len(h)]))], ["lang", "token", "n"])

    seen = docs.select("lang", "text").mapInArrow(fn, "lang string, token long, n long").groupBy("lang", "token").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "token"))
    top = seen.withColumn("at", place).where(F.col("at") <= most)
    return top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("words"))


def measure(texts: pa.Array, code: np.ndarray, common: list[np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Counts of each text, and its histograms of classes and of the common words of its language (the last column: others).

    ``common`` has the words of each language, ``code`` the language of each text.
    """
    data, offs = A.text_bytes(texts)
    n = len(offs) - 1
    start, end, first = A.spans(data, offs)
    row = A.rows_of(first)
    point = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(first), "word_chars": _totals(point & ~A._WS[data], offs), "n_symbols": _totals(_SYMBOL[data], offs)}
    # lines that hold a word
    edges = np.union1d(offs[:-1], np.flatnonzero(data == 10) + 1) if len(data) else np.zeros(0, np.int64)
    a = edges[edges < len(data)]
    b = np.r_[a[1:], len(data)] if len(a) else a
    b = np.where(data[b - 1] == 10, b - 1, b) if len(a) else b
    held = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[held], b[held]
    line_row = np.searchsorted(offs, a, "right") - 1
    later, _ = _repeats(line_row, A.span_hashes(data, a, b))
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    # words in 3-word windows that occur again
    h = A.span_hashes(data, start, end)
    at = np.flatnonzero(row[:-2] == row[2:]) if len(row) > 2 else np.zeros(0, np.int64)
    _, shared = _repeats(row[at], h[at] * A.U(3) + h[at + 1] * A.U(0x9E3779B97F4A7C15) + h[at + 2] * A.U(0xC2B2AE3D27D4EB4F))
    covered = np.zeros(len(row) + 3, bool)
    for k in range(3):
        covered[at[shared] + k] = True
    out["n_repeat_words"] = np.bincount(row[covered[: len(row)]], minlength=n)
    byte_row = np.repeat(np.arange(n), np.diff(offs))
    classes = np.bincount(byte_row[point] * len(CLASSES) + _CLASS[data[point]], minlength=n * len(CLASSES)).reshape(n, -1)
    th, f = tokens(texts)
    of, width = A.rows_of(f), COMMON + 1
    word = np.full(len(th), COMMON)
    for c, known in enumerate(common):
        if len(known):
            order = np.argsort(known)
            mine = np.flatnonzero(code[of] == c)
            k = order[np.minimum(np.searchsorted(known, th[mine], sorter=order), len(known) - 1)]
            word[mine] = np.where(known[k] == th[mine], k, COMMON)
    words = np.bincount(of * width + word, minlength=n * width).reshape(n, -1)
    return out, classes, words


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance between rows of counts; 0 where either is empty."""
    p, q = p.astype(float), q.astype(float)
    sp, sq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(sp, 1), q / np.maximum(sq, 1)
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.where((sp > 0)[:, 0] & (sq > 0)[:, 0], np.sqrt(np.maximum((part(p) + part(q)) / 2, 0)), 0.0)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.astype(np.int32).reshape(-1)))


def _wide(col: pa.Array, n: int) -> np.ndarray:
    return np.asarray(col.fill_null([0] * n).flatten()).reshape(-1, n)


def references(measured: DataFrame) -> DataFrame:
    """One row for each language: (lang, classes, words), summed over documents that pass the base rules."""
    c, n = len(CLASSES), len(CLASSES) + COMMON + 1

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, code = lang_codes(batch.column(0))
                both = np.hstack([_wide(batch.column(1), c), _wide(batch.column(2), n - c)]).astype(np.int64)
                rows = [(names[k], i, int(v)) for k in np.unique(code) for i, v in enumerate(both[code == k].sum(0)) if v]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "i", "v"])

    good = measured.where(~F.col("base_failed")).select("lang", "classes", "words")
    long = good.mapInArrow(fn, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v"))
    # at most n entries for each language
    whole = long.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    value = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return whole.select("lang", F.array(*map(value, range(c))).alias("classes"), F.array(*map(value, range(c, n))).alias("words"))


def judge(docs: DataFrame, *, class_limit: float = 0.25, word_limit: float = 0.15, word_slack: float = 2.0, least_words: int = 100, least_reference: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns doc_id, the counts, base_failed, class_distance, word_distance, kept.

    The limit of the word distance is ``word_limit`` plus ``word_slack`` over the
    root of the number of words: that far a text of few words strays by chance.
    """
    d = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "text"):
                names, code = lang_codes(batch.column(0))
                common: list[np.ndarray] = [np.zeros(0, A.U)] * len(names)
                for k, i in zip(*np.unique(code, return_index=True)):
                    common[k] = np.array(batch.column(3)[int(i)].as_py() or [], np.int64).view(A.U)
                m, classes, words = measure(batch.column(1), code, common)
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), *[pa.array(m[c].astype(np.int64)) for c in counts], pa.array(base_failed(m)), _lists(classes), _lists(words)], ["doc_id", "lang", *counts, "base_failed", "classes", "words"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c, w = len(CLASSES), COMMON + 1
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            d1, d2 = distance(_wide(cols["classes"], c), _wide(cols["rc"], c)), distance(_wide(cols["words"], w), _wide(cols["rw"], w))
            failed, n_words = np.asarray(cols["base_failed"].fill_null(True)), np.asarray(cols["n_words"])
            far = ((d1 > class_limit) | (d2 > word_limit + word_slack / np.sqrt(np.maximum(n_words, 1)))) & (n_words >= least_words) & (_wide(cols["rw"], w).sum(1) >= least_reference)
            yield pa.RecordBatch.from_arrays([cols["doc_id"], *[cols[x] for x in counts], cols["base_failed"], pa.array(d1), pa.array(d2), pa.array(~failed & ~far)], ["doc_id", *counts, "base_failed", "class_distance", "word_distance", "kept"])

    def by_lang(df: DataFrame, one: DataFrame, *cols: Column) -> DataFrame:
        """``df`` with columns of one row for each language, sent to all tasks if there are not too many."""
        one = A.checkpointed(A.compact(one.select(F.col("lang").alias("_l"), *cols)))
        return df.join(F.broadcast(one) if one.count() <= MOST_SENT else one, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l")

    types = "".join(f"{c} long, " for c in counts)
    told = by_lang(d, common_words(d), F.col("words").alias("common"))
    measured = told.mapInArrow(fn, f"doc_id long, lang string, {types} base_failed boolean, classes array<int>, words array<int>")
    measured = A.checkpointed(measured)
    both = by_lang(measured, references(measured), F.col("classes").alias("rc"), F.col("words").alias("rw")).drop("lang")
    return both.mapInArrow(compare, f"doc_id long, {types} base_failed boolean, class_distance double, word_distance double, kept boolean")
