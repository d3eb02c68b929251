"""SimHash near-duplicates by a grid over popcount vectors.

A fingerprint is mapped to the bit counts of its 32 two-bit segments.  Two
fingerprints that differ in d bits lie within Manhattan distance d of each
other there, so with d = 3 one of the two halves of the vector is at most 1
away.  Each half is a grid: fingerprints stand in their own cell, look into it
and into the cells one step up, and meet in an equi-join.  Pairs are then
verified by the exact number of differing bits.  Equal fingerprints are one
node, so copies never form pairs.

Defined results: a null text has no words and the fingerprint 0; a null id is
larger than all others; rows with equal ids are documents of their own; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .components import HUB, components, hubs, looked_up

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PAIRS = 0x55555555


def text_fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHashes of lower-cased words in runs of ``shingle``, repeats included."""
    import xxhash

    data, offs = A.text_bytes(texts)
    n = len(offs) - 1
    start, end, first = A.spans(data, offs)
    out = np.zeros(n, np.uint64)
    if not len(start):
        return out
    # one space between words of a text, nothing else
    word = ~A._WS[data]
    keep = word.copy()
    keep[1:] |= ~word[1:] & word[:-1]
    to = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=to[1:])
    flat = np.where(word, _LOWER[data], 32)[keep].astype(np.uint8).tobytes()
    a, b = to[start], to[end]
    words = np.diff(first)
    many = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    row = np.repeat(np.arange(n), many)
    begin = np.cumsum(many) - many
    s = first[:-1][row] + np.arange(len(row)) - begin[row]
    last = np.minimum(s + shingle, first[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, [flat[i:j] for i, j in zip(a[s].tolist(), b[last].tolist())], repeat(seed)), np.uint64, len(s))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = np.flatnonzero(many)
    ones = np.add.reduceat(bits, begin[some], axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > many[some][:, None], axis=1, bitorder="little")
    out[some] = np.ascontiguousarray(packed).view(np.uint64).reshape(-1)
    return out


def fingerprints(docs: DataFrame, *, shingle: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id and the fingerprint as a signed long."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text_fingerprints(batch.column(1), shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(fn, "doc_id long, fp long")


def segment_counts(fp: Column, part: int, parts: int, width: int) -> Column:
    """The bit counts of the segments of one of equal parts, each in its segment's own bits."""
    size = 64 // parts
    h = F.shiftrightunsigned(fp, size * part).bitwiseAND(F.lit((1 << size) - 1))
    return h if width == 1 else h - F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(PAIRS))


def links(nodes: DataFrame, most: int = 3, parts: int = 2, width: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of different values in ``fp`` that differ in at most ``most`` bits.

    ``most`` is below twice the number of parts, so one part's vector of segment
    counts (segments of 1 or 2 bits) is at most 1 away.
    """
    if most >= 2 * parts or width not in (1, 2) or (width == 2 and parts != 2):
        raise ValueError("no part has to be within one step")
    at = F.array(*[F.struct(F.lit(t).alias("t"), segment_counts(F.col("fp"), t, parts, width).alias("cell")) for t in range(parts)])
    stand = nodes.select("fp", F.inline(at))
    top, count = (1 << width) - 1, 64 // parts // width
    full = 2 if width == 2 else 1
    # up one step: only in segments whose count can grow
    step = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.when(F.call_function("shiftright", F.col("cell"), i * width).bitwiseAND(F.lit(top)) < full, F.col("cell") + F.call_function("shiftleft", F.lit(1).cast("long"), i * width)))
    near = F.explode(F.concat(F.array("cell"), F.filter(step, lambda c: c.isNotNull()))).alias("near")
    look = stand.select(F.col("t").alias("u"), F.col("fp").alias("a"), near, F.col("cell").alias("own"))
    cond = (F.col("u") == F.col("t")) & (F.col("near") == F.col("cell")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= most) & ((F.col("near") != F.col("own")) | (F.col("a") < F.col("fp")))
    return look.join(stand, cond, "inner").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """Returns doc_id, fp and component_id, the smallest doc_id that links reach.

    Fingerprints and components with many rows are dealt to several tasks (``looked_up``).
    """
    fps = A.checkpointed(A.compact(fingerprints(docs, **how)))
    # a null id is larger than all others, which min() has as well
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(nodes))
    linked = A.checkpointed(A.compact(nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "low", "root")))
    least = linked.groupBy(F.col("root").alias("n")).agg(F.min("low").alias("component_id"))
    of = looked_up(linked, "root", "fp", least, hubs(linked, "root")).select(F.col("fp").alias("of"), "component_id")
    # a fingerprint without links is its own component
    of = nodes.join(of, F.col("fp") == F.col("of"), "left").select(F.col("fp").alias("n"), F.when(F.col("of").isNull(), F.col("low")).otherwise(F.col("component_id")).alias("component_id"))
    return A.compact(looked_up(fps, "fp", "doc_id", of, hubs(fps, "fp"))).select("doc_id", "fp", "component_id")


#: Copies as a stage removes them: shingles of so many words, so many fifths in common.
SHINGLE, FIFTHS = 5, 4
#: Signatures: bands of so many least values; a pair at 0.8 has no band in common once in 300,000 times.
BANDS, VALUES = 24, 4
_MINIMA = [int(x) | 1 for x in A.mix(np.arange(1, BANDS * VALUES + 1, dtype=A.U) * A.U(0x9E3779B97F4A7C15))]
#: Ids up to which their table is broadcast.
MOST_SENT = 200_000
#: Pairs of one text, and texts of one band, that are compared in one task.
SHARE = 2000


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different runs of k lower-cased words of each text (fewer words: all), as values and offsets."""
    data, offs = A.text_bytes(texts)
    start, end, first = A.spans(data, offs)
    h, n = A.span_hashes(_LOWER[data], start, end), np.diff(first)
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    s = first[:-1][row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
    out = np.zeros(len(row), A.U)
    for j in range(k):
        inside = s + j < first[1:][row]
        out[inside] += A.mix(h[(s + j)[inside]] + A.U(j + 1))
    order = np.lexsort((out, row))
    row, out = row[order], out[order]
    new = A.group_starts(row, out)
    row, out = row[new], out[new]
    return out, np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)


def bitmaps(items: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """For each set, one bit for each value of its items' low bits: whether an odd number of items has it.

    Two sets differ in at least as many items as their bitmaps differ in bits.
    A bitmap has a power of two of bits, two to four for each item.
    """
    n = np.diff(offs).astype(np.int64)
    size = np.maximum(8, 2 << np.ceil(np.log2(n + 1)).astype(np.int64))
    end = np.cumsum(size)
    row = np.repeat(np.arange(len(n)), n)
    at = (end - size)[row] + (items & (size[row] - 1).astype(A.U)).astype(np.int64)
    flat = np.packbits(np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1, bitorder="little").tobytes()
    return [flat[b - s : b] for b, s in zip((end // 8).tolist(), (size // 8).tolist())]


def bits_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps, the longer one folded to the size of the other."""
    small = min(len(x), len(y))

    def folded(b: bytes) -> int:
        v, size = int.from_bytes(b, "little"), len(b)
        while size > small:
            size //= 2
            v = (v ^ v >> 8 * size) & (1 << 8 * size) - 1
        return v

    return (folded(x) ^ folded(y)).bit_count()


def bands(items: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """MinHash bands of each set that is not empty, as rows of ``BANDS`` keys."""
    at = offs[:-1][np.diff(offs) > 0]
    out = np.zeros((len(at), BANDS), A.U)
    if len(at):
        for j, factor in enumerate(_MINIMA):
            out[:, j // VALUES] += A.mix(np.minimum.reduceat(items * A.U(factor), at) + A.U(j + 1))
    return A.mix(out)


def _marked(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, mark, text); equal texts have equal marks."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(A.NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _described(marked: DataFrame) -> DataFrame:
    """(doc_id, mark, fp, n, bits, keys): fingerprint, number of shingles, their bitmap and bands."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, "text"):
                items, offs = shingle_sets(b.column(2))
                ends = np.r_[0, np.cumsum(np.where(np.diff(offs) > 0, BANDS, 0))].astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands(items, offs).view(np.int64).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(text_fingerprints(b.column(2)).view(np.int64)), pa.array(np.diff(offs)), pa.array(bitmaps(items, offs), pa.binary()), keys], ["doc_id", "mark", "fp", "n", "bits", "keys"])

    return marked.mapInArrow(fn, "doc_id long, mark long, fp long, n int, bits binary, keys array<long>")


def first_meetings(texts: DataFrame) -> DataFrame:
    """(key, a, b): each text b of a band with one text a of it, another one in each band; keys of one text have none.

    The one text comes from partial aggregates; a band's rows then look it up in parts.
    """
    rows = texts.select(F.explode("keys").alias("key"), F.col("mark").alias("b"))
    bands_ = rows.groupBy("key").agg(F.min_by("b", F.struct(F.xxhash64("key", "b"), "b")).alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    bands_ = A.checkpointed(A.compact(bands_))
    many = bands_.where(F.col("size") > HUB).select(F.col("key").alias("hub"), F.ceil(F.col("size") / HUB).cast("int").alias("ways"))
    return looked_up(rows, "key", "b", bands_.select(F.col("key").alias("n"), "a"), F.broadcast(many) if many.count() <= MOST_SENT else many).where("a != b")


def _compared(rows: list[tuple]) -> Iterator[tuple[int, int]]:
    """Pairs of rows (n, mark, root, part, bits) that can be near copies and have other roots, between two parts or within one."""
    rows.sort()
    both = len({r[3] for r in rows}) > 1
    for x, (n, a, root, part, bits) in enumerate(rows):
        for m, b, other, its, more in rows[x + 1 :]:
            if 5 * n < FIFTHS * m:
                break
            if root != other and (part != its or not both) and 9 * bits_apart(bits, more) <= n + m:
                yield min(a, b), max(a, b)


def other_meetings(met: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of one band that nothing connects so far, if their bitmaps let them be near copies.

    A band of more than ``SHARE`` texts is cut into parts, and each two of them meet in a task.
    """
    at = met.select("key", F.col("b").alias("mark")).unionByName(met.select("key", F.col("a").alias("mark")).distinct())
    rooted = texts.select("mark", "fp", "n", "bits").join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("mark", "n", "bits", F.coalesce("root", "fp").alias("root"))
    rows = at.join(rooted.select("mark", "root"), "mark")
    split = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    split = A.checkpointed(A.compact(split.where("low != high").select("key", F.ceil(F.col("size") / SHARE).cast("int").alias("ways"))))
    rows = rows.join(F.broadcast(split) if split.count() <= MOST_SENT else split, "key").select("key", "mark", "root", "ways", F.pmod(F.xxhash64("mark"), "ways").cast("int").alias("part"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
    rows = rows.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "mark", "root", "part").join(texts.select("mark", "n", "bits"), "mark")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def pairs() -> pa.RecordBatch:
            got = list(_compared(rows))
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in got], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                if r[:3] != cell:
                    yield pairs()
                    cell, rows = r[:3], []
                rows.append(r[3:])
        yield pairs()

    dealt = rows.select("key", "i", "j", "n", "mark", "root", "part", "bits").repartition(A.buckets(texts.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(fn, "a long, b long").distinct()


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) with a part, and the parts (a, part) of each a: ``SHARE`` pairs or so in each."""
    many = A.checkpointed(pairs.groupBy("a").count().where(F.col("count") > SHARE).select("a", F.ceil(F.col("count") / SHARE).cast("int").alias("ways")))
    many = F.broadcast(many) if many.count() <= MOST_SENT else many
    part = F.pmod(F.xxhash64("b"), F.coalesce("ways", F.lit(1))).cast("int").alias("part")
    parts = pairs.select("a").distinct().join(many, "a", "left").select("a", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("part"))
    return pairs.join(many, "a", "left").select("a", "b", part), parts


def _weighed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave 0.8 of their shingles in common possible."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = A.ids(b.column(2)) + A.ids(b.column(3))
            apart = np.fromiter(map(bits_apart, b.column(4).to_pylist(), b.column(5).to_pylist()), np.int64, b.num_rows)
            # of n items in all, at most n / 9 are on one side only
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(9 * apart <= n))

    dealt, parts = _dealt(pairs)
    left = texts.select(F.col("mark").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa")).join(parts, "a")
    right = texts.select(F.col("mark").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    both = dealt.join(right, "b").join(left, ["a", "part"]).where((5 * F.col("na") >= FIFTHS * F.col("nb")) & (5 * F.col("nb") >= FIFTHS * F.col("na")))
    return both.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(fn, "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    """(mark, to, part, items) of rows (mark, to, text): the shingles, once for each value in ``to``."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in A.slices(whole, "text"):
                items, offs = shingle_sets(b.column(2))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offs), pa.array(items.view(np.int64)))], ["mark", "to", "items"])

    return docs.mapInArrow(fn, "mark long, to array<struct<a long, part int>>, items array<long>").select("mark", F.inline("to").alias("to", "part"), "items")


def _alike(marked: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of marks whose texts have at least 4 fifths of their shingles in common.

    Shingles of b go to the parts of a, where a's own are first.
    """
    dealt, _ = _dealt(pairs)
    sends = dealt.select(F.col("b").alias("mark"), "a", "part").unionByName(dealt.select(F.col("a").alias("mark"), "a", "part"))
    asked = sends.groupBy("mark").agg(F.collect_set(F.struct("a", "part")).alias("to"))
    asked = A.checkpointed(A.compact(texts.select("mark", "doc_id").join(asked, "mark")))
    # few texts have a near one: their ids go to the texts, if they are not too many
    small = asked.agg(F.count("mark") + F.sum(F.size("to"))).first()[0] or 0
    wanted = marked.join(F.broadcast(asked) if small <= MOST_SENT else asked, ["doc_id", "mark"], "inner").select("mark", "to", "text")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            lists = batch.column(3)
            for k, (mark, to, part) in enumerate(zip(*[batch.column(j).to_pylist() for j in range(3)])):
                if mark == to and hub == (to, part):
                    continue  # a row repeated
                items = np.sort(np.asarray(lists[k].values))
                if mark == to:
                    hub, own = (to, part), items
                elif len(own) and len(items):
                    at = np.minimum(np.searchsorted(own, items), len(own) - 1)
                    shared = int((own[at] == items).sum())
                    if 5 * shared >= FIFTHS * (len(own) + len(items) - shared):
                        out.append((to, mark))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    sent = _sets(wanted).repartition(A.buckets(marked.sparkSession), "to", "part").sortWithinPartitions("to", "part", F.col("mark") != F.col("to"))
    return A.checkpointed(A.compact(sent.mapInArrow(fn, "a long, b long").distinct()))


def connected(marked: DataFrame, texts: DataFrame, near: DataFrame) -> DataFrame:
    """(node, root) of fingerprints that ``near`` and texts with 4 fifths of their shingles in common connect.

    Texts of one band are first compared with one of them.  Only what is not
    connected then is compared with each other.
    """
    prints = texts.select("mark", "fp")
    named = lambda found: found.join(prints.select(F.col("mark").alias("a"), F.col("fp").alias("fa")), "a").join(prints.select(F.col("mark").alias("b"), F.col("fp").alias("fb")), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    met = A.checkpointed(A.compact(first_meetings(texts)))
    first = A.checkpointed(A.compact(_weighed(met.select("a", "b").distinct(), texts)))
    roots = components(near.unionByName(named(_alike(marked, texts, first))))
    second = A.checkpointed(A.compact(other_meetings(met, texts, roots)))
    more = _alike(marked, texts, second)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(named(more)))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one for each group of near copies.

    Two texts are linked if their fingerprints are within 3 bits or they have at
    least 0.8 of their five-word shingles in common, however far their fingerprints
    are apart (``connected``).  Of each group that links connect, the row with the
    smallest id stays; of rows with equal id and text, one stays.
    """
    marked = _marked(docs, text_col, id_col)
    known = A.checkpointed(A.compact(_described(marked)))
    # one row for each text, by its smallest id; equal texts have equal values
    texts = A.checkpointed(A.compact(known.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "n", "bits", "keys")])))
    nodes = texts.groupBy("fp").agg(F.min(F.struct("doc_id", "mark")).alias("low"))
    roots = connected(marked, texts, links(nodes))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("low").alias("low"))
    chosen = A.checkpointed(A.compact(named.select("low.*")))
    own, mark = A.unused(docs.columns, "own", "mark")
    chosen = chosen.select(F.col("doc_id").alias(own), F.col("mark").alias(mark))
    kept = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(A.NULL_ID)), mark: F.xxhash64(text_col)})
    kept = kept.join(F.broadcast(chosen) if chosen.count() <= MOST_SENT else chosen, [own, mark], "left_semi")
    # repeated rows: none mostly, and then nothing has to be dealt out
    twice = known.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([own, mark]) if twice else kept).select(*docs.columns)
