"""Token search: postings of the words asked for, joined and counted.

Terms are lower-cased runs of letters and digits, without stop words and as
English stems.  All must occur; ``or`` between two words or phrases starts
another alternative, ``-`` excludes, and words in quotes stand as far from each
other as in the query, stop words counted.  ``=right/rights`` is one of these
words as they are, without stems.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.stem import STOP, english, stems

#: What a place of a query asks for: the column compared, "term" or "word", and its values.
Sought = tuple[str, tuple[str, ...]]
#: A part of a query: excluded or not, and (distance from the first, what is asked for there).
Part = tuple[bool, list[tuple[int, Sought]]]

#: Words of a block of documents, whose postings of a word are one row.
BLOCK_WORDS = 1 << 20


def terms(text: Column) -> Column:
    """Words in order; an empty one stands where a text begins or ends with something else."""
    # the dot of a lower-case \u0130 would part words
    return F.split(F.lower(F.replace(text, F.lit("\u0130"), F.lit("i"))), r"[^\p{L}\p{N}]+")


def _placed(text: str) -> list[tuple[int, Sought]]:
    """The places of a word or phrase with what they ask for; stop words take a place."""
    out, at = [], 0
    for token in text.split():
        words = re.findall(r"[^\W_]+", token.replace("\u0130", "i").lower())
        if token.startswith("=") and words:
            if exact := tuple(sorted(set(words) - STOP)):
                out.append((at, ("word", exact)))
            at += 1
            continue
        out += [(at + k, ("term", (english(w),))) for k, w in enumerate(words) if w not in STOP]
        at += len(words)
    return [(k - out[0][0], s) for k, s in out]


def parse(q: str) -> list[list[Part]]:
    """The alternatives of a query, each a list of parts that must all hold; stop words alone are no part."""
    out: list[list[Part]] = [[]]
    for dash, phrase, word in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', q):
        if not dash and word.lower() == "or":
            out.append([])
            continue
        if placed := _placed(phrase or word):
            out[-1].append((dash == "-", placed))
    return [parts for parts in out if parts]


def _holds(part: Part, at: dict[Sought, Column]) -> Column:
    excluded, placed = part
    # where the first would have to stand for each of the places
    moved = lambda gap, s: F.transform(at[s], lambda p: p - F.lit(gap))
    found = F.size(reduce(F.array_intersect, [moved(gap, s) for gap, s in placed])) > 0
    return ~found if excluded else found


def _asked(q: str) -> tuple[list[list[Part]], dict[str, list[str]], bool]:
    """A query's alternatives, its terms and words, and whether some alternative does nothing but exclude."""
    asked = parse(q)
    sought = {s for parts in asked for _, placed in parts for _, s in placed}
    values = {kind: sorted({v for k, vs in sought if k == kind for v in vs}) for kind in ("term", "word")}
    return asked, values, any(all(excluded for excluded, _ in parts) for parts in asked)


def _any(values: dict[str, list[str]]) -> Column:
    return reduce(or_, [F.col(kind).isin(vs) for kind, vs in values.items() if vs])


def _matching(found: DataFrame, asked: list[list[Part]], id_col: str, everyone: DataFrame | None) -> DataFrame:
    """Ids with postings (id, term, word, positions) that meet a query; ``everyone`` has the ids that may lack any."""
    names = {s: f"_at{k}" for k, s in enumerate(sorted({s for parts in asked for _, placed in parts for _, s in placed}))}
    hits = found.groupBy(id_col).agg(*[F.flatten(F.collect_list(F.when(F.col(kind).isin(*values), F.col("positions")))).alias(name) for (kind, values), name in names.items()])
    if everyone is not None:
        hits = everyone.join(hits, id_col, "left")
    at = {s: F.coalesce(name, F.array().cast("array<int>")) for s, name in names.items()}
    return hits.where(reduce(or_, [reduce(and_, [_holds(p, at) for p in parts]) for parts in asked])).select(id_col)


def documents_with(docs: DataFrame, id_col: str, text_col: str, q: str) -> DataFrame:
    """Ids of the documents that a query matches, once each; a query of stop words only matches nothing.

    Only words asked for, or that begin like a stem of the query, leave a text, and
    each different one of the latter is stemmed once.  Texts that have none are kept
    only if an alternative does nothing but exclude.
    """
    asked, values, excludes = _asked(q)
    if not asked:
        return docs.select(id_col).limit(0)
    # a stem has the first letter of its word
    may = [F.col("word").isin(values["word"])] + [F.substring("word", 1, 1).isin(sorted({s[0] for s in values["term"]}))] * bool(values["term"])
    words = docs.select(F.col(id_col), F.posexplode(terms(F.col(text_col))).alias("position", "word")).where(reduce(or_, may))
    if values["term"]:
        forms = words.select("word").distinct().where(~F.col("word").isin(sorted(STOP))).withColumn("term", stems("word")).where(_any(values))
        words = words.join(forms, "word")
    else:
        words = words.withColumn("term", F.lit(None).cast("string"))
    return _matching(words.withColumn("positions", F.array("position")), asked, id_col, docs.select(id_col).distinct() if excludes else None)


def _block(ids: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """(word, ids, positions) of some documents, one row for each different word that is no stop word."""
    n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    row, codes = np.repeat(np.arange(len(ids)), n), coded.indices.to_numpy()
    position = np.arange(len(codes)) - np.repeat(np.cumsum(n) - n, n)
    found = coded.dictionary.to_pylist()
    use = np.array([w != "" and w not in STOP for w in found], bool)[codes]
    row, codes, position = row[use], codes[use], position[use]
    order = np.argsort(codes, kind="stable")  # documents and positions stay in order
    row, codes, position = row[order], codes[order], position[order]
    new_word = np.diff(codes, prepend=-1) != 0
    firsts = np.flatnonzero(new_word | (np.diff(row, prepend=-1) != 0))
    listed = pa.ListArray.from_arrays(pa.array(np.append(firsts, len(row)), pa.int32()), pa.array(position, pa.int32()))
    ends = pa.array(np.append(np.flatnonzero(new_word[firsts]), len(firsts)), pa.int32())
    columns = [coded.dictionary.take(pa.array(codes[new_word])), pa.ListArray.from_arrays(ends, ids.take(pa.array(row[firsts]))), pa.ListArray.from_arrays(ends, listed)]
    return pa.RecordBatch.from_arrays(columns, ["word", "ids", "positions"])


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lengths = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // BLOCK_WORDS
        for k in np.unique(part):
            here = np.flatnonzero(part == k)
            yield _block(b.column(0).slice(here[0], len(here)), b.column(1).slice(here[0], len(here)))


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, ids, positions): postings of blocks of documents, grouped where the texts are read."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col), terms(F.col(text_col)).alias("words"))
    return texts.mapInArrow(_grouped, f"word string, ids array<{kind}>, positions array<array<int>>")


def _each(stored: DataFrame, id_col: str) -> DataFrame:
    """Blocks as postings (term, word, id, positions); a document that several rows have is in several."""
    one = stored.select("term", "word", F.explode(F.arrays_zip("ids", "positions")).alias("p"))
    return one.select("term", "word", F.col("p.ids").alias(id_col), F.col("p.positions").alias("positions"))


class Index:
    """Stored postings (term, word, id, positions) in blocks, clustered by word, and the ids of all documents."""

    def __init__(self, spark: SparkSession, path: str, id_col: str):
        self.spark, self.path, self.id_col = spark, path, id_col
        # footers are read once
        self.postings, self.ids = _each(spark.read.parquet(f"{path}/postings"), id_col), spark.read.parquet(f"{path}/ids")

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str) -> Index:
        """Writes the postings in ranges of words, so that a word's, and nearly all of a term's, lie in few row groups.

        Blocks are written first, since their ranges are sampled before they are sorted;
        words are stemmed where all rows of a word stand together.
        """
        spark = docs.sparkSession
        blocks(docs, id_col, text_col).write.parquet(f"{path}/blocks")
        ordered = spark.read.parquet(f"{path}/blocks").repartitionByRange("word", F.get("ids", F.lit(0))).sortWithinPartitions("word")
        ordered.withColumn("term", stems("word")).write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
        docs.select(id_col).distinct().write.parquet(f"{path}/ids")
        return cls(spark, path, id_col)

    def documents_with(self, q: str) -> DataFrame:
        """What ``documents_with`` gives for the documents of the index, from the postings of the query's words alone."""
        asked, values, excludes = _asked(q)
        if not asked:
            return self.ids.limit(0)
        return _matching(self.postings.where(_any(values)), asked, self.id_col, self.ids if excludes else None)

    def positions(self, *words: str) -> DataFrame:
        """(id, positions) of the documents that have any of some words, as they are."""
        return self.postings.where(F.col("word").isin(*words)).groupBy(self.id_col).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, positions): every term's positions in every document."""
    return _each(blocks(docs, id_col, text_col).withColumn("term", stems("word")), id_col).groupBy("term", id_col).agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
