"""Ranked lexical search: postings in buckets of terms, joined with the terms of many queries.

A posting is (term, document, words of the document, occurrences).  ``postings``
writes them to the shared folder by hash bucket of the term, a frequent term's
rows dealt to several files, sorted by term; they are read by bucket, dealt by
document and joined with the queries' weighted terms, which go to every task in
blocks of queries.  Each match is a whole number; a document's are summed for
each query where they are, so that only a query's best of each task travel to
its top-k.  Sums do not depend on order.

Defined results: a null or empty text has no term; equal rows and null ids are
documents of their own; queries without a matching term, an empty table of
documents or of queries give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A

#: Files of postings are in folders by bucket of the term.
BUCKETS = 16
#: Rows of the queries' terms that are sent to every task at once; more are searched for in blocks of queries.
MOST_SENT = 200_000
#: Sums of queries and documents that a task is meant to hold.
SUMS = 2_000_000
ROWS = "term string, key long, doc_id long, n long, tf long"

# every byte that ends a term becomes a blank, A to Z lower case
_FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isascii() and chr(b).isupper() else 0x20 for b in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII, A to Z in lower case."""
    return (text or b"").translate(_FOLD).split()


def with_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, term, times): a number for each row of queries, and how often it has each term."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, d, t.decode(), n) for i, d, text in zip(*[c.to_pylist() for c in b.columns[:2]], b.column(2).cast(pa.large_binary()).to_pylist()) for t, n in Counter(terms(text)).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("item", "item_id", "term", "times"), r)) for r in rows], pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())]))

    rows = queries.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(fn, "item long, item_id long, term string, times long")


def postings(docs: DataFrame, wanted: frozenset[bytes] | None, id_col: str, text_col: str) -> DataFrame:
    """A row for each document and term of it, only ``wanted`` ones if given; one with term null tells the document's words."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "text"):
                rows: list[tuple] = []
                for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist()):
                    found = terms(text)
                    n = len(found)
                    if n:
                        rows.append((None, key, doc, n, n))
                    counts = Counter(found if wanted is None else [t for t in found if t in wanted])
                    rows += [(t, key, doc, n, tf) for t, tf in counts.items()]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()).cast(pa.string()), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["term", "key", "doc_id", "n", "tf"])
            A.trim()

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(fn, ROWS)


def stored(rows: DataFrame) -> tuple[DataFrame, str]:
    """Postings as Parquet by bucket of the term, and their folder."""
    spark = rows.sparkSession
    path = f"{A.shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    bucket = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS))).cast("int")
    # the documents' own rows have no term: they go by their key
    parts = A.buckets(spark)
    # a bucket is dealt to as many tasks as there are for it
    dealt = rows.withColumn("bucket", bucket).repartition(parts, "bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, parts // BUCKETS))))
    dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(f"{ROWS}, bucket int").parquet(path), path


def weight_of(documents: Column, df: Column) -> Column:
    """A term's weight: floor of 1000 ln((2N + 2) / (2 df + 1))."""
    return F.floor(F.lit(1000.0) * F.log((2 * documents + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def share(tf: str, n: str, documents: int, words: int) -> Column:
    """What an occurrence count is worth in a document of n words, up to a million; whole numbers."""
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 12L * (75L + (25L * {n} * {documents}L) div {words}L))")


def search(docs: DataFrame, queries: DataFrame, *, top: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Returns query_id, rank, doc_id and score: each query's ``top`` documents with a score above 0, equal scores by document id."""
    spark = docs.sparkSession
    asked = A.checkpointed(with_terms(queries, query_id, query_text))
    distinct = asked.select("term").distinct()
    many = distinct.count()
    # only the queries' own terms are indexed, unless they are too many to tell every task
    wanted = frozenset(r[0].encode() for r in distinct.collect()) if many <= MOST_SENT else None
    index, path = stored(postings(docs, wanted, id_col, text_col))
    documents, words = index.where("bucket = -1").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not many:
        A.dropped(spark, path)
        return spark.createDataFrame([], f"{query_id} long, rank int, doc_id long, score long")

    found = index.where("bucket >= 0")
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("times") * weight_of(F.lit(documents), F.col("df"))
    weighted = A.checkpointed(asked.join(counted, "term").select("term", "item", weight.alias("weight")).where("weight > 0"))
    rows, items = weighted.agg(F.count(F.lit(1)), F.count_distinct("item")).first()
    blocks = -(-rows // MOST_SENT) if MOST_SENT else 1
    parts = A.buckets(spark)
    parts = min(max(parts, -(-documents * items // max(blocks, 1) // SUMS)), 16 * parts)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "key")
    best = []
    for k in range(blocks):
        block = F.broadcast(weighted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k))
        # a document's postings lie together, and so do all its matches
        dealt = found.select("term", "key", "doc_id", share("tf", "n", documents, words).alias("worth")).repartition(parts, "key")
        sums = dealt.join(block, "term").groupBy("key", "item").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("weight") * F.col("worth")).alias("score"))
        ranks = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        best.append(A.checkpointed(ranks.select("item", "rank", "doc_id", "score")))
    names = asked.select("item", F.col("item_id").alias(query_id)).distinct()
    A.dropped(spark, path)
    return reduce(DataFrame.unionByName, best).join(names, "item").select(query_id, "rank", "doc_id", "score") if best else spark.createDataFrame([], f"{query_id} long, rank int, doc_id long, score long")
