"""Mixing sources to target weights by systematic sampling.

Sizes of sources are summed, targets are found by filling the weights up to
each source's limit, and a document's expected number of copies is its source's
target over its source's size (see ``mix_sources`` for small documents).  Within a
source the expected copies are summed in an order by size, one random offset is
added, and a document is emitted once for each whole number that its stretch of
the sum crosses.

Positions come from ``ranked``, so no task holds a source.  The summary has one
row per source.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own, last in order; rows with equal ids are separate documents;
an empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrays as A
from .ranking import ranked

#: Sources up to which their table is broadcast.
MOST_SENT = 50_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, carry: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, source) and the carried columns; the size is the number of words."""
    names = ["doc_id", "size", "source", *[f"_k_{c}" for c in carry]]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("size"), F.col(source_col).alias("source"), *[F.col(c).alias(f"_k_{c}") for c in carry])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in A.slices(whole, "size"):
                _, _, first = A.spans(*A.text_bytes(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), *batch.columns[2:]], names)

    fields = [T.StructField("size", T.LongType()) if f.name == "size" else f for f in d.schema.fields]
    return d.mapInArrow(fn, T.StructType(fields))


def size_band(size: Column) -> Column:
    """Sizes within an eighth of a power of two share a band; integers only."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(bits * 8 + F.call_function("shiftright", size, (bits - 4).cast("int")) % 8).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1), from its name and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...], limit: int) -> DataFrame:
    """Each source's target, from (source, source_size): one row per source.

    Filling by weight with limits is one level for all sources below their
    limit: sources in order of limit over weight are at their limit until the
    level that the rest can share is no higher.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * limit)
    by_cap = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    upto, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("_share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(upto), F.lit(0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0))))
    # the share rises while the next source is below it and falls after that
    level = F.max("_share").over(everything)
    return t.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_w"))).select("source", "source_size", "target")


def copies_at(u: Column, rate: Column, rank: Column, limit: int) -> Column:
    """Whole numbers that the document's stretch of the sum crosses."""
    return F.least(F.floor(u + rate * rank) - F.floor(u + rate * (rank - 1)), F.lit(limit)).cast("long")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1.0, 2.0, 3.0), limit: int = 3, seed: int = 20240, share: float = 50.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Returns doc_id, size, source, source_size, target, copies, taken, and the columns named in ``carry``.

    Documents larger than the target's 1/``share`` are a stratum of their own: all
    expect target over size copies.  The others expect what then brings the source
    to its target, so that one large document more or less is made up for.  Both
    strata are sampled with the source's one random offset.
    """
    # several passes over ids and sizes; the texts are read once for these, and once more if carried
    narrow = A.checkpointed(A.compact(sized(docs, id_col, text_col, source_col, ()))).withColumn("_band", size_band(F.col("size")))
    sizes = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = A.checkpointed(A.compact(sizes.select(F.col("source").alias("_s"), "source_size", "target", rate.alias("_rate"), offset(F.col("source"), seed).alias("_u"))))
    # one row for each source: sent to all tasks if there are not too many, else joined by shuffles
    small = named.count() <= MOST_SENT
    sent = lambda df: F.broadcast(df) if small else df

    def placed(df: DataFrame, counted: DataFrame | None) -> DataFrame:
        return ranked(df, ["source", "_large"], ["_band"], F.col("doc_id"), ["size", "doc_id"], counted=counted)

    def strata(df: DataFrame) -> DataFrame:
        return df.join(sent(named), F.col("source").eqNullSafe(F.col("_s")), "inner").withColumn("_large", F.col("size") > F.col("target") / F.lit(share))

    d = A.checkpointed(A.compact(placed(strata(narrow), None)))
    first = copies_at(F.col("_u"), F.col("_rate"), F.col("rank"), limit)
    sums = d.groupBy("_s").agg(F.first("target").alias("_t"), F.coalesce(F.sum(F.when(F.col("_large"), first * F.col("size"))), F.lit(0)).alias("_taken"), F.coalesce(F.sum(F.when(~F.col("_large"), F.col("size"))), F.lit(0)).alias("_left"))
    rest = F.when(F.col("_left") > 0, F.least(F.greatest((F.col("_t") - F.col("_taken")) / F.col("_left"), F.lit(0.0)), F.lit(float(limit)))).otherwise(F.lit(0.0))
    rests = sums.select(F.col("_s").alias("_c"), rest.alias("_rest"))
    if carry:
        d = placed(strata(sized(docs, id_col, text_col, source_col, carry).withColumn("_band", size_band(F.col("size")))), strata(narrow))
    d = d.join(sent(rests), F.col("source").eqNullSafe(F.col("_c")), "inner").withColumn("copies", F.when(F.col("_large"), first).otherwise(copies_at(F.col("_u"), F.col("_rest"), F.col("rank"), limit)))
    out = d.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[f"_k_{c}" for c in carry])
    return out if carry else A.compact(out)


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    mixed = mix_sources(docs, carry=tuple(docs.columns), **how)
    repeated = mixed.where(F.col("copies") > 0).select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_nth"), *[F.col(f"_k_{c}") for c in docs.columns])
    return repeated.select(*[F.col(f"_k_{c}").alias(c) for c in docs.columns])
