"""Exact positions within large groups, without any task that holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], bands: list[str], spread: Column, order: list[str], name: str = "rank", counted: DataFrame | None = None) -> DataFrame:
    """Adds the position from 1 of each row within ``keys``.

    The order is by ``bands``, then the two hex digits of ``spread``'s MD5,
    then ``order``.  Each (keys, bands, digits) cell is numbered in a task of
    its own choice and cells are chained by their counts, so a group that has a
    third of all rows is dealt to 256 cells for each band.  ``counted`` has the
    same rows with fewer columns, if the counts can be taken from there.
    """
    cell = [*keys, *bands, "_spread"]
    digits = F.substring(F.md5(F.coalesce(spread.cast("string"), F.lit("")).cast("binary")), 1, 2)
    df, narrow = df.withColumn("_spread", digits), (df if counted is None else counted).withColumn("_spread", digits)
    same = lambda a, b: [a[c].eqNullSafe(b[f"_c_{c}"]) for c in cell]
    counts = narrow.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in cell[len(keys) :]]).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*[F.col(c).alias(f"_c_{c}") for c in cell], "_before")
    inner = df.withColumn("_in", F.row_number().over(W.partitionBy(*cell).orderBy(*[F.col(c).asc_nulls_last() for c in order])))
    cond = None
    for c in same(inner, counts):
        cond = c if cond is None else cond & c
    return inner.join(counts, cond, "inner").withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_spread", *[f"_c_{c}" for c in cell])
