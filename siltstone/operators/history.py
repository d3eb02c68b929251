"""Lifecycles: when each key was there, as periods over many snapshots.

A period begins with the snapshot that first has a key and is closed at the
first one that lacks it; a key that comes back opens another period.  Null key
parts are values like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.upsert import all_of


def periods(seen: DataFrame, scans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, period, opened, closed) from all that was ``seen`` (keys, at) in the ``scans`` (at); what no scan took is left out.

    Runs of scans without a gap are one period: gaps and islands over the scans' numbers.
    """
    # one row for each scan
    order = W.orderBy(at)
    numbered = scans.select(at).distinct().select(at, F.row_number().over(order).alias("_n"), F.lead(at).over(order).alias("_next"))
    rows = seen.select(*keys, at).distinct().join(F.broadcast(numbered), at)
    own = W.partitionBy(*keys).orderBy("_n")
    rows = rows.withColumn("_island", F.col("_n") - F.row_number().over(own))
    spans = rows.groupBy(*keys, "_island").agg(F.min(at).alias("opened"), F.max_by("_next", "_n").alias("closed"))
    return spans.withColumn("period", F.row_number().over(W.partitionBy(*keys).orderBy("opened")).cast("int")).select(*keys, "period", "opened", "closed")


def advance(history: DataFrame, seen: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """``history`` (keys, period, opened, closed) after one more snapshot, which is later than all before.

    Open periods of keys that are not seen close; seen keys without an open one begin their next.
    """
    marks = seen.select(*[F.col(k).alias(f"s_{k}") for k in keys]).distinct().withColumn("_seen", F.lit(True))
    same = all_of([F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys])
    kept = history.join(marks, same, "left").withColumn("closed", F.when(F.col("closed").isNull() & F.col("_seen").isNull(), now).otherwise(F.col("closed"))).select(*history.columns)
    last = history.groupBy(*keys).agg(F.max("period").alias("_period"), F.max(F.col("closed").isNull()).alias("_open"))
    fresh = marks.join(last, same, "left").where(~F.coalesce("_open", F.lit(False)))
    kinds = dict(history.dtypes)
    new = {k: F.col(f"s_{k}") for k in keys} | {"period": F.coalesce("_period", F.lit(0)) + 1, "opened": now, "closed": F.lit(None)}
    return kept.unionByName(fresh.select(*[new[c].cast(kinds[c]).alias(c) for c in history.columns]))


def as_of(history: DataFrame, when: Column) -> DataFrame:
    """The keys that were there at a time: a period holds its beginning and not its end."""
    return history.where((F.col("opened") <= when) & (F.col("closed").isNull() | (F.col("closed") > when)))
