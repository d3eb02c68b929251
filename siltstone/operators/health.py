"""How sources' runs are doing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STREAK = 3


def failure_streaks(runs: DataFrame, by: str, failed: Column, newest: list[Column], name: str = "streak") -> DataFrame:
    """Failed runs since the last other one: those before any run that did not fail, newest first."""
    w = W.partitionBy(by).orderBy(*newest).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = runs.withColumn("_good", F.sum(F.when(failed, 0).otherwise(1)).over(w))
    return seen.where(F.col("_good") == 0).groupBy(by).agg(F.count(F.lit(1)).alias(name))


def run_health(sources: DataFrame, by: str, last_ok: DataFrame, streaks: DataFrame, now: Column, period: Column) -> DataFrame:
    """``sources`` with last_ok, streak, failing and stale: older than twice the period, or never run."""
    out = sources.join(last_ok, by, "left").join(streaks, by, "left").withColumn("streak", F.coalesce("streak", F.lit(0).cast("long")))
    stale = F.when(period.isNull(), False).otherwise(F.col("last_ok").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last_ok") > 2 * period))
    return out.withColumn("failing", F.col("streak") >= STREAK).withColumn("stale", stale)


def status_of(errors: Column, problems: Column) -> Column:
    """error over partial over ok."""
    return F.when(errors > 0, "error").when(problems > 0, "partial").otherwise("ok")
