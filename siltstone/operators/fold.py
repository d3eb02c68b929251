"""Folding one entity into another: every child table from the state before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def check_decisions(decisions: DataFrame) -> DataFrame:
    """(keep_id, drop_id) without chains: an id that is both kept and dropped fails the batch."""
    chained = decisions.select("keep_id").join(decisions.select(F.col("drop_id").alias("keep_id")), "keep_id", "left_semi")
    if chained.take(1):
        raise ValueError("an id is both kept and dropped")
    return decisions.where(F.col("keep_id") != F.col("drop_id")).distinct()


def guarded_move(children: DataFrame, decisions: DataFrame, entity: str, unique: list[str]) -> DataFrame:
    """``children`` with dropped entities' rows moved to the kept one, and ``moved`` saying so.

    A row whose twin in ``unique`` is there already is lost with its entity; so
    is all but the first of several that move to the same place.
    """
    cols = children.columns
    mapped = children.join(decisions.select(F.col("drop_id").alias(entity), "keep_id"), entity, "left")
    moving, staying = mapped.where(F.col("keep_id").isNotNull()), mapped.where(F.col("keep_id").isNull()).drop("keep_id")
    moving = moving.withColumn(entity, F.col("keep_id")).drop("keep_id")
    fresh = moving.join(staying.select(entity, *unique), [entity, *unique], "left_anti")
    one = W.partitionBy(entity, *unique).orderBy(*[c for c in cols if c not in (entity, *unique)] or [entity])
    fresh = fresh.withColumn("_n", F.row_number().over(one)).where(F.col("_n") == 1).drop("_n")
    return staying.withColumn("moved", F.lit(False)).unionByName(fresh.withColumn("moved", F.lit(True))).select(*cols, "moved")


def dedupe_lowest(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Of rows equal in ``keys``, nulls alike, the one with the lowest id."""
    w = W.partitionBy(*keys).orderBy(id_col)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def repoint_pairs(pairs: DataFrame, decisions: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Unresolved pairs of a dropped entity pointed at the kept one: ordered, without self pairs and pairs already there."""
    dropped = decisions.select("drop_id", "keep_id")
    # once for each end, so that ends meet decisions by equality
    touched = pairs.select(a, b, F.explode(F.array(a, b)).alias("drop_id")).join(dropped, "drop_id", "inner")
    other = F.when(F.col(a) == F.col("drop_id"), F.col(b)).otherwise(F.col(a))
    moved = touched.select(F.least("keep_id", other).alias(a), F.greatest("keep_id", other).alias(b)).where(F.col(a) != F.col(b)).distinct()
    return moved.join(pairs.select(a, b), [a, b], "left_anti")


def survivor(rows: DataFrame, pair: str, id_col: str, has_domain: str, jobs: str) -> DataFrame:
    """The entity of each pair to keep: with a domain, then more open jobs, then the lower id."""
    return rows.groupBy(pair).agg(F.min_by(id_col, F.struct(~F.col(has_domain), -F.col(jobs), F.col(id_col))).alias("survivor"))
