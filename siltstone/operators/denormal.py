"""Columns of entities derived from their jobs and rounds, refreshed for those that changed.

open_job_count and latest_job_posted_at come from jobs without closed_at (a job
without posted_at counts as posted when it was first seen), latest_round_id from
the round announced last, dated before undated, then the highest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVED = ("open_job_count", "latest_job_posted_at", "latest_round_id")


def posted(job: str = "") -> Column:
    return F.coalesce(F.col(f"{job}posted_at"), F.col(f"{job}first_seen_at"))


def round_order(r: str = "") -> Column:
    """What sorts the latest round last."""
    return F.struct(F.col(f"{r}announced_date").isNotNull().alias("dated"), F.col(f"{r}announced_date").alias("on"), F.col(f"{r}id").alias("id"))


def derived(jobs: DataFrame, rounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(company_id, _count, _posted) of open jobs and (company_id, _round)."""
    j = jobs.where(F.col("closed_at").isNull()).groupBy("company_id").agg(F.count(F.lit(1)).alias("_count"), F.max(posted()).alias("_posted"))
    return j, rounds.groupBy("company_id").agg(F.max(round_order()).alias("_r")).select("company_id", F.col("_r.id").alias("_round"))


def refresh_denormalized(companies: DataFrame, jobs: DataFrame, rounds: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``companies`` with the derived columns of ``ids`` (a column id; all if None) computed anew; children of others are not aggregated."""
    names = companies.columns
    if ids is not None:
        some = ids.select(F.col("id").alias("company_id")).distinct()
        jobs, rounds = jobs.join(some, "company_id", "left_semi"), rounds.join(some, "company_id", "left_semi")
        companies = companies.join(some.select(F.col("company_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.lit(True) if ids is None else F.col("_hit").isNotNull()
    j, r = derived(jobs, rounds)
    for df in (j, r):
        companies = companies.join(df.withColumnRenamed("company_id", "id"), "id", "left")
    new = {"open_job_count": F.coalesce("_count", F.lit(0)), "latest_job_posted_at": F.col("_posted"), "latest_round_id": F.col("_round")}
    kinds = dict(companies.dtypes)
    return companies.select(*[F.when(hit, new[c]).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in new else F.col(c) for c in names])


def changes(before: DataFrame, after: DataFrame, touched: DataFrame) -> DataFrame:
    """(company_id, old, new): how the rows with the ids in ``touched`` were and are; null where a row was not there or is gone.

    A row that moved to another entity is gone from one and new at the other.
    """
    ids = touched.select("id").distinct()
    side = lambda df, name: df.join(ids, "id", "left_semi").select("id", "company_id", F.struct(*[c for c in df.columns]).alias(name))
    return side(before, "old").join(side(after, "new"), ["id", "company_id"], "full").select("company_id", "old", "new")


def apply_changes(companies: DataFrame, job_changes: DataFrame, round_changes: DataFrame, jobs: DataFrame, rounds: DataFrame) -> DataFrame:
    """``companies`` with the derived columns brought up to date from what changed.

    Counts move by differences.  A latest date or round is raised by what is
    new; only where the one that was latest left are the entity's own children
    read again, and they alone.  Entities without a change are not touched.
    """
    names, kinds = companies.columns, dict(companies.dtypes)
    open_ = lambda s: F.col(s).isNotNull() & F.col(f"{s}.closed_at").isNull()
    at = lambda s: F.when(open_(s), posted(f"{s}."))
    j = job_changes.groupBy("company_id").agg((F.sum(open_("new").cast("long")) - F.sum(open_("old").cast("long"))).alias("_more"), F.max(at("new")).alias("_new"), F.max(at("old")).alias("_old"))
    order = lambda s: F.when(F.col(s).isNotNull(), round_order(f"{s}."))
    r = round_changes.groupBy("company_id").agg(F.max(order("new")).alias("_top"), F.array_agg("old.id").alias("_left"))
    hit = companies.join(j.withColumnRenamed("company_id", "id"), "id", "left").join(r.withColumnRenamed("company_id", "id"), "id", "left")
    # the latest was among what left
    stale_job = F.coalesce(F.col("_old") >= F.col("latest_job_posted_at"), F.lit(False))
    stale_round = F.coalesce(F.array_contains("_left", F.col("latest_round_id")), F.lit(False))
    hit = hit.withColumn("_stale_job", stale_job).withColumn("_stale_round", stale_round)
    again_j = jobs.join(hit.where("_stale_job").select(F.col("id").alias("company_id")), "company_id", "left_semi")
    again_r = rounds.join(hit.where("_stale_round").select(F.col("id").alias("company_id")), "company_id", "left_semi")
    a, b = derived(again_j, again_r)
    # what is new is compared with the stored latest round by its own row
    stored = rounds.join(hit.where("_top IS NOT NULL AND NOT _stale_round").select(F.col("latest_round_id").alias("id")), "id", "left_semi").select(F.col("company_id").alias("id"), round_order().alias("_was"))
    out = hit.join(a.drop("_count").withColumnRenamed("company_id", "id"), "id", "left").join(b.withColumnRenamed("company_id", "id"), "id", "left").join(stored, "id", "left")
    new = {
        "open_job_count": F.col("open_job_count") + F.coalesce("_more", F.lit(0)),
        "latest_job_posted_at": F.when(F.col("_stale_job"), F.col("_posted")).otherwise(F.greatest("latest_job_posted_at", "_new")),
        "latest_round_id": F.when(F.col("_stale_round"), F.col("_round")).when(F.col("_top").isNotNull(), F.greatest("_top", "_was")["id"]).otherwise(F.col("latest_round_id")),
    }
    return out.select(*[new[c].cast(kinds[c]).alias(c) if c in new else F.col(c) for c in names])
