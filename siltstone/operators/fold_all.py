"""Entities folded into others with everything that hangs on them.

A batch of decisions (keep_id, drop_id) is settled first: chains end at the
entity that stays.  Each child table is then moved by its own rule, all from the
state before the batch; of several entities dropped into one, lower ids count
first.  What cannot be kept is reported, never lost silently.  ``fold_tables``
returns new tables for ``Database.commit``, which replaces all of them or none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators.denormal import refresh_denormalized
from siltstone.store import cut

# fixed values: what a kept entity takes over where it has nothing
FILLED = ("name", "domain", "website_url", "one_liner", "thesis", "founded_year", "employee_est", "stage", "status", "ats_provider", "ats_token")

SCHEMAS = {
    "companies": """id bigint, name string, normalized_name string, domain string, website_url string, one_liner string, thesis string,
        founded_year int, employee_est int, stage string, status string, ats_provider string, ats_token string, latest_round_id bigint,
        latest_job_posted_at timestamp, open_job_count bigint, field_provenance map<string,string>, first_seen_at timestamp, last_seen_at timestamp""",
    "jobs": "id bigint, company_id bigint, external_id string, title string, posted_at timestamp, first_seen_at timestamp, closed_at timestamp",
    "bookmarks": "job_id bigint, note string",
    "rounds": "id bigint, company_id bigint, round_type string, amount_usd bigint, announced_date date",
    "people": "id bigint, company_id bigint, full_name string, title string, linkedin_url string",
    "contacts": "id bigint, company_id bigint, kind string, value string, confidence string",
    "locations": "company_id bigint, location_id bigint, is_hq boolean",
    "sectors": "company_id bigint, sector_id bigint",
    "sources": "company_id bigint, connector string, external_id string, last_seen_at timestamp",
    "notes": "company_id bigint, status string, rating int, note string, updated_at timestamp",
    "pairs": "a bigint, b bigint, similarity double, resolved_at timestamp",
}
REPORT = "keep_id long, drop_id long, what string, value string"


def settled(decisions: DataFrame) -> DataFrame:
    """(keep_id, drop_id) with each kept entity one that stays; equal decisions count once.

    An entity folded into itself, into two others, or in a circle is an error.
    """
    d = cut(decisions.select("keep_id", "drop_id").distinct())
    n, dropped, self_ = d.agg(F.count(F.lit(1)), F.count_distinct("drop_id"), F.count_if(F.col("keep_id") == F.col("drop_id"))).first()
    if self_:
        raise ValueError("an entity is folded into itself")
    if dropped < n:
        raise ValueError("an entity is folded into two others")
    # pointer jumping: whoever is kept by one that goes is kept by whom that one goes to; each round halves what is left of a chain
    for _ in range(n.bit_length() + 1):
        step = cut(d.join(d.select(F.col("drop_id").alias("keep_id"), F.col("keep_id").alias("_next")), "keep_id", "left"))
        if not step.where("_next IS NOT NULL").take(1):
            return d
        d = step.select(F.coalesce("_next", "keep_id").alias("keep_id"), "drop_id")
    raise ValueError("entities are folded in a circle")


def report(rows: DataFrame, what: str, value: Column) -> DataFrame:
    return rows.select("keep_id", "drop_id", F.lit(what).alias("what"), value.cast("string").alias("value"))


def dealt(children: DataFrame, d: DataFrame, entity: str = "company_id") -> DataFrame:
    """``children`` with keep_id (their entity after the batch) and drop_id (null for rows that stay)."""
    return children.join(d.select(F.col("drop_id"), F.col("keep_id").alias("_keep")), F.col(entity) == F.col("drop_id"), "left").withColumn("keep_id", F.coalesce("_keep", entity)).drop("_keep")


def ranked_twins(children: DataFrame, d: DataFrame, unique: list[str], id_col: str | None = None) -> DataFrame:
    """``dealt`` rows with _n: the place among those that would share ``unique`` at the kept entity, its own first.

    A row with a null in ``unique`` has no twin.
    """
    alone = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in unique])
    by = [F.coalesce("drop_id", F.lit(-1)), *([id_col] if id_col else [])]
    w = W.partitionBy("keep_id", *unique).orderBy(*by)
    return dealt(children, d).withColumn("_n", F.when(alone, 1).otherwise(F.row_number().over(w)))


def placed(rows: DataFrame, columns: list[str], entity: str = "company_id") -> DataFrame:
    return rows.withColumn(entity, F.col("keep_id")).select(*columns)


def fold_jobs(jobs: DataFrame, bookmarks: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, bookmarks and report: one job for each external id; a star of one that goes moves to its twin, unless that has one."""
    rows = ranked_twins(jobs, d, ["external_id"], "id")
    keeps = rows.where("_n = 1").select("keep_id", "external_id", F.col("id").alias("_twin"))
    lost = rows.where("_n > 1").select("keep_id", "drop_id", "external_id", "id", "_n")
    twins = lost.join(keeps, ["keep_id", "external_id"])
    starred = twins.join(bookmarks.select(F.col("job_id").alias("id"), "note"), "id")
    held = bookmarks.select(F.col("job_id").alias("_twin"), F.lit(True).alias("_held"))
    first = W.partitionBy("_twin").orderBy("_n")
    moving = starred.join(held, "_twin", "left").withColumn("_k", F.row_number().over(first)).withColumn("_moves", F.col("_held").isNull() & (F.col("_k") == 1))
    stays = bookmarks.join(lost.select(F.col("id").alias("job_id")), "job_id", "left_anti").select(*bookmarks.columns)
    marks = stays.unionByName(moving.where("_moves").select(F.col("_twin").alias("job_id"), "note"))
    told = report(lost, "job discarded", F.col("id")).unionByName(report(moving.where("NOT _moves AND note IS NOT NULL"), "bookmark note discarded", F.col("note")))
    return placed(rows.where("_n = 1"), jobs.columns), marks, told


def fold_people(people: DataFrame, d: DataFrame) -> DataFrame:
    """All move; of those equal in every column but the id, the lowest id stays, at entities that took some in."""
    rows = dealt(people, d)
    takes = d.select("keep_id", F.lit(True).alias("_takes")).distinct()
    same = W.partitionBy("keep_id", *[F.coalesce(c, F.lit("")) for c in people.columns if c not in ("id", "company_id")]).orderBy("id")
    rows = rows.join(takes, "keep_id", "left").withColumn("_n", F.row_number().over(same)).where("_n = 1 OR _takes IS NULL")
    return placed(rows, people.columns)


def fold_contacts(contacts: DataFrame, d: DataFrame) -> DataFrame:
    """One contact for each kind and value: the kept entity's, published if any of them was."""
    rows = ranked_twins(contacts, d, ["kind", "value"], "id")
    w = W.partitionBy("keep_id", "kind", "value")
    published = F.max((F.col("confidence") == "published") & F.col("drop_id").isNotNull()).over(w)
    keep = F.when((F.col("confidence") == "constructed") & published, "published").otherwise(F.col("confidence"))
    return placed(rows.withColumn("confidence", keep).where("_n = 1"), contacts.columns)


def fold_sources(sources: DataFrame, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and report: one for each connector, which adopts an external id if it has none; others are told."""
    rows = ranked_twins(sources, d, ["connector"])
    w = W.partitionBy("keep_id", "connector")
    # its own, else that of the lowest dropped id
    chosen = F.min_by("external_id", F.when(F.col("external_id").isNotNull(), F.col("_n"))).over(w)
    rows = rows.withColumn("_chosen", chosen)
    lost = rows.where("_n > 1 AND external_id IS NOT NULL AND external_id <> _chosen")
    told = report(lost, "external id discarded", F.concat_ws(":", "connector", "external_id"))
    return placed(rows.where("_n = 1").withColumn("external_id", F.col("_chosen")), sources.columns), told


def fold_notes(notes: DataFrame, d: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Notes and report: the kept entity's if it says anything, else the first that does; other texts are told.

    A note without text and rating and with status none says nothing.
    """
    says = F.col("note").isNotNull() | F.col("rating").isNotNull() | (F.coalesce("status", F.lit("none")) != "none")
    rows = dealt(notes, d).withColumn("_says", says)
    best = W.partitionBy("keep_id").orderBy(F.desc("_says"), F.coalesce("drop_id", F.lit(-1)))
    rows = rows.withColumn("_n", F.row_number().over(best))
    lost = rows.where("_n > 1 AND note IS NOT NULL AND drop_id IS NOT NULL")
    stamped = rows.where("_n = 1").withColumn("updated_at", F.when(F.col("drop_id").isNotNull(), now).otherwise(F.col("updated_at")))
    return placed(stamped, notes.columns), report(lost, "note discarded", F.col("note"))


def fold_pairs(pairs: DataFrame, d: DataFrame) -> DataFrame:
    """Unresolved pairs of dropped entities are pointed at the kept ones, each pair once; pairs within one entity and verdicts on dropped ones go."""
    gone = d.select(F.col("drop_id").alias("_x"))
    # both ends can go: the second follows the first
    ends = lambda p, e: p.join(d.select(F.col("drop_id").alias(e), F.col("keep_id").alias(f"_{e}")), e, "left").withColumn(e, F.coalesce(f"_{e}", e)).drop(f"_{e}")
    touched = pairs.join(gone, (F.col("a") == F.col("_x")), "left_semi").unionByName(pairs.join(gone, (F.col("b") == F.col("_x")), "left_semi")).distinct()
    stays = pairs.join(gone, F.col("a") == F.col("_x"), "left_anti").join(gone, F.col("b") == F.col("_x"), "left_anti")
    moved = ends(ends(touched.where("resolved_at IS NULL"), "a"), "b").where(F.col("a") != F.col("b"))
    moved = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    fresh = moved.join(stays.select("a", "b"), ["a", "b"], "left_anti").withColumn("resolved_at", F.lit(None).cast("timestamp"))
    return stays.unionByName(fresh.select(*stays.columns))


def fold_companies(companies: DataFrame, d: DataFrame) -> DataFrame:
    """Kept entities with what they lacked, who said so, and the whole time seen; dropped ones are gone."""
    taken = dealt(companies, d, "id").where("drop_id IS NOT NULL")
    names = [c for c in FILLED if c in companies.columns]
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v"), F.element_at("field_provenance", c).alias("o")), F.when(F.col(c).isNotNull(), F.col("drop_id"))).alias(f"_{c}")
    more = taken.groupBy("keep_id").agg(*[first(c) for c in names], F.min("first_seen_at").alias("_first"), F.max("last_seen_at").alias("_last"))
    both = companies.join(d.select(F.col("drop_id").alias("id")), "id", "left_anti").join(more, F.col("id") == F.col("keep_id"), "left")
    own = F.coalesce("field_provenance", F.create_map().cast("map<string,string>"))
    # owners of filled fields that the kept entity does not claim
    owners = F.filter(
        F.array(*[F.when(F.col(c).isNull() & F.col(f"_{c}.v").isNotNull() & F.col(f"_{c}.o").isNotNull() & ~F.map_contains_key(own, c), F.struct(F.lit(c).alias("key"), F.col(f"_{c}.o").alias("value"))) for c in names]),
        lambda e: e.isNotNull(),
    )
    cols = {c: F.coalesce(c, f"_{c}.v") for c in names} | {"field_provenance": F.map_concat(own, F.map_from_entries(owners)), "first_seen_at": F.least("first_seen_at", "_first"), "last_seen_at": F.greatest("last_seen_at", "_last")}
    return both.select(*[cols.get(c, F.col(c)).alias(c) for c in companies.columns])


def fold_tables(t: dict[str, DataFrame], decisions: DataFrame, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after the decisions, and what was discarded: (keep_id, drop_id, what, value).

    ``t`` has the tables of ``SCHEMAS``.  Decisions about entities that are not
    there are an error.
    """
    d = settled(decisions)
    ids = t["companies"].select(F.col("id").alias("_id"))
    if d.select(F.explode(F.array("keep_id", "drop_id")).alias("_id")).join(ids, "_id", "left_anti").take(1):
        raise ValueError("an entity that is not there is folded")
    out: dict[str, DataFrame] = {}
    out["jobs"], out["bookmarks"], told_jobs = fold_jobs(t["jobs"], t["bookmarks"], d)
    out["rounds"] = placed(dealt(t["rounds"], d), t["rounds"].columns)
    out["people"] = fold_people(t["people"], d)
    out["contacts"] = fold_contacts(t["contacts"], d)
    out["locations"] = placed(ranked_twins(t["locations"], d, ["location_id"]).where("_n = 1"), t["locations"].columns)
    out["sectors"] = placed(ranked_twins(t["sectors"], d, ["sector_id"]).where("_n = 1"), t["sectors"].columns)
    out["sources"], told_sources = fold_sources(t["sources"], d)
    out["notes"], told_notes = fold_notes(t["notes"], d, now)
    out["pairs"] = fold_pairs(t["pairs"], d)
    kept = d.select(F.col("keep_id").alias("id")).distinct()
    out["companies"] = refresh_denormalized(fold_companies(t["companies"], d), out["jobs"], out["rounds"], kept)
    return out, reduce(DataFrame.unionByName, [told_jobs, told_sources, told_notes])
