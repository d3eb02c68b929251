"""A source refreshed end to end: scanned, mapped, merged with all its children, and told in the log of runs.

The run's row is committed first, as an error; then records and children of the
whole scan are merged in one commit, and the row is completed.  A run that
breaks leaves its row and nothing else.  Sources differ in how their rows
become records and children (``MAPPED``); everything after is common.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.database import Database, Snapshot
from siltstone.functions import text as X
from siltstone.operators import fold_all, runs
from siltstone.operators.denormal import refresh_denormalized
from siltstone.operators.record import merge_records
from siltstone.operators.upsert import close_missing, coalesce_new, insert_missing, keep_old, reset, upsert
from siltstone.schemas import FETCH_RUNS, SOURCE_PRIORITY
from siltstone.sources import connector
from siltstone.store import cut

SCHEMAS = fold_all.SCHEMAS | {
    "companies": fold_all.SCHEMAS["companies"] + ", metro string",
    "jobs": fold_all.SCHEMAS["jobs"] + ", connector string, url string, location_text string, last_seen_at timestamp",
    "sector_names": "id bigint, slug string, name string",
    "places": "id bigint, city string, state string, country string, metro string",
    "runs": FETCH_RUNS,
}
#: Days before the last success that are scanned again.
OVERLAP = 3
FIELDS = {"name": "string", "one_liner": "string", "employee_est": "int", "founded_year": "int", "stage": "string", "status": "string"}
BOARDS = ("greenhouse", "lever", "ashby", "workable")


class Mapped(NamedTuple):
    """Records (rid, external_id, name, domain, enrich_only, fields) and children by rid; a child table that a source lacks is None."""

    records: DataFrame
    jobs: DataFrame | None = None  # rid, external_id, title, url, location_text, posted_at
    complete: DataFrame | None = None  # rid of records whose list of jobs is whole
    sectors: DataFrame | None = None  # rid, name
    places: DataFrame | None = None  # rid, city, state, country
    people: DataFrame | None = None  # rid, full_name, title
    rounds: DataFrame | None = None  # rid, round_type, amount_usd, announced_date


def arrived(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with rid, their number by arrival."""
    return cut(cut(rows.orderBy(*order)).withColumn("rid", F.monotonically_increasing_id()))


def record(rows: DataFrame, enrich_only: bool, **have: str) -> DataFrame:
    """The columns of records; fields that a source does not know are null."""
    out = {c: F.col(have[c]) if c in have else F.lit(None) for c in ("external_id", "domain", *FIELDS)}
    kinds = {"external_id": "string", "domain": "string"} | FIELDS
    return rows.select("rid", *[v.cast(kinds[c]).alias(c) for c, v in out.items()], F.lit(enrich_only).alias("enrich_only"))


def of_directory(source: str, rows: DataFrame) -> Mapped:
    rows = arrived(rows, ["target", "external_id", "name"])
    places = rows.select("rid", F.posexplode("locations").alias("n", "p")).select("rid", F.get("p", 0).alias("city"), F.when(F.size("p") > 2, F.get("p", 1)).alias("state"), F.element_at("p", -1).alias("country"), "n")
    known = record(rows, False, external_id="external_id", domain="domain", name="name", one_liner="one_liner", employee_est="employee_est", stage="stage", status="status")
    return Mapped(known, sectors=rows.select("rid", F.explode("sectors").alias("name")), places=places)


def of_filings(source: str, rows: DataFrame) -> Mapped:
    rows = arrived(rows.where("problem IS NULL"), ["target", "cik"])
    people = rows.select("rid", F.explode("people").alias("p")).select("rid", "p.full_name", F.array_join("p.relationships", ", ").alias("title"))
    rounds = rows.select("rid", "round_type", F.coalesce("sold", "offered").alias("amount_usd"), F.col("first_sale").alias("announced_date"))
    places = rows.where("city IS NOT NULL").select("rid", "city", "state", F.lit("US").alias("country"), F.lit(0).alias("n"))
    return Mapped(record(rows, False, external_id="cik", name="name", founded_year="founded_year"), people=people, rounds=rounds, places=places)


def of_board(source: str, rows: DataFrame) -> Mapped:
    """One record for each board read; ``rows`` are jobs, with a row of nulls for a board without any."""
    jobs = cut(rows)
    boards = arrived(jobs.select("target").distinct(), ["target"])
    kids = boards.select("rid", "target").join(jobs.where("external_id IS NOT NULL"), "target")
    return Mapped(record(boards, True, external_id="target"), jobs=kids.select("rid", "external_id", "title", "url", "location_text", "posted_at"), complete=boards.select("rid"))


MAPPED: dict[str, Callable[[str, DataFrame], Mapped]] = {"ycombinator": of_directory, "sec_edgar": of_filings} | dict.fromkeys(BOARDS, of_board)


def scanned(spark: SparkSession, source: str, path: str, since: datetime | None) -> DataFrame:
    """Rows of the payloads fetched since a time; boards that parse to no job at all keep a row."""
    day = since.date() if since is not None else None
    rows = connector.scan(spark, source, path, day)
    if source not in BOARDS:
        return rows
    read = connector.payloads(spark, source, path)
    if day is not None:
        read = read.where(F.col("fetched_at") >= F.lit(datetime(day.year, day.month, day.day, tzinfo=UTC)))
    boards = read.where(F.try_parse_json("payload").isNotNull() & F.col("target").isNotNull()).select("target").distinct()
    return boards.join(rows, "target", "left")


def with_owners(companies: DataFrame) -> DataFrame:
    """Fields' owners as columns, for the merge."""
    return companies.select("id", "domain", "normalized_name", "metro", *[F.col(f).cast(k).alias(f) for f, k in FIELDS.items()], *[F.element_at("field_provenance", f).alias(f"owner_{f}") for f in FIELDS])


def merged_companies(stored: DataFrame, entities: DataFrame, touched: DataFrame, now: Column) -> DataFrame:
    """Companies with what the merge decided; owners as a map again, times of those touched, columns of new ones."""
    owners = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, FIELDS)), F.array(*[f"owner_{f}" for f in FIELDS])), lambda k, v: v.isNotNull())
    new = entities.select("id", F.col("domain").alias("m_domain"), F.col("normalized_name").alias("m_normalized_name"), F.col("metro").alias("m_metro"), *[F.col(f).alias(f"m_{f}") for f in FIELDS], owners.alias("_owners"))
    both = new.join(stored, "id", "left").join(touched.select(F.col("entity_id").alias("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    other = F.map_filter(F.coalesce("field_provenance", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*FIELDS))
    hit = F.col("_hit").isNotNull()
    cols = {c: F.col(f"m_{c}") for c in ("domain", "normalized_name", "metro", *FIELDS)} | {
        "field_provenance": F.map_concat(other, F.col("_owners")), "open_job_count": F.coalesce("open_job_count", F.lit(0).cast("long")),
        "first_seen_at": F.coalesce("first_seen_at", now), "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")),
    }
    return both.select(*[cols.get(c, F.col(c)).alias(c) for c in stored.columns])


def number(slug: Column) -> Column:
    """What new rows without numbers of their own are numbered in the order of."""
    return F.xxhash64(slug).cast("decimal(20,0)").cast("double")


def changed(s: Snapshot, source: str, m: Mapped, now: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables that the records change, and (rid, entity_id, created) of those that were written."""
    spark, t = s.database.spark, {name: s[name] for name in SCHEMAS}
    given = m.records.withColumn("domain", X.normalize_domain(F.col("domain"), international=True)).withColumn("normalized_name", X.normalize_name(F.col("name")))
    first_place = spark.createDataFrame([], "rid bigint, metro string")
    if m.places is not None:
        # a record's metro is that of its first known place
        metros = t["places"].where("metro IS NOT NULL").select(F.lower("city").alias("_c"), F.lower(F.coalesce("state", F.lit(""))).alias("_s"), F.col("metro")).distinct()
        placed = m.places.join(F.broadcast(metros) if metros.count() <= 100_000 else metros, (F.lower("city") == F.col("_c")) & (F.lower(F.coalesce("state", F.lit(""))) == F.col("_s")))
        first_place = placed.groupBy("rid").agg(F.min_by("metro", "n").alias("metro"))
    given = cut(given.join(first_place, "rid", "left"))
    links = t["sources"]
    if source in BOARDS:
        # boards are known by the token that a company's site shows, besides links of earlier runs
        tokens = t["companies"].where(F.col("ats_provider") == source).select(F.col("id").alias("company_id"), F.lit(source).alias("connector"), F.col("ats_token").alias("external_id"), F.lit(None).cast("timestamp").alias("last_seen_at"))
        links = links.unionByName(tokens.join(links.where(F.col("connector") == source).select("company_id"), "company_id", "left_anti").where("external_id IS NOT NULL"))
    out = merge_records(given, with_owners(t["companies"]), links, list(FIELDS), source=source, now=now, priority=SOURCE_PRIORITY)
    of_record = cut(out.of_record)
    changes = {"companies": merged_companies(t["companies"], out.entities, of_record, now), "sources": out.links.where("last_seen_at IS NOT NULL")}
    pairs = out.pairs.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    # what a reviewer has resolved stays as it is
    changes["pairs"] = upsert(t["pairs"], pairs, ["a", "b"], {"similarity": lambda o, n: F.greatest(o, n), "resolved_at": keep_old})
    ids = of_record.select("rid", F.col("entity_id").alias("company_id"))
    if m.sectors is not None:
        names = m.sectors.join(ids, "rid").select("company_id", F.trim("name").alias("name"), X.slugify(F.trim("name")).alias("slug")).where("slug <> ''")
        fresh = names.groupBy("slug").agg(F.min("name").alias("name")).withColumn("_order", number(F.col("slug")))
        all_names = cut(t["sector_names"].unionByName(insert_missing(t["sector_names"], fresh, ["slug"], "id", "_order").select("id", "slug", "name")))
        mine = names.join(all_names.select("slug", F.col("id").alias("sector_id")), "slug").select("company_id", "sector_id")
        changes |= {"sector_names": all_names, "sectors": t["sectors"].unionByName(mine).distinct()}
    if m.places is not None:
        spots = m.places.join(ids, "rid").select("company_id", "city", "state", "country", "n")
        key = ["city", "state", "country"]
        full = lambda df: df.select(*[c for c in df.columns if c not in key], *[F.coalesce(c, F.lit("")).alias(c) for c in key])
        fresh = full(spots).select(*key).distinct().withColumn("_order", number(F.concat_ws("|", *key)))
        old = full(t["places"])
        all_places = cut(old.select("id", *key, "metro").unionByName(insert_missing(old, fresh, key, "id", "_order").select("id", *key, F.lit(None).cast("string").alias("metro"))))
        # stored headquarters stay; the first place of a record is one
        mine = full(spots).join(all_places.select(F.col("id").alias("location_id"), *key), key).groupBy("company_id", "location_id").agg(F.min("n").alias("n"))
        changes |= {"places": all_places, "locations": upsert(t["locations"], mine.select("company_id", "location_id", (F.col("n") == 0).alias("is_hq")), ["company_id", "location_id"], {"is_hq": lambda o, n: F.coalesce(o, F.lit(False)) | n})}
    if m.rounds is not None:
        seen = m.rounds.join(ids, "rid").where("amount_usd IS NOT NULL OR announced_date IS NOT NULL").withColumn("_order", F.col("rid").cast("double"))
        # the same round is one of that kind and day
        seen = seen.groupBy("company_id", "round_type", "announced_date").agg(F.max("amount_usd").alias("amount_usd"), F.min("_order").alias("_order"))
        same = lambda df: df.withColumn("_day", F.coalesce(F.col("announced_date").cast("string"), F.lit("")))
        new = insert_missing(same(t["rounds"]), same(seen), ["company_id", "round_type", "_day"], "id", "_order")
        changes["rounds"] = t["rounds"].unionByName(new.select("id", "company_id", "round_type", "amount_usd", "announced_date"))
    if m.people is not None:
        seen = m.people.join(ids, "rid").withColumn("_low", F.lower("full_name")).groupBy("company_id", "_low").agg(F.min_by(F.struct("full_name", "title"), "rid").alias("p"), F.min("rid").cast("double").alias("_order"))
        new = insert_missing(t["people"].withColumn("_low", F.lower("full_name")), seen.select("company_id", "_low", "p.*", "_order"), ["company_id", "_low"], "id", "_order")
        changes["people"] = t["people"].unionByName(new.select("id", "company_id", "full_name", "title", F.lit(None).cast("string").alias("linkedin_url")))
    if m.jobs is not None:
        seen = m.jobs.join(ids, "rid").groupBy("company_id", "external_id").agg(F.max_by(F.struct("title", "url", "location_text", "posted_at"), "rid").alias("j"), F.max("rid").alias("_r"))
        seen = cut(seen.select("company_id", "external_id", "j.*", F.lit(source).alias("connector"), now.alias("last_seen_at"), number(F.concat_ws("|", "company_id", "external_id")).alias("_order")))
        old = t["jobs"]
        again = upsert(old, seen.join(old.select("company_id", "external_id"), ["company_id", "external_id"], "left_semi").withColumn("closed_at", F.lit(None).cast("timestamp")), ["company_id", "external_id"], {"id": keep_old, "first_seen_at": keep_old, "posted_at": coalesce_new, "closed_at": reset})
        new = insert_missing(old, seen, ["company_id", "external_id"], "id", "_order").withColumn("first_seen_at", now).withColumn("closed_at", F.lit(None).cast("timestamp"))
        jobs = again.unionByName(new.select(*old.columns))
        whole = ids.join(m.complete, "rid").select(F.col("company_id").alias("_whole")).distinct()
        jobs = cut(jobs.join(whole, F.col("company_id") == F.col("_whole"), "left"))
        changes["jobs"] = close_missing(jobs, seen, ["company_id", "external_id"], "closed_at", now, scope=F.col("_whole").isNotNull() & (F.col("connector") == source)).select(*old.columns)
    touched = ids.select(F.col("company_id").alias("id")).distinct()
    changes["companies"] = refresh_denormalized(changes["companies"], changes.get("jobs", t["jobs"]), changes.get("rounds", t["rounds"]), touched)
    return changes, of_record


def refresh(db: Database, source: str, path: str, *, now: datetime, since: date | None = None) -> int:
    """Runs a source on its saved payloads and returns the run's id; what goes wrong is in its row, not raised.

    Payloads fetched since ``since`` are read, else those since ``OVERLAP`` days
    before the last run that read anything, else all.
    """
    if source not in MAPPED:
        raise KeyError(f"no refresh for {source!r}; known: {', '.join(MAPPED)}")
    if now.tzinfo is None:
        raise ValueError("now needs a time zone")
    spark, ids = db.spark, []

    def begin(s: Snapshot) -> dict[str, DataFrame]:
        top = s["runs"].agg(F.max("id")).first()[0] or 0
        ids[:] = [top + 1, runs.anchor(s["runs"], source).first()[0]]
        return {"runs": s["runs"].unionByName(runs.started(spark, top + 1, source, now))}

    db.commit(begin)
    run, last = ids
    start = datetime(since.year, since.month, since.day, tzinfo=UTC) if since else last and last.astimezone(UTC) - timedelta(days=OVERLAP)
    fetched = upserted = 0
    errors: list[str] = []
    problems: list[str] = []
    try:
        rows = cut(scanned(spark, source, path, start))
        mapped = MAPPED[source](source, rows)
        fetched = mapped.records.count()
        counts: list[int] = []

        def merge(s: Snapshot) -> dict[str, DataFrame]:
            changes, of_record = changed(s, source, mapped, F.lit(now))
            counts[:] = [of_record.count()]
            return changes

        db.commit(merge)
        upserted = counts[0]
        if "problem" in rows.columns and (bad := rows.where("problem IS NOT NULL").count()):
            problems.append(f"{bad} payloads: no issuer")
    except Exception as e:  # the run's row tells what went wrong
        errors.append(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    db.commit(lambda s: {"runs": cut(runs.completed(s["runs"], run, now, fetched, upserted, errors, problems))})
    return run
