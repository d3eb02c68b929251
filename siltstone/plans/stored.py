"""Stored tables: commits of several, folds of everything, derived columns kept by differences, lifecycles, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.database import Database
from siltstone.operators import denormal, fold_all, history, vocabulary
from siltstone.plans import Tables, query
from siltstone.store import cut, scratch

ntz = lambda s: F.lit(s).cast("timestamp_ntz")


def fold_inputs(t: Tables) -> dict[str, DataFrame]:
    """Customers as companies; one order of each priority and status as a job, every third starred; one contact for ten customers."""
    k, none = F.col("c_custkey"), lambda kind: F.lit(None).cast(kind)
    text = lambda c: c.cast("string")
    day = F.lit("2026-01-01").cast("timestamp")
    companies = t.customer.select(
        k.alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("normalized_name"), F.when(k % 3 == 0, F.concat(F.lit("d"), text(k))).alias("domain"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("one_liner"),
        F.lit("seed").alias("stage"), F.lit("active").alias("status"), F.when(k % 2 == 0, F.create_map(F.lit("domain"), F.lit("yc"))).otherwise(F.create_map(F.lit("one_liner"), F.lit("sec"))).alias("field_provenance"),
        F.timestamp_add("DAY", (k % 20).cast("int"), day).alias("first_seen_at"), F.timestamp_add("DAY", (k % 20 + 5).cast("int"), day).alias("last_seen_at"),
    )
    one = t.orders.groupBy(F.col("o_custkey").alias("company_id"), F.concat("o_orderpriority", "o_orderstatus").alias("external_id")).agg(F.min_by(F.struct("o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderkey").alias("o"))
    jobs = one.select(F.col("o.o_orderkey").alias("id"), "company_id", "external_id", F.lit("t").alias("title"), F.col("o.o_orderdate").cast("timestamp").alias("posted_at"), day.alias("first_seen_at"), F.when(F.col("o.o_orderstatus") == "F", day).alias("closed_at"))
    contacts = t.customer.select(k.alias("id"), k.alias("company_id"), F.lit("email").alias("kind"), F.concat(F.lit("v"), text(F.floor(k / 10))).alias("value"), F.when(k % 10 == 1, "published").otherwise("constructed").alias("confidence"))
    sources = t.customer.select(k.alias("company_id"), F.lit("lever").alias("connector"), F.when(k % 10 != 0, F.concat(F.lit("x"), text(k))).alias("external_id"), day.alias("last_seen_at"))
    given = {"companies": companies, "jobs": jobs, "bookmarks": jobs.where("id % 3 = 0").select(F.col("id").alias("job_id"), F.concat(F.lit("n"), text(F.col("id"))).alias("note")), "contacts": contacts, "sources": sources}
    out = {}
    for name, ddl in fold_all.SCHEMAS.items():
        empty = t.spark.createDataFrame([], ddl)
        df = given.get(name, empty)
        out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else none("void")).cast(f.dataType).alias(f.name) for f in empty.schema])
    return out | {"companies": denormal.refresh_denormalized(out["companies"], out["jobs"], out["rounds"])}


@query(
    """WITH d AS (SELECT c_custkey AS drop_id, c_custkey - c_custkey % 10 AS keep_id FROM customer WHERE c_custkey % 10 IN (1, 2) AND c_custkey >= 10),
j AS (SELECT min(o_orderkey) AS id, o_custkey AS c, o_orderpriority || o_orderstatus AS x, max(o_orderstatus) AS s, arg_min(o_orderdate, o_orderkey) AS posted FROM orders GROUP BY o_custkey, o_orderpriority || o_orderstatus),
m AS (SELECT j.*, coalesce(keep_id, c) AS k, drop_id, row_number() OVER (PARTITION BY coalesce(keep_id, c), x ORDER BY coalesce(drop_id, -1), id) AS n FROM j LEFT JOIN d ON c = drop_id),
w AS (SELECT k, x, id FROM m WHERE n = 1),
b AS (SELECT w.id AS job, arg_min(m.id, m.n) AS star FROM m JOIN w ON m.k = w.k AND m.x = w.x WHERE m.id % 3 = 0 AND (m.n = 1 OR w.id % 3 <> 0) GROUP BY w.id),
c AS (SELECT c_custkey AS id, coalesce(keep_id, c_custkey) AS k, drop_id, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey END AS domain, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS line FROM customer LEFT JOIN d ON c_custkey = drop_id),
f AS (SELECT k, coalesce(max(domain) FILTER (drop_id IS NULL), arg_min(domain, id) FILTER (domain IS NOT NULL)) AS domain, coalesce(max(line) FILTER (drop_id IS NULL), arg_min(line, id) FILTER (line IS NOT NULL)) AS line FROM c GROUP BY k),
o AS (SELECT k, count(*) AS n, max(posted) AS p FROM m WHERE m.n = 1 AND s <> 'F' GROUP BY k),
r AS (SELECT 'job' AS what, k AS entity, x AS key, CAST(id AS VARCHAR) AS value FROM w
UNION ALL SELECT 'bookmark', job, 'n' || star, NULL FROM b
UNION ALL SELECT 'contact', c_custkey, 'v' || c_custkey // 10, CASE WHEN c_custkey % 10 = 1 OR c_custkey IN (SELECT keep_id FROM d WHERE drop_id % 10 = 1) THEN 'published' ELSE 'constructed' END FROM customer WHERE c_custkey NOT IN (SELECT drop_id FROM d)
UNION ALL SELECT 'source', c_custkey, 'lever', CASE WHEN c_custkey % 10 <> 0 THEN 'x' || c_custkey ELSE (SELECT 'x' || min(drop_id) FROM d WHERE keep_id = c_custkey) END FROM customer WHERE c_custkey NOT IN (SELECT drop_id FROM d)
UNION ALL SELECT 'company', f.k, concat_ws('/', coalesce(domain, '-'), coalesce(line, '-')), concat_ws('/', CAST(coalesce(o.n, 0) AS VARCHAR), coalesce(strftime(p, '%Y-%m-%d'), '-')) FROM f LEFT JOIN o ON f.k = o.k)
SELECT what, entity, key, value FROM r"""
)
def fold_all_tables(t: Tables) -> DataFrame:
    """Customers whose key ends in 1 or 2 are folded into the one before (so 2 into 0, through 1); all tables in one commit, read back."""
    db = Database(t.spark, scratch(t.spark, "fold"), fold_all.SCHEMAS)
    db.commit(lambda s: fold_inputs(t))
    k = F.col("c_custkey")
    decisions = t.customer.where((k % 10).isin(1, 2) & (k >= 10)).select((k - 1).alias("keep_id"), k.alias("drop_id"))
    s = db.commit(lambda s: fold_all.fold_tables({name: s[name] for name in fold_all.SCHEMAS}, decisions, F.lit("2026-02-01").cast("timestamp"))[0])
    row = lambda table, what, entity, key, value: s[table].select(F.lit(what).alias("what"), F.col(entity).alias("entity"), key.alias("key"), value.cast("string").alias("value"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return reduce(
        DataFrame.unionByName,
        [
            row("jobs", "job", "company_id", F.col("external_id"), F.col("id")), row("bookmarks", "bookmark", "job_id", F.col("note"), F.lit(None)), row("contacts", "contact", "company_id", F.col("value"), F.col("confidence")),
            row("sources", "source", "company_id", F.col("connector"), F.col("external_id")),
            row("companies", "company", "id", F.concat_ws("/", dash(F.col("domain")), dash(F.col("one_liner"))), F.concat_ws("/", F.col("open_job_count").cast("string"), dash(F.date_format("latest_job_posted_at", "yyyy-MM-dd")))),
        ],
    )


@query(
    """WITH a AS (SELECT o_custkey AS c, o_orderkey AS id, o_orderstatus <> 'F' AS open, o_orderdate AS posted, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS announced FROM orders WHERE o_orderkey % 5 <> 1),
r AS (SELECT c, id, row_number() OVER (PARTITION BY c ORDER BY announced DESC NULLS LAST, id DESC) AS n FROM a)
SELECT c_custkey AS id, (SELECT count(*) FROM a WHERE c = c_custkey AND open) AS open_job_count, (SELECT max(posted) FROM a WHERE c = c_custkey AND open) AS latest_job_posted_at, r.id AS latest_round_id FROM customer LEFT JOIN r ON c = c_custkey AND n = 1"""
)
def denorm_by_changes(t: Tables) -> DataFrame:
    """Derived columns of the orders before 1997 brought up to those of all, from the rows that came, went or stayed as they were."""
    k = F.col("o_orderkey")
    before, after = t.orders.where((F.col("o_orderdate") < ntz("1997-01-01")) & (k % 5 != 0)), t.orders.where(k % 5 != 1)
    jobs = lambda o: o.select(k.alias("id"), F.col("o_custkey").alias("company_id"), F.col("o_orderdate").alias("posted_at"), ntz("1990-01-01").alias("first_seen_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"))
    rounds = lambda o: o.select(k.alias("id"), F.col("o_custkey").alias("company_id"), F.when(k % 3 != 0, F.to_date("o_orderdate")).alias("announced_date"))
    start = t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("long").alias("latest_round_id"), F.lit(None).cast("timestamp_ntz").alias("latest_job_posted_at"), F.lit(0).cast("long").alias("open_job_count"))
    stored = cut(denormal.refresh_denormalized(start, jobs(before), rounds(before)))
    touched = t.orders.where((k % 5).isin(0, 1) | (F.col("o_orderdate") >= ntz("1997-01-01"))).select(k.alias("id"))
    pair = lambda f: denormal.changes(f(before), f(after), touched)
    return denormal.apply_changes(stored, pair(jobs), pair(rounds), jobs(after), rounds(after)).select("id", "open_job_count", "latest_job_posted_at", "latest_round_id")


SCANS = ("1994-01-01", "1995-01-01", "1996-01-01", "1997-01-01", "1998-01-01")


def scan_of(t: Tables, n: int) -> DataFrame:
    """What the n-th snapshot of orders has: those before its day, less some that come and go."""
    return t.orders.where((F.col("o_orderdate") < ntz(SCANS[n])) & (F.col("o_orderkey") % (n + 2) != 0)).select("o_orderkey")


_SCANNED = " UNION ALL ".join(f"SELECT o_orderkey, {n} AS n FROM orders WHERE o_orderdate < TIMESTAMP '{day}' AND o_orderkey % {n + 2} <> 0" for n, day in enumerate(SCANS))
_DAYS = ", ".join(f"TIMESTAMP '{d}'" for d in SCANS)


@query(
    f"""WITH s AS ({_SCANNED}), i AS (SELECT *, n - row_number() OVER (PARTITION BY o_orderkey ORDER BY n) AS island FROM s), p AS (SELECT o_orderkey, min(n) AS a, max(n) AS b FROM i GROUP BY o_orderkey, island)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY a) AS INTEGER) AS period, [{_DAYS}][a + 1] AS opened, [{_DAYS}, NULL][b + 2] AS closed FROM p"""
)
def lifecycle_history(t: Tables) -> DataFrame:
    """Opened, closed and reopened periods of orders, folded from five snapshots one after the other."""
    out = t.spark.createDataFrame([], "o_orderkey bigint, period int, opened timestamp_ntz, closed timestamp_ntz")
    for n, day in enumerate(SCANS):
        out = cut(history.advance(out, scan_of(t, n), ["o_orderkey"], ntz(day)))
    return out


@query(f"WITH s AS ({_SCANNED}) SELECT o_orderkey FROM s WHERE n = 2")
def history_as_of(t: Tables) -> DataFrame:
    """What was there between the third snapshot and the fourth, from the periods of all."""
    seen = reduce(DataFrame.unionByName, [scan_of(t, n).withColumn("at", ntz(day)) for n, day in enumerate(SCANS)])
    scans = t.spark.createDataFrame([(d,) for d in SCANS], "at string").select(F.col("at").cast("timestamp_ntz").alias("at"))
    return history.as_of(history.periods(seen, scans, ["o_orderkey"], "at"), ntz("1996-06-01")).select("o_orderkey")


@query(
    """SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '4-NOT SPECIFIED' THEN 5 WHEN '5-LOW' THEN 6 ELSE 3 END AS INTEGER) AS before,
CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 5 WHEN '4-NOT SPECIFIED' THEN 6 END AS INTEGER) AS after FROM orders"""
)
def vocabulary_edit(t: Tables) -> DataFrame:
    """The places of orders' priorities before and after one is added first and one is removed with its rows; the old version is read again."""
    db = Database(t.spark, scratch(t.spark, "vocabulary"), {vocabulary.TABLE: vocabulary.SCHEMA, "orders": "o_orderkey bigint, o_orderpriority string"})
    db.commit(lambda s: {"orders": t.orders.select("o_orderkey", "o_orderpriority")})
    old = vocabulary.create(db, "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "unused", "4-NOT SPECIFIED", "5-LOW"])
    vocabulary.add(db, "priority", "0-NOW")
    vocabulary.add(db, "priority", "2b", after="2-HIGH")
    vocabulary.remove(db, "priority", "unused", [("orders", "o_orderpriority")])
    vocabulary.remove(db, "priority", "5-LOW", [("orders", "o_orderpriority")])
    placed = lambda s, name: s["orders"].select("o_orderkey", vocabulary.place(s, "priority", F.col("o_orderpriority")).alias(name))
    return placed(db.snapshot(old), "before").join(placed(db.snapshot(), "after"), "o_orderkey", "left")
