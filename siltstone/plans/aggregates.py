"""Aggregates, windows and run health.

Events are runs: the user is the source, an ``error`` event a failed run, a
``signup`` one a partial run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.operators import health as H
from siltstone.plans import Tables, query
from siltstone.plans.lists import JOBS_SQL, LATEST, jobs, latest_orders




@query("SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS suppliers FROM nation")
def correlated_count(t: Tables) -> DataFrame:
    c = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("customers"))
    s = t.supplier.where(F.col("s_acctbal") > 5000).groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    zero = F.lit(0).cast("long")
    return t.nation.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_nationkey", F.coalesce("customers", zero).alias("customers"), F.coalesce("suppliers", zero).alias("suppliers"))


@query(f"WITH {JOBS_SQL} SELECT company_id, role_family, count(*) AS open_roles FROM jobs WHERE closed_at IS NULL GROUP BY 1, 2")
def group_count(t: Tables) -> DataFrame:
    return jobs(t).where(F.col("closed_at").isNull()).groupBy("company_id", "role_family").agg(F.count(F.lit(1)).alias("open_roles"))


@query("SELECT user_id, max(ts) AS last_ok FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id")
def group_max(t: Tables) -> DataFrame:
    return t.events.where(~F.col("event_type").isin("error", "signup")).groupBy("user_id").agg(F.max("ts").alias("last_ok"))


@query("SELECT max(ts) AS anchor FROM events WHERE event_type <> 'error' AND user_id = 7")
def scalar_max(t: Tables) -> DataFrame:
    return t.events.where((F.col("event_type") != "error") & (F.col("user_id") == 7)).agg(F.max("ts").alias("anchor"))


@query("SELECT r_name, count(DISTINCT c_custkey) AS companies FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def count_distinct(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count_distinct("c_custkey").alias("companies"))


@query("SELECT DISTINCT c_mktsegment FROM customer ORDER BY 1")
def distinct_facet(t: Tables) -> DataFrame:
    return t.customer.select("c_mktsegment").distinct().orderBy("c_mktsegment")


@query("WITH m AS (SELECT r_name, count(DISTINCT c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT list(r_name ORDER BY n DESC, r_name) AS metros, list(n ORDER BY n DESC, r_name) AS counts FROM m")
def ordered_arrays(t: Tables) -> DataFrame:
    """Two arrays in one order: by count, then name."""
    both = F.array_sort(F.collect_list(F.struct((-F.col("companies")).alias("n"), "r_name")))
    return count_distinct(t).agg(both.alias("b")).select(F.transform("b", lambda x: x["r_name"]).alias("metros"), F.transform("b", lambda x: -x["n"]).alias("counts"))


@query("SELECT user_id, list(DISTINCT event_type ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def ordered_list(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS d FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey DESC) AS n FROM o)
SELECT c_custkey, o_orderkey AS latest, d AS announced FROM customer LEFT JOIN r ON o_custkey = c_custkey AND n = 1"""
)
def latest_per_group(t: Tables) -> DataFrame:
    d = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    best = t.orders.withColumn("d", d).groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "d"), F.struct(F.col("d").isNotNull(), "d", "o_orderkey")).alias("b"))
    return t.customer.join(best, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.col("b.o_orderkey").alias("latest"), F.col("b.d").alias("announced"))


@query(
    """SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS funded, (SELECT count(*) FROM orders) AS rounds, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_rounds,
(SELECT count(*) FROM lineitem) AS jobs, (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O') AS open_jobs, (SELECT count(*) FROM supplier) AS people, (SELECT count(DISTINCT n_regionkey) FROM nation) AS metros"""
)
def stats_one_row(t: Tables) -> DataFrame:
    """One pass for each table; single rows side by side."""
    n, one = F.count(F.lit(1)), F.count_if
    parts = [t.customer.agg(n.alias("companies"), one(F.col("c_acctbal") > 0).alias("funded")), t.orders.agg(n.alias("rounds"), one(F.col("o_orderstatus") == "O").alias("open_rounds")), t.lineitem.agg(n.alias("jobs"), one(F.col("l_linestatus") == "O").alias("open_jobs")), t.supplier.agg(n.alias("people")), t.nation.agg(F.count_distinct("n_regionkey").alias("metros"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


@query("SELECT count(*) AS fresh FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 7 DAY")
def intake_7d(t: Tables) -> DataFrame:
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    return t.orders.crossJoin(F.broadcast(now)).agg(F.count_if(F.col("o_orderdate") >= F.col("now") - F.expr("interval 7 days")).alias("fresh"))


@query("SELECT p_partkey, p_name, p_brand FROM part QUALIFY count(*) OVER (PARTITION BY p_name, p_brand, p_size) = 1")
def unique_in_group(t: Tables) -> DataFrame:
    """Parts that are alone with their name, brand and size."""
    alone = t.part.groupBy("p_name", "p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("p_partkey")).where(F.col("n") == 1)
    return alone.select("p_partkey", "p_name", "p_brand")


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 15 THEN 'error' WHEN count(*) FILTER (event_type = 'signup') > 12 THEN 'partial' ELSE 'ok' END AS status FROM events GROUP BY user_id")
def status_rollup(t: Tables) -> DataFrame:
    e, p = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "signup")
    return t.events.groupBy("user_id").agg(H.status_of(e - 15, p - 12).alias("status"))


STREAKS = "streaks AS (SELECT user_id, count(*) AS streak FROM (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS good FROM events) WHERE good = 0 GROUP BY user_id)"


def streaks(t: Tables) -> DataFrame:
    return H.failure_streaks(t.events, "user_id", F.col("event_type") == "error", [F.desc("ts"), F.desc("event_id")])


@query(f"WITH {STREAKS} SELECT user_id, streak FROM streaks")
def failure_streak(t: Tables) -> DataFrame:
    return streaks(t)


@query(
    f"""WITH {STREAKS}, ok AS (SELECT user_id, max(ts) AS last_ok FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1), s AS (SELECT DISTINCT user_id FROM events), n AS (SELECT max(ts) AS now FROM events)
SELECT s.user_id, coalesce(streak, 0) AS streak, coalesce(streak, 0) >= 3 AS failing, last_ok IS NULL OR epoch(now) - epoch(last_ok) > 2 * 43200 AS stale FROM s LEFT JOIN ok ON s.user_id = ok.user_id LEFT JOIN streaks ON s.user_id = streaks.user_id CROSS JOIN n"""
)
def run_health(t: Tables) -> DataFrame:
    now = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    last = t.events.where(~F.col("event_type").isin("error", "signup")).groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_ok"))
    sources = t.events.select("user_id").distinct().crossJoin(F.broadcast(now))
    return H.run_health(sources, "user_id", last, streaks(t), F.col("now"), F.lit(43200)).select("user_id", "streak", "failing", "stale")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def cap_per_group(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.withColumn("n", F.row_number().over(w)).where(F.col("n") <= 5).select("user_id", "event_id")


@query("SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY first) AS kinds FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1")
def ordered_distinct(t: Tables) -> DataFrame:
    from siltstone.functions.text import ordered_distinct as joined

    rows = t.orders.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"]).alias("all"))
    return rows.select("o_custkey", joined(F.col("all")).alias("kinds"))


@query("WITH r AS (SELECT user_id, event_type || ':' || event_id AS m, sum(length(event_type || ':' || event_id) + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS upto, event_id FROM events WHERE event_type = 'error') SELECT user_id, string_agg(m, chr(10) ORDER BY event_id) FILTER (upto <= 60) AS error_text, count(*) FILTER (upto > 60) AS more FROM r GROUP BY 1")
def capped_join(t: Tables) -> DataFrame:
    """Messages joined up to a length, and how many are left out."""
    bad = t.events.where(F.col("event_type") == "error").withColumn("m", F.concat_ws(":", "event_type", "event_id"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    bad = bad.withColumn("upto", F.sum(F.length("m") + 1).over(w))
    kept = F.when(F.col("upto") <= 60, F.struct("event_id", "m"))
    return bad.groupBy("user_id").agg(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda s: s["m"]), "\n"), F.lit("")).alias("error_text"), F.count_if(F.col("upto") > 60).alias("more"))


@query("SELECT c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal NULLS FIRST, c_custkey) <= 10 AND c_acctbal < 9000")
def budgeted_topn(t: Tables) -> DataFrame:
    w = W.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").asc_nulls_first(), "c_custkey")
    return t.customer.withColumn("n", F.row_number().over(w)).where((F.col("n") <= 10) & (F.col("c_acctbal") < 9000)).select("c_custkey")


@query("SELECT event_id, user_id FROM (SELECT *, max(CASE WHEN value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stop FROM events) WHERE stop = 0")
def stop_at_first(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return t.events.withColumn("stop", F.max(F.when(F.col("value") > 90, 1).otherwise(0)).over(w)).where(F.col("stop") == 0).select("event_id", "user_id")


@query("SELECT event_type, reason, count(*) AS n FROM (SELECT event_type, CASE WHEN value < 10 THEN 'small' WHEN user_id % 5 = 0 THEN 'out_of_region' WHEN row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) > 1 THEN 'duplicate' ELSE 'read' END AS reason FROM events) GROUP BY 1, 2")
def reject_reasons(t: Tables) -> DataFrame:
    w = W.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    reason = F.when(F.col("value") < 10, "small").when(F.col("user_id") % 5 == 0, "out_of_region").when(F.row_number().over(w) > 1, "duplicate").otherwise("read")
    return t.events.select("event_type", reason.alias("reason")).groupBy("event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LATEST}, {JOBS_SQL}, j AS (SELECT company_id, count(*) AS n, max(coalesce(CASE WHEN id % 3 <> 0 THEN posted_at END, TIMESTAMP '1990-01-01')) AS p FROM jobs WHERE closed_at IS NULL GROUP BY 1) SELECT c_custkey, coalesce(j.n, 0) AS open_job_count, p AS latest_job_posted_at, o_orderkey AS latest_round_id FROM customer LEFT JOIN j ON company_id = c_custkey LEFT JOIN latest ON o_custkey = c_custkey AND latest.n = 1")
def denorm_refresh(t: Tables) -> DataFrame:
    """Derived columns from open jobs and rounds, one pass over each."""
    posted = F.coalesce(F.when(F.col("id") % 3 != 0, F.col("posted_at")), F.lit("1990-01-01").cast("timestamp_ntz"))
    j = jobs(t).where(F.col("closed_at").isNull()).groupBy(F.col("company_id").alias("c_custkey")).agg(F.count(F.lit(1)).alias("open_job_count"), F.max(posted).alias("latest_job_posted_at"))
    r = latest_orders(t).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("latest_round_id"))
    return t.customer.select("c_custkey").join(j, "c_custkey", "left").join(r, "c_custkey", "left").withColumn("open_job_count", F.coalesce("open_job_count", F.lit(0).cast("long")))
