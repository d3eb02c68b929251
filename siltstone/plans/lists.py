"""Filters, joins, sorts and pages.

Stand-ins: customers are companies (balance as a nullable amount, segment as
stage), orders are rounds, line items are jobs (open when the line status is
O), nations and regions are cities and metros, labels are notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import browse as B
from siltstone.operators.page_store import combinations, some
from siltstone.plans import Tables, page_store, query

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def companies(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("stage"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("amount_usd"), "c_nationkey")


def jobs(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("company_id"))
    return t.lineitem.join(o, "l_orderkey").select(
        "company_id", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("role_family"), F.col("l_linestatus").alias("seniority"), F.col("l_quantity").alias("quantity"),
        (F.col("l_tax") > 0.04).alias("flexible_signal"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("closed_at"), F.col("l_shipdate").alias("posted_at"),
    )


JOBS_SQL = "jobs AS (SELECT o_custkey AS company_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS role_family, l_linestatus AS seniority, l_quantity AS quantity, l_tax > 0.04 AS flexible_signal, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS closed_at, l_shipdate AS posted_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_in(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


LATEST = "latest AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders)"


def latest_orders(t: Tables) -> DataFrame:
    """The newest order of each customer: dated before undated, then the highest key."""
    best = F.max_by(F.struct("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"), F.struct(F.col("o_orderdate").isNotNull(), "o_orderdate", "o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(best.alias("o")).select("o_custkey", "o.*")


@query(f"WITH {LATEST} SELECT c_custkey, o_orderpriority FROM customer LEFT JOIN latest ON o_custkey = c_custkey AND n = 1 WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_left_join(t: Tables) -> DataFrame:
    return t.customer.join(latest_orders(t), F.col("c_custkey") == F.col("o_custkey"), "left").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("c_custkey", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount_usd FROM customer WHERE c_custkey % 7 <> 0 AND c_acctbal BETWEEN 1000 AND 5000")
def filter_range(t: Tables) -> DataFrame:
    c = companies(t)
    return c.where((F.col("amount_usd") >= 1000) & (F.col("amount_usd") <= 5000)).select(F.col("id").alias("c_custkey"), "amount_usd")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) >= CAST(DATE '1998-03-31' - INTERVAL 13 MONTH AS DATE)")
def filter_months(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate").cast("date") >= F.add_months(F.lit("1998-03-31").cast("date"), -13)).select("o_orderkey", "o_orderdate")


@query(f"WITH {JOBS_SQL} SELECT company_id, count(*) AS open_job_count FROM jobs WHERE closed_at IS NULL GROUP BY company_id HAVING count(*) > 0")
def filter_denorm(t: Tables) -> DataFrame:
    return jobs(t).groupBy("company_id").agg(F.count_if(F.col("closed_at").isNull()).alias("open_job_count")).where(F.col("open_job_count") > 0)


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0 OR l.doc_id IS NULL")
def filter_none_or_null(t: Tables) -> DataFrame:
    notes = t.labels.select(F.col("doc_id").alias("noted"), "quality")
    return t.documents.join(notes, F.col("doc_id") == F.col("noted"), "left").where((F.col("quality") == 0) | F.col("noted").isNull()).select("doc_id", "quality")


@query(f"WITH {JOBS_SQL} SELECT id, company_id FROM jobs WHERE closed_at IS NULL")
def filter_open(t: Tables) -> DataFrame:
    return jobs(t).where(F.col("closed_at").isNull()).select("id", "company_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RING'))")
def filter_icontains(t: Tables) -> DataFrame:
    return t.part.where(F.contains(F.lower("p_name"), F.lower(F.lit("RING")))).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)")
def filter_any(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where(F.col("c_acctbal") > 9000).select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT d.doc_id, coalesce(l.toxic, 0) AS starred FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_default(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).alias("starred"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS good FROM events")
def case_when(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("good"))


@query(
    """SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS company_id, c_name AS company_name, l_returnflag AS role_family, l_linestatus = 'O' AS open, l_shipdate AS posted_at, coalesce(b.starred, false) AS starred
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT s_suppkey, true AS starred FROM supplier WHERE s_acctbal > 5000) b ON b.s_suppkey = l_suppkey"""
)
def job_row(t: Tables) -> DataFrame:
    marks = t.supplier.where(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("starred"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(marks, "l_suppkey", "left")
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("o_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("l_returnflag").alias("role_family"), (F.col("l_linestatus") == "O").alias("open"), F.col("l_shipdate").alias("posted_at"), F.coalesce("starred", F.lit(False)).alias("starred"))


@query(f"WITH {JOBS_SQL} SELECT id, closed_at IS NULL AND role_family IN ('A', 'R') AND flexible_signal AS matched FROM jobs")
def highlight_flag(t: Tables) -> DataFrame:
    f = B.Filters(families=("A", "R"), flexible=True)
    return jobs(t).select("id", (F.col("closed_at").isNull() & B.every(B.job_predicates(f))).alias("matched"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_inner(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 100000) ON o_custkey = c_custkey")
def join_left(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where(F.col("o_totalprice") > 100000), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, seen FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' ORDER BY seen NULLS FIRST, c_custkey")
def targets_worklist(t: Tables) -> DataFrame:
    own = t.orders.where(F.col("o_orderpriority") == "5-LOW").groupBy("o_custkey").agg(F.max("o_orderdate").alias("seen"))
    return t.customer.where(F.col("c_mktsegment") != "MACHINERY").join(own, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "seen").orderBy(F.col("seen").asc_nulls_first(), "c_custkey")


def offices(t: Tables) -> DataFrame:
    """(company, city, metro): where a customer's suppliers are."""
    links = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    places = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return links.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("o_custkey").alias("company_id"), F.col("n_name").alias("city"), F.col("r_name").alias("metro")).distinct()


OFFICES = "offices AS (SELECT DISTINCT o_custkey AS company_id, n_name AS city, r_name AS metro FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _filtered(t: Tables, f: B.Filters) -> DataFrame:
    empty = t.spark.createDataFrame([], "company_id bigint, name string, kind string, confidence string, status string, id bigint, round_type string, amount_usd double, announced_date date")
    return B.filter_companies(companies(t), f, locations=offices(t), sectors=empty, rounds=empty, contacts=empty, notes=empty, jobs=jobs(t), today=F.lit("1998-03-31").cast("date")).select("id")


@query(f"WITH {OFFICES} SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM offices WHERE company_id = c_custkey AND city IN ('NATION_3', 'NATION_7', 'FRANCE', 'CHINA')) ")
def semi_city(t: Tables) -> DataFrame:
    return _filtered(t, B.Filters(cities=("NATION_3", "NATION_7", "FRANCE", "CHINA")))


@query(f"WITH {OFFICES} SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM offices WHERE company_id = c_custkey AND metro IN ('ASIA', 'EUROPE')) AND c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def semi_metro(t: Tables) -> DataFrame:
    return _filtered(t, B.Filters(metros=("ASIA", "EUROPE"), stages=("BUILDING", "AUTOMOBILE")))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = c_custkey AND p_size = 7)")
def semi_sector(t: Tables) -> DataFrame:
    has = t.part.where(F.col("p_size") == 7).join(t.lineitem, F.col("l_partkey") == F.col("p_partkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(has, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1 AND l.toxic = 0)")
def semi_contact(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.where((F.col("quality") == 1) & (F.col("toxic") == 0)), "doc_id", "left_semi").select("doc_id")


@query(f"WITH {JOBS_SQL} SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM jobs WHERE company_id = c_custkey AND role_family IN ('R') AND seniority IN ('F') AND flexible_signal)")
def semi_all_filters(t: Tables) -> DataFrame:
    return _filtered(t, B.Filters(families=("R",), seniorities=("F",), flexible=True, include_closed=True))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti_join(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where(F.col("o_totalprice") > 200000).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query(
    """SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_name AS name_a, b.c_name AS name_b, coalesce(x.n, 0) AS orders_a, coalesce(y.n, 0) AS orders_b
FROM (SELECT c_nationkey, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1) p JOIN customer a ON a.c_custkey = lo JOIN customer b ON b.c_custkey = hi
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) x ON x.o_custkey = lo LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) y ON y.o_custkey = hi WHERE lo < hi"""
)
def pair_summary(t: Tables) -> DataFrame:
    pairs = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).where(F.col("a") < F.col("b")).drop("c_nationkey")
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    for s in ("a", "b"):
        pairs = pairs.join(t.customer.select(F.col("c_custkey").alias(s), F.col("c_name").alias(f"name_{s}")), s).join(n.select(F.col("o_custkey").alias(s), F.col("n").alias(f"orders_{s}")), s, "left")
    return pairs.select("a", "b", "name_a", "name_b", *[F.coalesce(f"orders_{s}", F.lit(0).cast("long")).alias(f"orders_{s}") for s in ("a", "b")])


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS order_ids, count(*) AS n FROM orders GROUP BY o_custkey")
def nested_detail(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("order_ids"), F.count(F.lit(1)).alias("n"))


# --- sorts and pages ----------------------------------------------------------------------

BY_AMOUNT = B.Sort("amount", "amount_usd", descending=True)


def listed(t: Tables) -> DataFrame:
    """What the company list shows and filters by: the latest round, and the kinds of jobs there are."""
    kinds = combinations(jobs(t).withColumn("open", F.col("closed_at").isNull()), "company_id", ["open", "role_family", "seniority", "flexible_signal"]).withColumnRenamed("company_id", "id")
    rounds = latest_orders(t).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("latest_round_id"), F.round("o_totalprice", 4).alias("latest_amount"))
    return companies(t).join(kinds, "id", "left").join(rounds, "id", "left")


@query("SELECT id, amount_usd, name FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount_usd, c_name AS name FROM customer) ORDER BY amount_usd DESC NULLS LAST, id LIMIT 51")
def topk_sorts(t: Tables) -> DataFrame:
    return B.page_of(companies(t), BY_AMOUNT).select("id", "amount_usd", "name")


@query(
    f"""WITH {LATEST}, {JOBS_SQL}, c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS amount_usd, c_name AS name, o_orderkey AS latest_round_id, o_totalprice AS latest_amount FROM customer LEFT JOIN latest ON o_custkey = c_custkey AND n = 1
  WHERE EXISTS (SELECT 1 FROM jobs WHERE company_id = c_custkey AND closed_at IS NULL AND role_family IN ('N') AND flexible_signal))
SELECT id, name, amount_usd, latest_round_id, round(latest_amount, 4) AS latest_amount FROM c WHERE amount_usd < 5000 OR (amount_usd = 5000 AND id > 10) OR amount_usd IS NULL ORDER BY amount_usd DESC NULLS LAST, id LIMIT 51"""
)
def keyset_page(t: Tables) -> DataFrame:
    """The list page: one qualifying open job, the latest round, behind a cursor; from the list kept by amount."""
    store = page_store(t, "companies-by-amount", ("customer", "orders", "lineitem"), lambda: listed(t), BY_AMOUNT)
    fits = some("kinds", lambda k: k["open"], lambda k: k["role_family"] == "N", lambda k: k["flexible_signal"])
    return store.frame(["id", "name", "amount_usd", "latest_round_id", "latest_amount"], B.Cursor("amount", 5000.0, 10), where=fits)


@query("SELECT c_custkey AS id, replace(replace(rtrim(base64(encode('{\"s\":\"id\",\"k\":null,\"i\":' || c_custkey || '}')), '='), '+', '-'), '/', '_') AS cursor FROM customer")
def cursor_codec(t: Tables) -> DataFrame:
    text = F.to_json(F.struct(F.lit("id").alias("s"), F.lit(None).cast("string").alias("k"), F.col("c_custkey").alias("i")), {"ignoreNullFields": "false"})
    return t.customer.select(F.col("c_custkey").alias("id"), F.translate(F.rtrim(F.base64(F.encode(text, "UTF-8")), F.lit("=")), "+/", "-_").alias("cursor"))


@query(f"WITH {JOBS_SQL} SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY (closed_at IS NULL) DESC, quantity DESC NULLS LAST, id) AS position FROM jobs")
def company_jobs(t: Tables) -> DataFrame:
    w = W.partitionBy("company_id").orderBy(F.col("closed_at").isNull().desc(), F.col("quantity").desc_nulls_last(), "id")
    return jobs(t).select("company_id", "id", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 END AS place FROM orders")
def enum_order_sort(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", B.enum_rank(F.col("o_orderpriority"), PRIORITIES).alias("place")).orderBy("place", "o_orderkey")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent_n(t: Tables) -> DataFrame:
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY coalesce(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 END, 99), s_suppkey) AS position FROM supplier")
def rank_people(t: Tables) -> DataFrame:
    role = F.element_at(F.array(F.lit("founder"), F.lit("other"), F.lit("recruiter"), F.lit("other")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    w = W.partitionBy("s_nationkey").orderBy(F.coalesce(B.enum_rank(role, ("founder", "recruiter")), F.lit(99)), "s_suppkey")
    return t.supplier.select("s_suppkey", F.row_number().over(w).cast("long").alias("position"))


@query("SELECT user_id, list(event_type ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 9 END, event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def rank_contacts(t: Tables) -> DataFrame:
    rank = F.coalesce(B.enum_rank(F.col("event_type"), ("view", "click")), F.lit(9))
    kinds = t.events.select("user_id", "event_type").distinct()
    return kinds.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "event_type"))), lambda s: s["event_type"]).alias("kinds"))


@query("SELECT r_name, n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY r_name, n_name, n_nationkey")
def facet_cities(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").orderBy("r_name", "n_name", "n_nationkey")


@query("SELECT c_custkey FROM customer WHERE c_name ILIKE '%17%' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def search_or(t: Tables) -> DataFrame:
    rich = t.orders.where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return t.customer.join(rich, "c_custkey", "left").where(F.contains(F.lower("c_name"), F.lit("17")) | F.col("hit").isNotNull()).select("c_custkey")


@query("SELECT p_partkey, coalesce(p_name, '') || ' ' || coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, '') AS words FROM part")
def search_text(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.search_text(F.col("p_name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))).alias("words"))


@query(f"WITH {OFFICES} SELECT company_id, list(city ORDER BY city) AS cities, count(DISTINCT metro) AS metros FROM offices GROUP BY company_id")
def page_extras(t: Tables) -> DataFrame:
    return offices(t).groupBy("company_id").agg(F.array_sort(F.collect_list("city")).alias("cities"), F.count_distinct("metro").alias("metros"))


@query(f"WITH {OFFICES} SELECT company_id, min(city) FILTER (metro IN ('ASIA')) AS matched, coalesce(min(city) FILTER (metro = 'EUROPE'), min(city)) AS hq FROM offices GROUP BY company_id")
def matched_office(t: Tables) -> DataFrame:
    all_ = F.array_sort(F.collect_list(F.struct("city", "metro")))
    rows = offices(t).groupBy("company_id").agg(all_.alias("o"))
    first = lambda metro: F.get(F.filter("o", lambda x: x["metro"] == metro), 0)["city"]
    return rows.select("company_id", first("ASIA").alias("matched"), F.coalesce(first("EUROPE"), F.get("o", 0)["city"]).alias("hq"))


@query(f"WITH {OFFICES} SELECT company_id, coalesce(min(city) FILTER (metro = 'AMERICA'), min(city)) AS city FROM offices GROUP BY company_id")
def hq_city(t: Tables) -> DataFrame:
    rows = offices(t).groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("city", (F.col("metro") == "AMERICA").alias("is_hq")))).alias("o"))
    return rows.select("company_id", F.coalesce(F.get(F.filter("o", lambda x: x["is_hq"]), 0), F.get("o", 0))["city"].alias("city"))


@query(
    """SELECT c_custkey AS id, c_name AS name, n_name AS city, r_name AS metro, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS rounds
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY lower(c_name), c_custkey LIMIT 51"""
)
def company_page(t: Tables) -> DataFrame:
    """The first page by name, from the list kept in that order."""

    def rows() -> DataFrame:
        n = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("rounds"))
        places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        named = companies(t).withColumn("low", F.lower("name")).join(places, F.col("c_nationkey") == F.col("n_nationkey")).join(n, "id", "left")
        return named.select("id", "name", "low", F.col("n_name").alias("city"), F.col("r_name").alias("metro"), F.coalesce("rounds", F.lit(0).cast("long")).alias("rounds"))

    return page_store(t, "companies-by-name", ("customer", "orders", "nation", "region"), rows, B.Sort("name", "low")).frame(["id", "name", "city", "metro", "rounds"])


@query(f"WITH {JOBS_SQL} SELECT id, company_id, posted_at FROM jobs WHERE closed_at IS NULL AND flexible_signal ORDER BY posted_at DESC NULLS LAST, id LIMIT 51")
def job_page(t: Tables) -> DataFrame:
    """The newest open jobs of a kind, from open jobs kept by date."""
    rows = lambda: jobs(t).where(F.col("closed_at").isNull()).select("id", "company_id", "posted_at", "flexible_signal", "role_family")
    store = page_store(t, "open-jobs-by-date", ("orders", "lineitem"), rows, B.Sort("posted", "posted_at", descending=True))
    return store.frame(["id", "company_id", "posted_at"], where=F.col("flexible_signal"))
