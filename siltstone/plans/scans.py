"""Each kind of source read as a Spark data source from an archive of payloads made from the driver's tables."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.database import Database
from siltstone.operators.refresh import SCHEMAS, refresh
from siltstone.operators.schedule import Schedule
from siltstone.plans import Tables, query
from siltstone.sources import connector
from siltstone.sources.cache import ResponseCache
from siltstone.sources.regions import ALIASES, Regions, violations
from siltstone.store import scratch
from siltstone.streaming import slots

text = lambda c: c.cast("string")


def archived(t: Tables, source: str, rows: DataFrame, **options: object) -> DataFrame:
    """``rows`` (name, target, payload) written as the source's archive, and scanned from there."""
    path = scratch(t.spark, source)
    rows.select("name", "target", F.lit("2026-01-01").cast("timestamp").alias("fetched_at"), "payload").write.option("parquet.block.size", 8 << 20).parquet(path)
    return connector.scan(t.spark, source, path, **options)


@query(
    "SELECT CAST(o_custkey AS VARCHAR) AS target, CAST(o_orderkey AS VARCHAR) AS external_id, 'Job ' || o_orderstatus || ' ' || o_orderkey % 9 AS title, o_orderkey % 2 = 0 AS is_remote, date_trunc('day', o_orderdate) AS posted_at, 'Pay ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS description_raw FROM orders WHERE o_orderkey % 7 <> 0"
)
def scan_board(t: Tables) -> DataFrame:
    """One board for each customer; jobs without an id are dropped."""
    k = F.col("o_orderkey")
    job = F.struct(
        F.when(k % 7 != 0, k).alias("id"), F.concat(F.lit("Job "), "o_orderstatus", F.lit(" "), text(k % 9)).alias("title"), F.struct(F.when(k % 2 == 0, "Remote").otherwise("Oslo").alias("name")).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("updated_at"), F.concat(F.lit("&lt;p&gt;Pay "), text(F.floor("o_totalprice")), F.lit("&lt;/p&gt;")).alias("content"),
    )
    boards = t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload"))
    got = archived(t, "greenhouse", boards.select(F.lit("jobs.json").alias("name"), text(F.col("o_custkey")).alias("target"), "payload"))
    return got.select("target", "external_id", "title", "is_remote", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "description_raw")


@query(
    "SELECT c_name AS name, 'c' || c_custkey AS external_id, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey || '.com' END AS domain, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS INTEGER) END AS employee_est, list_filter([c_mktsegment, 'YC W' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0')], lambda s: s IS NOT NULL) AS sectors FROM customer"
)
def scan_directory(t: Tables) -> DataFrame:
    """A result page for each nation's customers."""
    k = F.col("c_custkey")
    hit = F.struct(
        F.col("c_name").alias("name"), F.concat(F.lit("c"), text(k)).alias("slug"), F.when(k % 2 == 0, F.concat(F.lit("https://www.C"), text(k), F.lit(".com/about"))).alias("website"), F.when(k % 3 == 0, text(k)).otherwise("many").alias("team_size"),
        F.array("c_mktsegment").alias("industries"), F.concat(F.lit("Winter 20"), F.lpad(text(k % 30), 2, "0")).alias("batch"),
    )
    pages = t.customer.groupBy("c_nationkey").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(hit).alias("hits"))).alias("results"))).alias("payload"))
    got = archived(t, "ycombinator", pages.select(F.concat(F.lit("page-"), text(F.col("c_nationkey"))).alias("name"), F.lit(None).cast("string").alias("target"), "payload"))
    return got.select("name", "external_id", "domain", "employee_est", "sectors")


def tag(name: str, *inner: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))


@query(
    "SELECT 'f' || c_custkey AS filing, CAST(c_custkey AS VARCHAR) AS cik, c_name AS name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS sold, CASE WHEN c_custkey % 4 = 0 THEN 'debt' WHEN c_custkey % 4 = 1 THEN 'safe' ELSE 'unknown' END AS round_type, ['Ada ' || c_nationkey] AS people FROM customer WHERE c_custkey % 5 <> 0"
)
def scan_filings(t: Tables) -> DataFrame:
    """One filing as XML for each customer; those without an issuer's name are problems."""
    k = F.col("c_custkey")
    issuer = tag("primaryIssuer", tag("cik", text(k)), F.when(k % 5 != 0, tag("entityName", F.col("c_name"))).otherwise(""))
    person = tag("relatedPersonInfo", tag("relatedPersonName", F.lit("<firstName>Ada</firstName>"), tag("lastName", text(F.col("c_nationkey")))))
    kinds = F.when(k % 4 == 0, "<isDebtType>true</isDebtType>").when(k % 4 == 1, "<isEquityType>true</isEquityType><descriptionOfOtherType>a SAFE</descriptionOfOtherType>").otherwise("<isEquityType>true</isEquityType>")
    xml = tag("edgarSubmission", issuer, tag("relatedPersonsList", person), tag("offeringData", tag("typesOfSecuritiesOffered", kinds), tag("offeringSalesAmounts", tag("totalAmountSold", text(F.floor(F.abs("c_acctbal")))))))
    got = archived(t, "sec_edgar", t.customer.select(F.lit("primary_doc.xml").alias("name"), F.concat(F.lit("f"), text(k)).alias("target"), xml.alias("payload")))
    return got.where("problem IS NULL").select(F.col("target").alias("filing"), "cik", "name", "sold", "round_type", F.transform("people", lambda p: p["full_name"]).alias("people"))


@query(
    """SELECT CAST(o_custkey AS VARCHAR) AS target, CAST(o_orderkey AS VARCHAR) AS external_id, 'Acme raises ' || o_orderkey AS title, date_trunc('day', o_orderdate) AS published_at
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 5 AND o_orderkey % 6 <> 0 AND date_trunc('day', o_orderdate) >= TIMESTAMP '1997-01-01' - INTERVAL 400 DAY"""
)
def scan_feed(t: Tables) -> DataFrame:
    """A feed for each customer: its first items, those with a title, cut by age."""
    k = F.col("o_orderkey")
    date = F.date_format("o_orderdate", "EEE, dd MMM yyyy '00:00:00 GMT'")
    item = tag("item", F.when(k % 6 != 0, tag("title", F.lit("Acme raises "), text(k))).otherwise(""), tag("guid", text(k)), tag("pubDate", date))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), item.alias("x")))), lambda s: s["x"]), "")
    feeds = t.orders.groupBy("o_custkey").agg(tag("rss", tag("channel", items)).alias("payload"))
    path = scratch(t.spark, "funding_rss")
    feeds.select(F.lit("feed.xml").alias("name"), text(F.col("o_custkey")).alias("target"), F.lit("1997-01-01").cast("timestamp").alias("fetched_at"), "payload").write.parquet(path)
    rows = connector.payloads(t.spark, "funding_rss", path)
    got = connector.MAPPERS["funding_rss"](rows, ["target"], F.lit("1997-01-01").cast("timestamp"), cap=5, days=400)
    return got.select("target", "external_id", "title", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(
    """WITH k AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), s AS (SELECT DISTINCT user_id FROM events ORDER BY user_id DESC LIMIT 3)
SELECT user_id AS story, event_id AS comment, 'Acme ' || event_id AS name, 'acme' || event_id || '.com' AS domain FROM k WHERE user_id IN (SELECT user_id FROM s) AND n <= 500 AND event_id % 4 <> 0"""
)
def scan_threads(t: Tables) -> DataFrame:
    """Hiring threads and their comments, one item a payload; companies from the comments' headers."""
    k = F.col("event_id")
    kids = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("kids"))
    stories = kids.select(F.to_json(F.struct((F.col("user_id") + 10_000_000).alias("id"), F.col("user_id").alias("time"), "kids", F.lit("Ask HN: Who is hiring? (May)").alias("title"))).alias("payload"))
    line = F.concat(F.lit("<p>Acme "), text(k), F.lit(" | https://acme"), text(k), F.lit(".com/ | Remote</p>"))
    comments = t.events.select(F.to_json(F.struct(k.alias("id"), line.alias("text"), (k % 4 == 0).alias("deleted"))).alias("payload"))
    items = stories.unionByName(comments).select(F.lit("item").alias("name"), F.lit(None).cast("string").alias("target"), "payload")
    return archived(t, "hn_hiring", items).select((F.col("story") - 10_000_000).alias("story"), "comment", "name", "domain")


@query("SELECT count(*) AS pages, CAST('h' || page_id % 50 || '.com' AS VARCHAR) AS domain FROM pages GROUP BY 2")
def scan_sites(t: Tables) -> DataFrame:
    """The raw pages dealt to fifty sites, one row for each site."""
    site = F.concat(F.lit("h"), text(F.col("page_id") % 50), F.lit(".com"))
    got = archived(t, "company_site", t.pages.select(F.concat(text(F.col("page_id")), F.lit(".html")).alias("name"), site.alias("target"), F.col("html").alias("payload")))
    return got.select("pages", "domain")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name, CAST(o_custkey AS VARCHAR) AS target FROM orders WHERE o_custkey = 7 OR o_orderkey < 0")
def scan_pushed(t: Tables) -> DataFrame:
    """Filters on target leave out payloads, and without the payload column no text is read."""
    path = scratch(t.spark, "lever")
    t.orders.select(text(F.col("o_orderkey")).alias("name"), text(F.col("o_custkey")).alias("target"), F.lit("2026-01-01").cast("timestamp").alias("fetched_at"), F.col("o_comment" if "o_comment" in t.orders.columns else "o_orderpriority").alias("payload")).write.parquet(path)
    return connector.payloads(t.spark, "lever", path, columns="name, target").where(F.col("target") == "7")


@query(
    """SELECT c_name AS name, 'c' || c_custkey || '.com' AS domain, CASE WHEN c_custkey % 3 <> 0 THEN 'line ' || c_custkey END AS one_liner, 1 AS sectors, CASE WHEN c_custkey % 2 = 0 THEN count(o_orderkey) ELSE 0 END AS open_job_count,
CASE WHEN c_custkey % 2 = 0 THEN max(CAST(o_orderdate AS DATE)) END AS latest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name"""
)
def refresh_sources(t: Tables) -> DataFrame:
    """Customers with even keys are stored, with a board's token; a directory has all of them, boards have their orders as jobs."""
    spark, k = t.spark, F.col("c_custkey")
    name = lambda c: F.concat(F.lit("c"), text(c), F.lit(".com"))
    db = Database(spark, scratch(spark, "refresh"), SCHEMAS)
    empty = db.snapshot()["companies"]
    have = {"id": k, "name": F.col("c_name"), "normalized_name": F.lower("c_name"), "domain": name(k), "ats_provider": F.lit("greenhouse"), "ats_token": text(k), "open_job_count": F.lit(0)}
    db.commit(lambda s: {"companies": t.customer.where(k % 2 == 0).select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema])})
    hit = F.struct(F.col("c_name").alias("name"), F.concat(F.lit("s"), text(k)).alias("slug"), F.concat(F.lit("https://"), name(k)).alias("website"), F.when(k % 3 != 0, F.concat(F.lit("line "), text(k))).alias("one_liner"), F.array("c_mktsegment").alias("industries"))
    pages = t.customer.groupBy("c_nationkey").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(hit).alias("hits"))).alias("results"))).alias("payload"))
    job = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.lit("Job "), "o_orderstatus").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("updated_at"))
    boards = t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload"))
    fetched = F.lit("2026-01-01").cast("timestamp").alias("fetched_at")
    for source, rows in (("ycombinator", pages.select(text(F.col("c_nationkey")).alias("name"), F.lit(None).cast("string").alias("target"), fetched, "payload")), ("greenhouse", boards.select(F.lit("jobs.json").alias("name"), text(F.col("o_custkey")).alias("target"), fetched, "payload"))):
        path = scratch(spark, source)
        rows.write.parquet(path)
        refresh(db, source, path, now=datetime(2026, 1, 2, tzinfo=UTC))
    s = db.snapshot()
    sectors = s["sectors"].groupBy(F.col("company_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("sectors"))
    return s["companies"].join(sectors, "id", "left").select("name", "domain", "one_liner", "sectors", "open_job_count", F.to_date("latest_job_posted_at").alias("latest"))


@query(
    """SELECT page_id, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'new' || page_id ELSE 'old' || page_id END AS etag, CASE WHEN page_id % 9 <> 0 THEN page_id % 3 = 0 END AS fresh, CASE WHEN page_id % 9 <> 0 THEN strlen(html) END AS bytes
FROM pages UNION ALL SELECT -page_id - 1, NULL, NULL, NULL FROM pages"""
)
def response_cache(t: Tables) -> DataFrame:
    """Pages stored, every third again two days later, every ninth of these damaged; compacted between; asked for with as many unknown ones."""
    cache, k = ResponseCache(t.spark, scratch(t.spark, "cache")), F.col("page_id")
    url = lambda c: F.concat(F.lit("https://x.example/"), text(c))
    answer = lambda pages, etag: pages.select(url(k).alias("url"), F.lit(200).alias("status_code"), F.create_map(F.lit("a"), F.lit("b")).alias("headers"), F.col("html").cast("binary").alias("body"), F.concat(F.lit(etag), text(k)).alias("etag"), F.lit(None).cast("string").alias("last_modified"))
    cache.put(answer(t.pages, "old"), datetime(2026, 1, 1, tzinfo=UTC))
    cache.compact()
    cache.put(answer(t.pages.where(k % 3 == 0), "new"), datetime(2026, 1, 3, tzinfo=UTC))
    damaged = F.when(F.substring("etag", 4, 20).cast("long") % 9 == 0, F.concat(F.col("body"), F.lit("x").cast("binary"))).otherwise(F.col("body"))
    cache.db.commit(lambda s: {"recent": s["recent"].withColumn("body", damaged)})
    asked = t.pages.select("page_id", url(k).alias("url")).unionByName(t.pages.select((-k - 1).alias("page_id"), url(-k - 1).alias("url")))
    got = cache.get(asked, F.lit("2026-01-03 12:00:00").cast("timestamp"))
    return got.select("page_id", "etag", "fresh", F.octet_length("body").cast("long").alias("bytes"))


@query(
    """SELECT event_id FROM events WHERE minute(ts) % 10 = 0 AND hour(ts) BETWEEN 6 AND 20 AND month(ts) <> 2 AND (day(ts) IN (1, 15) OR dayofweek(ts) BETWEEN 1 AND 3)"""
)
def schedule_fires(t: Tables) -> DataFrame:
    """Events in a minute in which a schedule fires: days of the month or weekdays, since both are restricted."""
    return t.events.where(Schedule.parse("*/10 6-20 1,15 jan,mar-dec mon-wed").matches(F.col("ts"))).select("event_id")


@query(
    """WITH r AS (SELECT metro, city, row_number() OVER (PARTITION BY lower(metro) ORDER BY place) AS n, place FROM (SELECT 'regions.' || lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS place, 'M' || c_nationkey // 2 AS metro, NULL AS city FROM customer GROUP BY c_nationkey)),
c AS (SELECT 'c' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS place, c_name AS city, row_number() OVER (PARTITION BY c_custkey // 7 ORDER BY c_custkey) AS n FROM customer)
SELECT place, 'metro twice' AS rule, metro AS subject FROM r WHERE n > 1 UNION ALL SELECT place, 'city twice', 'City ' || CAST(substr(place, 2) AS BIGINT) // 7 FROM c WHERE n > 1"""
)
def region_rules(t: Tables) -> DataFrame:
    """Customers as cities, seven to a name, their nations as regions, two to a metro: what breaks the rules of a region file."""
    nation = t.customer.select("c_nationkey").distinct()
    regions = nation.select(F.concat(F.lit("regions."), F.lpad(text(F.col("c_nationkey")), 3, "0")).alias("place"), F.concat(F.lit("M"), text(F.floor(F.col("c_nationkey") / 2))).alias("metro"), F.lit(True).alias("enabled"))
    k = F.col("c_custkey")
    cities = t.customer.select(F.concat(F.lit("c"), F.lpad(text(k), 9, "0")).alias("place"), F.lit("M").alias("metro"), F.concat(F.lit("City "), text(F.floor(k / 7))).alias("city"), F.when(k % 2 == 0, "co").otherwise("CO").alias("state"))
    none = t.spark.createDataFrame([], ALIASES)
    return violations(Regions(regions, cities, none, t.spark.createDataFrame([], "place string, rule string, subject string")))


@query(
    """WITH e AS (SELECT event_id, 'h' || user_id % 40 AS host, ts, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, epoch_ms(CAST(max(epoch_us(ts) // 1000 - n * 7200000) OVER (PARTITION BY host ORDER BY n) + n * 7200000 AS BIGINT)) AS slot FROM e WHERE n <= 100"""
)
def host_slots(t: Tables) -> DataFrame:
    """Events as requests of forty hosts: two hours apart each, a hundred at most."""
    rows = t.events.select(F.concat(F.lit("h"), text(F.col("user_id") % 40)).alias("host"), F.col("event_id").alias("id"), F.col("ts").alias("at"), F.lit(7_200_000).cast("long").alias("delay"))
    return slots.admitted(rows, budget=100).select(F.col("id").alias("event_id"), F.col("slot").cast("timestamp_ntz").alias("slot"))
