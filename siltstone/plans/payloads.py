"""Raw payloads: JSON, XML and variants made from the driver's tables and read back by the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.plans import Tables, query
from siltstone.sources import boards, feeds
from siltstone.streaming.dedup import once


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY 1".replace("sum(", "CAST(sum(").replace("AS BIGINT)) AS", "AS BIGINT)) AS BIGINT) AS"))
def json_path(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS source, CAST(event_id AS VARCHAR) AS external_id FROM events")
def json_merge(t: Tables) -> DataFrame:
    """A payload with the external id and the source put in, read back."""
    base = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("source"), F.col("event_type"), F.lit("external_id"), F.col("event_id").cast("string"))
    keys = F.map_keys(more)
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(keys, k)), more)
    out = t.events.select("event_id", F.to_json(merged).alias("p"))
    return out.select("event_id", F.get_json_object("p", "$.k").try_cast("long").alias("k"), F.get_json_object("p", "$.source").alias("source"), F.get_json_object("p", "$.external_id").alias("external_id"))


def _hits(t: Tables) -> DataFrame:
    hit = F.struct(
        F.struct(
            F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("a-"), F.col("o_orderkey").cast("string"))).alias("adsh"), F.array(F.col("o_custkey").cast("string")).alias("ciks"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("file_date"), F.when(F.col("o_orderkey") % 3 == 0, "D/A").otherwise("D").alias("form"), F.array(F.lit("New York, NY")).alias("biz_locations"),
        ).alias("_source")
    )
    page = F.struct(F.struct(F.struct(F.lit(1).alias("value"), F.when(F.col("o_custkey") % 2 == 0, "eq").otherwise("gte").alias("relation")).alias("total"), F.collect_list(hit).alias("hits")).alias("hits"))
    return t.orders.groupBy("o_custkey").agg(F.to_json(page).alias("payload"))


@query("SELECT o_custkey, o_custkey % 2 <> 0 AS over_cap, CASE WHEN o_orderkey % 13 <> 0 THEN 'a-' || o_orderkey END AS accession, CAST(o_orderdate AS DATE) AS file_date, CASE WHEN o_orderkey % 3 = 0 THEN 'D/A' ELSE 'D' END AS form, 'New York' AS city, 'NY' AS state FROM orders")
def src_json_hits(t: Tables) -> DataFrame:
    got = feeds.search_hits(_hits(t), ["o_custkey"])
    return got.select("o_custkey", "over_cap", "accession", "file_date", "form", F.col("place.city").alias("city"), F.col("place.state").alias("state"))


@query(
    "SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS cik, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 100 * s_suppkey END AS offered, CASE WHEN s_suppkey % 3 = 0 THEN 'debt' WHEN s_suppkey % 3 = 1 THEN 'safe' ELSE 'unknown' END AS round_type, 2 AS people FROM supplier WHERE s_suppkey % 5 <> 0"
)
def xml_extract(t: Tables) -> DataFrame:
    """Filings written as XML; those without an issuer's name are problems."""
    k = F.col("s_suppkey")
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    num = k.cast("string")
    issuer = tag("primaryIssuer", tag("cik", num), F.when(k % 5 != 0, tag("entityName", F.col("s_name"))).otherwise(""))
    person = tag("relatedPersonInfo", tag("relatedPersonName", F.lit("<firstName>Ada</firstName><lastName>L</lastName>")), F.lit("<relatedPersonRelationshipList><relationship>Director</relationship></relatedPersonRelationshipList>"))
    kinds = tag("typesOfSecuritiesOffered", F.when(k % 3 == 0, "<isDebtType>true</isDebtType>").when(k % 3 == 1, "<isEquityType>true</isEquityType><descriptionOfOtherType>a SAFE</descriptionOfOtherType>").otherwise("<isEquityType>true</isEquityType>"))
    amounts = tag("offeringSalesAmounts", tag("totalOfferingAmount", F.when(k % 2 == 0, (k * 100).cast("string")).otherwise("Indefinite")))
    xml = tag("edgarSubmission", issuer, tag("relatedPersonsList", person, person), tag("offeringData", kinds, amounts))
    got = feeds.form_d(t.supplier.select("s_suppkey", xml.alias("payload")), ["s_suppkey"])
    return got.where(F.col("problem").isNull()).select("s_suppkey", "cik", "name", "offered", "round_type", F.size("people").alias("people"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS external_id, 'Job ' || o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'Remote, US' ELSE 'Berlin' END AS location_text, o_orderkey % 2 = 0 AS is_remote, date_trunc('day', o_orderdate) AS posted_at FROM orders WHERE o_orderkey % 7 <> 0")
def json_explode_jobs(t: Tables) -> DataFrame:
    """Board payloads with one array of jobs for each company; jobs without an id are dropped."""
    k = F.col("o_orderkey")
    job = F.struct(
        F.when(k % 7 != 0, k).alias("id"), F.concat(F.lit("Job "), "o_orderpriority").alias("title"), F.struct(F.when(k % 2 == 0, "Remote, US").otherwise("Berlin").alias("name")).alias("location"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("updated_at"), F.lit("&lt;p&gt;Hi&lt;/p&gt;").alias("content"),
    )
    payload = t.orders.groupBy("o_custkey").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload"))
    got = boards.greenhouse(payload, ["o_custkey"])
    return got.select("o_custkey", "external_id", "title", "location_text", "is_remote", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"))


@query("SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Paris; Rome' ELSE 'Paris; Oslo' END AS location_text, o_orderkey % 3 = 0 AS is_remote FROM orders WHERE o_orderkey % 5 <> 0")
def variant_mixed(t: Tables) -> DataFrame:
    """Places as strings or objects, flags as booleans or strings; unlisted jobs are dropped."""
    k = F.col("o_orderkey").cast("string")
    more = F.when(F.col("o_orderkey") % 2 == 0, '["Rome"]').otherwise('[{"location": "Oslo"}]')
    remote = F.when(F.col("o_orderkey") % 3 == 0, '"true"').otherwise("false")
    listed = F.when(F.col("o_orderkey") % 5 == 0, "false").otherwise("true")
    job = F.concat(F.lit('{"id": "'), k, F.lit('", "title": "t", "location": "Paris", "secondaryLocations": '), more, F.lit(', "isRemote": '), remote, F.lit(', "isListed": '), listed, F.lit("}"))
    payload = t.orders.groupBy("o_custkey").agg(F.concat(F.lit('{"jobs": ['), F.array_join(F.collect_list(job), ","), F.lit("]}")).alias("payload"))
    return boards.ashby(payload, ["o_custkey"]).select("o_custkey", "external_id", "location_text", "is_remote")


@query("WITH s AS (SELECT user_id AS story FROM (SELECT DISTINCT user_id FROM events) ORDER BY user_id DESC LIMIT 3), k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT story, event_id AS comment, n - 1 AS position FROM s JOIN k ON user_id = story AND n <= 10 WHERE event_id % 4 <> 0".replace("n - 1 AS", "CAST(n - 1 AS INTEGER) AS"))
def capped_explode(t: Tables) -> DataFrame:
    """The first comments of the newest threads, cut before deleted ones go."""
    kids = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("kids"))
    stories = kids.select(F.to_json(F.struct((F.col("user_id") + 10_000_000).alias("id"), F.col("user_id").alias("time"), "kids", F.lit("Ask HN: Who is hiring? (May)").alias("title"))).alias("payload"))
    comments = t.events.select(F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("<p>Acme</p>").alias("text"), (F.col("event_id") % 4 == 0).alias("deleted"))).alias("payload"))
    got = feeds.threads(stories.unionByName(comments), 3, 10)
    return got.select((F.col("story") - 10_000_000).alias("story"), "comment", "position")


@query("SELECT c_custkey AS comment, 0 AS part, c_name || ' | ' || c_mktsegment AS title, NULL AS url FROM customer UNION ALL SELECT c_custkey, 1, 'Data Intern', 'https://x.example.com/' || c_custkey FROM customer".replace("NULL AS url", "CAST(NULL AS VARCHAR) AS url"))
def explode_union(t: Tables) -> DataFrame:
    text = F.concat("c_name", F.lit(" | "), "c_mktsegment", F.lit("\n- Data Intern: https://x.example.com/"), F.col("c_custkey").cast("string"))
    rows = t.customer.select(F.lit(1).alias("story"), F.col("c_custkey").alias("comment"), F.lit(None).cast("timestamp").alias("posted_at"), text.alias("text"))
    return feeds.hiring_jobs(rows).select("comment", "part", "title", "url")


@query(r"WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1)) AS u FROM pages) SELECT page_id, u AS link FROM l WHERE u LIKE '/t%' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(u) - length(replace(u, '/', '')), length(u), u) = 1".replace('\\"', '"'))
def shallowest_link(t: Tables) -> DataFrame:
    """For a path fragment, the link of the least depth, then the shortest."""
    links = t.pages.select("page_id", F.explode(X.html_links(F.col("html"))).alias("link")).where(F.col("link").startswith("/t"))
    depth = F.length("link") - F.length(F.replace("link", F.lit("/"), F.lit("")))
    return links.groupBy("page_id").agg(F.min_by("link", F.struct(depth, F.length("link"), "link")).alias("link"))


@query("WITH n AS (SELECT unnest(['the', 'then', 'there', 'and', 'onst']) AS needle) SELECT doc_id, arg_max(needle, length(needle) * 1000000 - instr(lower(text), needle)) AS city FROM documents JOIN n ON contains(lower(text), needle) GROUP BY doc_id")
def longest_match(t: Tables) -> DataFrame:
    """The longest needle in a text, then the first."""
    low = F.lower("text")
    needles = F.array(*map(F.lit, ("the", "then", "there", "and", "onst")))
    hits = F.filter(F.transform(needles, lambda n: F.struct((F.length(n) * 1000000 - F.instr(low, n)).alias("rank"), n.alias("needle"))), lambda h: F.contains(low, h["needle"]))
    return t.documents.select("doc_id", F.array_max(hits)["needle"].alias("city")).where(F.col("city").isNotNull())


@query("WITH c AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1), w AS (SELECT o_custkey, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 200 DAY)) AS DATE) AS first, b FROM c) SELECT o_custkey, first, least(first + 199, b) AS last FROM w")
def date_windows(t: Tables) -> DataFrame:
    spans = t.orders.groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return spans.select("o_custkey", F.inline(feeds.date_windows(F.col("a"), F.col("b"), 200)))


@query("SELECT user_id, coalesce(CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-05' END, CAST(max(CASE WHEN event_type = 'view' AND user_id % 3 = 1 THEN ts END) AS DATE) - 3, CAST(DATE '2025-08-31' - INTERVAL 18 MONTH AS DATE)) AS start FROM events GROUP BY user_id")
def incremental_window(t: Tables) -> DataFrame:
    ok = t.events.groupBy("user_id").agg(F.to_date(F.max(F.when((F.col("event_type") == "view") & (F.col("user_id") % 3 == 1), F.col("ts")))).alias("last"))
    since = F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-05").cast("date"))
    return ok.select("user_id", feeds.incremental_start(since, F.col("last"), F.lit("2025-08-31").cast("date")).alias("start"))


@query("SELECT DISTINCT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000)")
def set_difference(t: Tables) -> DataFrame:
    known = t.supplier.where(F.col("s_acctbal") > 7000).select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(known, "n_nationkey", "left_anti").select("n_name").distinct()


@query("SELECT kind, id FROM (SELECT 1 AS kind, c_custkey AS id FROM customer UNION ALL SELECT 2, s_suppkey FROM supplier UNION ALL SELECT 3, p_partkey FROM part) ORDER BY kind, id")
def union_ordered(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.lit(1).alias("kind"), F.col("c_custkey").alias("id")), t.supplier.select(F.lit(2).alias("kind"), F.col("s_suppkey").alias("id")), t.part.select(F.lit(3).alias("kind"), F.col("p_partkey").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("kind", "id")


@query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS sectors FROM part")
def array_union(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_distinct(F.concat(F.array("p_brand"), F.array("p_type", "p_brand"))).alias("sectors"))


@query("SELECT s_suppkey, n_name AS city, r_name AS metro FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey <> 2) ON n_nationkey = s_nationkey")
def region_lookup(t: Tables) -> DataFrame:
    """Names and aliases in any case to (city, metro); regions that are switched off are unknown."""
    places = t.nation.join(t.region.where(F.col("r_regionkey") != 2), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = F.explode(F.array(F.lower("n_name"), F.concat(F.lower("n_name"), F.lit(" city"))))
    known = places.select(aliases.alias("norm"), F.col("n_name").alias("city"), F.col("r_name").alias("metro"))
    said = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.lower(F.concat(F.upper("n_name"), F.when(F.col("s_suppkey") % 2 == 0, " City").otherwise(""))).alias("norm"))
    return said.join(known, "norm", "left").select("s_suppkey", "city", "metro")


@query("SELECT s_suppkey, CASE WHEN n_regionkey <> 2 THEN r_name ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'reported' END END AS metro FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2 OR s_suppkey % 2 = 0")
def region_fill(t: Tables) -> DataFrame:
    """The configured label replaces what was reported; an unknown place stays only if it has a label."""
    reported = t.supplier.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, "reported").alias("said"))
    known = t.nation.join(t.region.where(F.col("r_regionkey") != 2), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("label"))
    return reported.join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("label", "said").alias("metro")).where(F.col("metro").isNotNull())


@query("SELECT user_id, event_type, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2, 3")
def stream_dedup(t: Tables) -> DataFrame:
    """Each (user, type, day) once, as the streaming form does within its watermark."""
    rows = t.events.select("user_id", "event_type", F.to_date("ts").alias("day"), "ts")
    return once(rows, ["user_id", "event_type", "day"], "ts").select("user_id", "event_type", "day")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey % 3 = 0, o_orderkey) AS filings FROM orders GROUP BY o_custkey")
def filing_order(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", F.col("o_orderdate").alias("file_date"), F.when(F.col("o_orderkey") % 3 == 0, "D/A").otherwise("D").alias("form"), F.col("o_orderkey").alias("accession"))
    w = W.partitionBy("o_custkey").orderBy(*feeds.filing_order())
    rows = rows.withColumn("n", F.row_number().over(w))
    return rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "accession"))), lambda s: s["accession"].cast("string")), ",").alias("filings"))


@query("SELECT page_id, 'Ada Lovelace' AS full_name, CASE page_id % 6 WHEN 0 THEN 'Chief of Engines' WHEN 1 THEN 'CTO' WHEN 5 THEN 'CTO' END AS title, 'https://www.linkedin.com/in/Ada' || page_id AS url FROM pages WHERE page_id % 6 <> 3")
def people_markup(t: Tables) -> DataFrame:
    """Raw pages with a card of six kinds: heading above the link, the link around the card, the name in the link beside a section's
    heading, two profiles in one card, a title that is too long, the link within the heading."""
    from siltstone.sources.people import people

    k = F.col("page_id")
    url = F.concat(F.lit("linkedin.com/in/Ada"), k.cast("string"))
    card = lambda *parts: F.concat(F.lit("<div>"), *[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit("</div>"))
    kinds = [
        card("<h3>Ada Lovelace</h3><p>Chief of Engines</p><a href='https://de.", url, "?x=1'>in</a>"),
        card("<a href='//", url, "/'><img src=a><h3>Ada Lovelace, PhD</h3><p>CTO</p></a>"),
        card("<h3>Our Team</h3><p>Chief</p><p><a href='https://www.", url, "'>Ada Lovelace</a></p>"),
        card("<h3>Ada Lovelace</h3><a href='https://", url, "'>in</a><a href='https://linkedin.com/in/other'>in</a>"),
        card("<h3>Ada Lovelace</h3><p>", F.repeat(F.lit("long "), 40), "</p><a href='https://", url, "'>in</a>"),
        card("<h3><a href='https://", url, "#top'>Ada Lovelace</a></h3><!-- x --><p></p><p>CTO</p>"),
    ]
    pick = F.element_at(F.array(*kinds), (k % 6 + 1).cast("int"))
    return t.pages.select("page_id", F.inline(people(F.concat(F.lit("<main>"), pick, F.lit("</main>"), F.coalesce("html", F.lit(""))))))


@query("SELECT page_id, NOT (page_id % 3 = 0 OR page_id % 3 = 1 AND page_id % 2 = 0) AS allowed FROM pages")
def robots_rules(t: Tables) -> DataFrame:
    """The longest rule decides, allow wins ties, a group for the product replaces the one for all."""
    from siltstone.sources import robots

    k = F.col("page_id")
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nDisallow: /b\n\nUser-agent: Sampler # us\nDisallow: /a/\nDisallow: /c*.html$\nAllow: /c/open\nAllow: /b\n"
    path = F.when(k % 3 == 0, "/a/x").when((k % 3 == 1) & (k % 2 == 0), "/c/x.html").when(k % 3 == 1, "/c/open.htm").otherwise("/b/y")
    paths = t.pages.select("page_id", F.lit("h").alias("host"), path.alias("path"))
    files = t.spark.createDataFrame([("h", text)], "host string, text string")
    return robots.allowed(paths, robots.rules(files, "sampler")).select("page_id", "allowed")
