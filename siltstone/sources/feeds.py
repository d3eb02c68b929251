"""Search results, filings, feeds and threads: raw payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltstone.functions import classify as C
from siltstone.functions import numbers as N
from siltstone.functions import text as X
from siltstone.store import cut

HITS = "struct<hits: struct<total: struct<value: bigint, relation: string>, hits: array<struct<_id: string, _source: struct<adsh: string, ciks: array<string>, file_date: string, form: string, biz_locations: array<string>>>>>>"


def date_windows(start: Column, end: Column, days: int) -> Column:
    """Consecutive inclusive windows of ``days``; the last is clipped; none when start is after end."""
    steps = F.when(start <= end, F.sequence(start, end, F.expr(f"interval {days} days")))
    return F.transform(steps, lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))


def incremental_start(since: Column, last_success: Column, now: Column, overlap: int = 3, months: int = 18) -> Column:
    """Where a scan starts: as asked, else the last success less an overlap, else some months ago."""
    return F.coalesce(since, F.date_sub(last_success, overlap), F.add_months(now, -months))


def search_hits(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """One row for each hit of saved result pages; a page over the cap says so."""
    got = df.select(*keys, F.from_json(payload, HITS).alias("p"))
    return got.select(*keys, (F.col("p.hits.total.relation") != "eq").alias("over_cap"), F.explode("p.hits.hits").alias("hit")).select(
        *keys, "over_cap", F.col("hit._source.adsh").alias("accession"), F.col("hit._source.ciks")[0].alias("cik"), F.col("hit._source.file_date").try_cast("date").alias("file_date"),
        F.col("hit._source.form").alias("form"), X.split_location(F.get("hit._source.biz_locations", 0)).alias("place"),
    )


def filing_order() -> list[Column]:
    """Originals before their amendments."""
    return [F.col("file_date").asc_nulls_last(), (F.col("form") != "D").asc(), F.col("accession").asc()]


def rejects(hits: DataFrame, regions: DataFrame) -> DataFrame:
    """``hits`` with reason: malformed, out of region, duplicate, or null for those to read.

    ``regions`` is (city, state) in lower case.
    """
    known = regions.select(F.col("city").alias("_c"), F.col("state").alias("_s")).distinct().withColumn("_in", F.lit(True))
    placed = hits.join(known, (F.lower("place.city") == F.col("_c")) & (F.lower("place.state") == F.col("_s")), "left")
    first = F.row_number().over(W.partitionBy("accession").orderBy(*filing_order()))
    bad = F.when(F.col("accession").isNull() | F.col("cik").isNull(), "malformed").when(F.col("_in").isNull(), "out_of_region")
    seen = placed.withColumn("_bad", bad).withColumn("_n", F.when(F.col("_bad").isNull(), first))
    again = F.row_number().over(W.partitionBy("accession", F.col("_bad").isNull()).orderBy(*filing_order()))
    return seen.withColumn("reason", F.coalesce("_bad", F.when(again > 1, "duplicate"))).drop("_bad", "_n", "_in", "_c", "_s")


FORM = """struct<
  primaryIssuer: struct<cik: string, entityName: string, issuerAddress: struct<city: string, stateOrCountry: string>, jurisdictionOfInc: string, yearOfInc: struct<value: string>>,
  relatedPersonsList: struct<relatedPersonInfo: array<struct<relatedPersonName: struct<firstName: string, middleName: string, lastName: string>, relatedPersonRelationshipList: struct<relationship: array<string>>>>>,
  offeringData: struct<industryGroup: struct<industryGroupType: string>, typesOfSecuritiesOffered: struct<isEquityType: string, isDebtType: string, isOptionToAcquireType: string, isSecurityToBeAcquiredType: string, descriptionOfOtherType: string>,
    typeOfFiling: struct<dateOfFirstSale: struct<value: string>>, offeringSalesAmounts: struct<totalOfferingAmount: string, totalAmountSold: string>>>"""


def form_d(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Filings from XML; one without issuer number or name has problem set."""
    f = df.select(*keys, F.from_xml(payload, FORM.replace("\n", " ")).alias("f"))
    kinds, amounts, issuer = F.col("f.offeringData.typesOfSecuritiesOffered"), F.col("f.offeringData.offeringSalesAmounts"), F.col("f.primaryIssuer")
    people = F.transform(
        F.coalesce(F.col("f.relatedPersonsList.relatedPersonInfo"), F.array()),
        lambda p: F.struct(X.collapse(F.concat_ws(" ", p["relatedPersonName"]["firstName"], p["relatedPersonName"]["middleName"], p["relatedPersonName"]["lastName"])).alias("full_name"), p["relatedPersonRelationshipList"]["relationship"].alias("relationships")),
    )
    flag = lambda c: F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))
    return f.select(
        *keys, issuer["cik"].alias("cik"), issuer["entityName"].alias("name"), issuer["issuerAddress"]["city"].alias("city"), issuer["issuerAddress"]["stateOrCountry"].alias("state"),
        N.safe_int(issuer["yearOfInc"]["value"]).cast("int").alias("founded_year"), F.col("f.offeringData.industryGroup.industryGroupType").alias("industry"),
        N.safe_int(amounts["totalOfferingAmount"]).alias("offered"), N.safe_int(amounts["totalAmountSold"]).alias("sold"), F.col("f.offeringData.typeOfFiling.dateOfFirstSale.value").try_cast("date").alias("first_sale"),
        round_of(flag(kinds["isEquityType"]), flag(kinds["isDebtType"]), kinds["descriptionOfOtherType"]).alias("round_type"), people.alias("people"),
        F.when(issuer["cik"].isNull() | issuer["entityName"].isNull(), "no issuer").alias("problem"),
    )


def round_of(equity: Column, debt: Column, described: Column) -> Column:
    """What a filing's securities say about its round."""
    text = F.lower(F.coalesce(described, F.lit("")))
    return F.when(debt & ~equity, "debt").when(text.rlike(r"(^|[^a-z])safe([^a-z]|$)"), "safe").when(text.contains("convertible"), "convertible_note").otherwise("unknown")


RSS = "struct<channel: struct<item: array<struct<title: string, link: string, description: string, pubDate: string, guid: string>>>>"
ANNOUNCED = r"(?i)\b(raises|raised|raising|secures|secured|lands|landed|closes|closed|nabs|banks|bags|picks up|snags|scores|announces|announced|has raised|is raising)\b"


def feed_items(df: DataFrame, keys: list[str], now: Column, *, cap: int = 50, days: int = 30, payload: str = "payload") -> DataFrame:
    """Items of a feed: capped first, then those with a date are cut by age; items need a title."""
    got = df.select(*keys, F.posexplode(F.slice(F.from_xml(payload, RSS)["channel"]["item"], 1, cap)).alias("position", "i"))
    rows = got.select(*keys, "position", F.nullif(X.collapse(F.col("i.title")), F.lit("")).alias("title"), F.col("i.link").alias("link"), X.html_to_text(F.col("i.description")).alias("summary"), N.feed_timestamp(F.col("i.pubDate")).alias("published_at"), F.coalesce("i.guid", "i.link").alias("external_id"))
    return rows.where(F.col("title").isNotNull() & (F.col("published_at").isNull() | (F.col("published_at") >= now - F.expr(f"interval {days} days"))))


def headline_name(title: Column) -> Column:
    """Who a funding headline is about: what stands before the verb, at most six words."""
    clean = F.regexp_replace(X.collapse(title), r"(?i)^(?:exclusive|breaking|report|scoop)\s*[:—–-]\s*", "")
    head = F.when(clean.rlike(ANNOUNCED), F.split(clean, ANNOUNCED, 2)[0])
    head = F.trim(F.regexp_replace(head, r"\s*[,(—–-]\s*.*$", ""))
    head = F.regexp_replace(F.regexp_replace(head, r"\s+\w+ly$", ""), r"^[ .,:;]+|[ .,:;]+$", "")
    return F.when((head != "") & (F.size(F.split(head, r"\s+")) <= 6), head)


def funding_amount(title: Column, summary: Column) -> Column:
    """From the title, unless it has none or zero there."""
    return F.coalesce(F.nullif(N.parse_amount(title), F.lit(0).cast("long")), N.parse_amount(summary))


DIRECTORY = "struct<results: array<struct<hits: array<struct<name: string, slug: string, objectID: string, website: string, all_locations: string, one_liner: string, long_description: string, team_size: string, industry: string, subindustry: string, industries: array<string>, tags: array<string>, batch: string, status: string, stage: string>>>>>"


def batch_label(batch: Column) -> Column:
    """Winter 2024 -> YC W24."""
    season, year = F.regexp_extract(batch, r"^([A-Za-z])[A-Za-z]* \d\d(\d\d)$", 1), F.regexp_extract(batch, r"^([A-Za-z])[A-Za-z]* \d\d(\d\d)$", 2)
    return F.when(year != "", F.concat(F.lit("YC "), F.upper(season), year))


def directory(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Companies of directory pages; nameless ones are dropped."""
    rows = df.select(*keys, F.explode(F.flatten(F.transform(F.from_json(payload, DIRECTORY)["results"], lambda r: r["hits"]))).alias("h"))
    none = F.array().cast("array<string>")
    sectors = F.array_distinct(F.filter(F.concat(F.coalesce("h.industries", none), F.coalesce("h.tags", none), F.array("h.subindustry", batch_label(F.col("h.batch")))), lambda s: s.isNotNull() & (s != "")))
    places = F.filter(F.transform(F.split(F.coalesce("h.all_locations", F.lit("")), r"\s*;\s*"), lambda p: F.transform(F.slice(F.split(p, r"\s*,\s*"), 1, 3), lambda x: F.trim(x))), lambda p: F.size(p) >= 2)
    return rows.select(
        *keys, X.collapse(F.col("h.name")).alias("name"), F.coalesce("h.slug", "h.objectID").alias("external_id"), X.normalize_domain(F.col("h.website"), international=True).alias("domain"), F.col("h.one_liner").alias("one_liner"),
        N.safe_int(F.col("h.team_size")).cast("int").alias("employee_est"), sectors.alias("sectors"), places.alias("locations"), F.lower("h.status").alias("status"), F.lower("h.stage").alias("stage"),
    ).where(F.coalesce(F.col("name"), F.lit("")) != "")


ITEM = "struct<id: bigint, by: string, text: string, time: bigint, kids: array<bigint>, deleted: boolean, dead: boolean, title: string>"


def threads(items: DataFrame, newest: int, kids: int, payload: str = "payload") -> DataFrame:
    """(story, position, comment): the first ``kids`` of the ``newest`` hiring threads; cut before deleted ones go."""
    got = items.select(F.from_json(payload, ITEM).alias("i")).select("i.*")
    stories = got.where(F.lower("title").rlike(r"^ask hn:\s*who is hiring\?")).orderBy(F.desc("time"), F.desc("id")).limit(newest)
    wanted = stories.select(F.col("id").alias("story"), F.posexplode(F.slice("kids", 1, kids)).alias("position", "comment"))
    alive = got.where(~F.coalesce("deleted", F.lit(False)) & ~F.coalesce("dead", F.lit(False)) & F.col("text").isNotNull())
    # a few threads with a few comments each; cut, so that no filter on what is read from texts moves to all comments
    found = cut(F.broadcast(wanted).join(alive.select(F.col("id").alias("comment"), "by", F.col("text").alias("html"), "time"), "comment"))
    return found.select("comment", "story", "position", "by", X.html_to_text(F.col("html"), C.BODY).alias("text"), F.timestamp_seconds("time").alias("posted_at"))


def header_fields(line: Column) -> dict[str, Column]:
    """A pipe-separated header: the name, its URL, its terms of work, and the rest."""
    parts = F.filter(F.transform(F.split(line, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.slice(parts, 2, 1000)
    url, work = (lambda p: p.rlike(r"https?://")), (lambda p: p.rlike(r"(?i)(full|part)[- ]?time|contract|intern|remote|onsite|hybrid"))
    return {"name": F.get(parts, 0), "url": F.get(F.filter(rest, url), 0), "commitment": F.get(F.filter(rest, lambda p: ~url(p) & work(p)), 0), "others": F.filter(rest, lambda p: ~url(p) & ~work(p))}


def role_bullets(text: Column) -> Column:
    """(title, url) of lines like ``- Role: https://...``."""
    pattern = F.lit(r"(?m)^[-*•]\s*([^:<>\n]{3,120}?)\s*[:–—-]\s*(https?://\S+)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("title"), F.regexp_extract_all(text, pattern, 2).alias("url"))
    return F.transform(pairs, lambda p: F.struct(X.collapse(p["title"]).alias("title"), F.regexp_replace(p["url"], r"[.,;)]+$", "").alias("url")))


def hiring_jobs(comments: DataFrame) -> DataFrame:
    """A comment's own row and one for each of its bullets."""
    own = F.array(F.struct(F.get(F.split("text", "\n"), 0).alias("title"), F.lit(None).cast("string").alias("url")))
    return comments.select("story", "comment", "posted_at", F.posexplode(F.concat(own, role_bullets(F.col("text")))).alias("part", "j")).select("story", "comment", "posted_at", "part", "j.title", "j.url")


# fixed values: how a directory's page names its search application and public key
CREDENTIALS = r'"(?:app|appId|applicationId)"\s*:\s*"([A-Z0-9]{6,32})"\s*,\s*"(?:key|apiKey|searchApiKey)"\s*:\s*"([A-Za-z0-9+/=]{20,})"'


def credentials(markup: Column) -> Column:
    """(app_id, key) that a directory's page names, or null."""
    found = [F.regexp_extract(markup, CREDENTIALS, k) for k in (1, 2)]
    return F.when(found[0] != "", F.struct(found[0].alias("app_id"), found[1].alias("key")))
