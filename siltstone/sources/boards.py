"""Job boards: raw JSON payloads to rows of jobs.

Each parser takes a DataFrame with a payload column and returns its key columns
and the fields of a job.  Schemas are declared; a payload that does not parse
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.functions import text as X

LIMIT = 20000
FIELDS = ("external_id", "title", "url", "location_text", "is_remote", "employment_type", "compensation_raw", "posted_at", "description_raw")


def description(*candidates: Column) -> Column:
    """The plain text of the first candidate that has any."""
    texts = [F.nullif(X.html_to_text(X.unescape(c), LIMIT), F.lit("")) for c in candidates]
    return F.coalesce(*texts)


def _jobs(df: DataFrame, jobs: Column, keys: list[str], **fields: Column) -> DataFrame:
    rows = df.select(*keys, F.posexplode(F.filter(jobs, lambda j: j.isNotNull())).alias("position", "j"))
    none = F.lit(None).cast("string")
    return rows.select(*keys, "position", *[fields.get(f, none).alias(f) for f in FIELDS]).where(F.col("external_id").isNotNull() & F.col("title").isNotNull())


def greenhouse(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    schema = "struct<jobs: array<struct<id: bigint, title: string, absolute_url: string, location: struct<name: string>, first_published: string, updated_at: string, content: string>>>"
    where = F.col("j.location.name")
    return _jobs(
        df, F.from_json(payload, schema)["jobs"], keys,
        external_id=F.col("j.id").cast("string"), title=F.col("j.title"), url=F.col("j.absolute_url"), location_text=where,
        is_remote=F.coalesce(F.lower(where).contains("remote"), F.lit(False)),
        posted_at=F.coalesce(N.iso_timestamp(F.col("j.first_published")), N.iso_timestamp(F.col("j.updated_at"))), description_raw=description(F.col("j.content")),
    )


def format_salary(low: Column, high: Column, currency: Column, interval: Column) -> Column:
    """USD 100,000-150,000 per year."""
    number = lambda c: F.format_number(c, 0)
    span = F.concat_ws("-", number(low), number(high))
    return F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" ", currency, span, interval))


def lever(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    schema = "array<struct<id: string, text: string, hostedUrl: string, applyUrl: string, createdAt: bigint, workplaceType: string, descriptionPlain: string, description: string, categories: struct<commitment: string, location: string, allLocations: array<string>>, salaryRange: struct<min: double, max: double, currency: string, interval: string>>>"
    places = X.ordered_distinct(F.coalesce(F.nullif(F.col("j.categories.allLocations"), F.array().cast("array<string>")), F.array("j.categories.location")))
    pay = F.col("j.salaryRange")
    return _jobs(
        df, F.from_json(payload, schema), keys,
        external_id=F.col("j.id"), title=F.col("j.text"), url=F.coalesce("j.hostedUrl", "j.applyUrl"), location_text=places,
        is_remote=F.coalesce((F.lower("j.workplaceType") == "remote") | F.lower(places).contains("remote"), F.lit(False)),
        employment_type=F.col("j.categories.commitment"), compensation_raw=format_salary(pay["min"], pay["max"], pay["currency"], pay["interval"]),
        posted_at=F.timestamp_millis("j.createdAt"), description_raw=description(F.col("j.descriptionPlain"), F.col("j.description")),
    )


def truth(v: Column) -> Column:
    """True for true and "true" in a variant."""
    return F.coalesce(F.lower(F.try_variant_get(v, "$", "string")) == "true", F.lit(False))


def ashby(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """Places are strings or objects, flags booleans or strings: read as variants."""
    v = F.try_parse_json(payload)
    jobs = F.try_variant_get(v, "$.jobs", "array<variant>")
    text = lambda path: F.try_variant_get(F.col("j"), path, "string")
    more = F.coalesce(F.try_variant_get(F.col("j"), "$.secondaryLocations", "array<variant>"), F.array().cast("array<variant>"))
    place = lambda p: F.coalesce(F.try_variant_get(p, "$.location", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")))
    places = X.ordered_distinct(F.concat(F.array(text("$.location")), F.transform(more, place)))
    listed = lambda j: F.coalesce(F.lower(F.try_variant_get(j, "$.isListed", "string")), F.lit("true")) != "false"
    return _jobs(
        df, F.filter(jobs, listed), keys,
        external_id=text("$.id"), title=text("$.title"), url=F.coalesce(text("$.jobUrl"), text("$.applyUrl")), location_text=places,
        is_remote=(F.coalesce(F.lower(text("$.isRemote")), F.lit("")) == "true") | F.coalesce(F.lower(places).contains("remote"), F.lit(False)),
        employment_type=text("$.employmentType"), compensation_raw=text("$.compensation.compensationTierSummary"),
        posted_at=N.iso_timestamp(text("$.publishedAt")), description_raw=description(text("$.descriptionPlain"), text("$.descriptionHtml")),
    )


def workable(df: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    schema = "struct<description: string, jobs: array<struct<shortcode: string, title: string, url: string, shortlink: string, telecommuting: boolean, published_on: string, created_at: string, employment_type: string, city: string, state: string, country: string, locations: array<struct<city: string, region: string, country: string, hidden: boolean>>, description: string>>>"
    line = lambda c, r, n: F.concat_ws(", ", F.nullif(c, F.lit("")), F.nullif(r, F.lit("")), F.nullif(n, F.lit("")))
    shown = F.transform(F.filter("j.locations", lambda x: ~F.coalesce(x["hidden"], F.lit(False))), lambda x: line(x["city"], x["region"], x["country"]))
    places = F.coalesce(F.nullif(X.ordered_distinct(shown), F.lit("")), F.nullif(line(F.col("j.city"), F.col("j.state"), F.col("j.country")), F.lit("")))
    return _jobs(
        df, F.from_json(payload, schema)["jobs"], keys,
        external_id=F.col("j.shortcode"), title=F.col("j.title"), url=F.coalesce("j.url", "j.shortlink"), location_text=places, is_remote=F.coalesce("j.telecommuting", F.lit(False)),
        employment_type=F.col("j.employment_type"), posted_at=F.coalesce(N.iso_timestamp(F.col("j.published_on")), N.iso_timestamp(F.col("j.created_at"))), description_raw=description(F.col("j.description")),
    )


def board_has_content(payload: Column) -> Column:
    """Whether an account has jobs or a description."""
    got = F.from_json(payload, "struct<description: string, jobs: array<struct<title: string>>>")
    return F.coalesce(F.size(got["jobs"]) > 0, F.lit(False)) | (F.coalesce(F.trim(got["description"]), F.lit("")) != "")


# fixed values: where a page shows its board's token
TOKENS = {
    "greenhouse": r"(?:boards|job-boards)[.]greenhouse[.]io/(?:embed/job_board[?/](?:js\?)?for=)?([A-Za-z0-9_-]+)",
    "lever": r"jobs[.]lever[.]co/([A-Za-z0-9_-]+)",
    "ashby": r"jobs[.]ashbyhq[.]com/([A-Za-z0-9_.%-]+)",
    "workable": r"apply[.]workable[.]com/([A-Za-z0-9_-]+)",
}
RESERVED = ("embed", "api", "v1", "static", "assets", "www")


def board_token(html: Column) -> Column:
    """(provider, token) of the first provider whose board the page links, or null."""
    out = []
    for provider, pattern in TOKENS.items():
        token = F.get(F.filter(F.regexp_extract_all(html, F.lit(pattern), 1), lambda t: ~F.lower(t).isin(*RESERVED)), 0)
        out.append(F.when(token.isNotNull(), F.struct(F.lit(provider).alias("provider"), token.alias("token"))))
    return F.coalesce(*out)


def records(targets: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each target: its jobs nested, ``jobs_complete`` only if a board was read.

    ``targets`` has the keys, name and read (whether its payload was parsed);
    such records only enrich what is stored.
    """
    nested = jobs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", *FIELDS))), lambda j: F.struct(*[j[f].alias(f) for f in FIELDS])).alias("jobs"))
    out = targets.join(nested, keys, "left")
    return out.select(*keys, "name", F.coalesce("jobs", F.array()).alias("jobs"), F.coalesce("read", F.lit(False)).alias("jobs_complete"), F.lit(True).alias("enrich_only"))
