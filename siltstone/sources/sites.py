"""Hiring comments and companies' own pages, as rows for each company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.functions.unicode import resolve_links
from siltstone.sources import feeds


def hiring(items: DataFrame, *, newest: int = 3, kids: int = 500, payload: str = "payload") -> DataFrame:
    """Companies in the first ``kids`` comments of the ``newest`` hiring threads, read from each comment's first line."""
    found = feeds.threads(items, newest, kids, payload)
    head = feeds.header_fields(F.get(F.split("text", "\n"), 0))
    rows = found.select(
        "story", "comment", "posted_at", "text", X.collapse(head["name"]).alias("name"), X.normalize_domain(head["url"], international=True).alias("domain"),
        head["commitment"].alias("commitment"), head["others"].alias("others"), X.text_emails(F.col("text")).alias("addresses"),
    )
    # a header has a name and at least one more field
    return rows.where((F.coalesce("name", F.lit("")) != "") & (F.size("others") + F.col("commitment").isNotNull().cast("int") + F.col("domain").isNotNull().cast("int") > 0))


def _each(values: Column) -> Column:
    """The values of all pages of a site, each once, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(values))))


def site(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """One row for each domain: its pages, the description of the shallowest page that has one, addresses and accounts.

    Links are resolved against their page.  Pages without a host belong to no site; a page without markup counts and adds nothing.
    """
    pages = pages.withColumn("_links", resolve_links(F.col(url), F.coalesce(X.html_links(F.col(html)), F.array().cast("array<string>"))))
    links = F.col("_links")
    mails = F.filter(F.transform(F.filter(links, lambda u: F.lower(u).startswith("mailto:")), X.normalize_email), lambda m: m.isNotNull())
    kinds = F.filter(F.transform(links, lambda u: F.struct(X.social_kind(u).alias("kind"), u.alias("url"))), lambda s: s["kind"].isNotNull())
    told = X.meta_content(F.col(html), "description", "og:description")
    rows = pages.select(X.normalize_domain(F.col(url), international=True).alias("domain"), F.col(url).alias("url"), told.alias("told"), mails.alias("mails"), kinds.alias("kinds")).where(F.col("domain").isNotNull())
    depth = F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))
    order = F.when(F.col("told").isNotNull(), F.struct(depth, F.length("url"), "url"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.min_by("told", order).alias("one_liner"), _each(F.col("mails")).alias("addresses"), _each(F.col("kinds")).alias("links"))
