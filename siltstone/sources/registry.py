"""Sources by name, in order of authority, and saved payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import boards, feeds, sites

MAPPERS: dict[str, Callable[..., DataFrame]] = {
    "sec_edgar": feeds.form_d,
    "ycombinator": feeds.directory,
    "greenhouse": boards.greenhouse,
    "lever": boards.lever,
    "ashby": boards.ashby,
    "workable": boards.workable,
    "hn_hiring": sites.hiring,
    "funding_rss": feeds.feed_items,
    "company_site": sites.site,
}


def mapper(name: str) -> Callable[..., DataFrame]:
    if name not in MAPPERS:
        raise KeyError(f"unknown source {name!r}; known: {', '.join(MAPPERS)}")
    return MAPPERS[name]


def saved_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(name, payload): one row for each file of a folder that all workers can read, many small files to a task."""
    return spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("payload"))
