"""Region files: read into rows, and every rule that a file breaks told at once.

A region has a metro, a state, whether it is enabled, and cities; a city is a
name or a mapping with its own state and aliases.  A metro names one region, a
city of a state lies in one metro, an alias names one city, and at least one
region is enabled.  Disabled regions count for the first three.  Names are
compared trimmed, in lower case, with each run of other than letters and digits as one
blank.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGION_KEYS, CITY_KEYS = {"metro", "state", "state_name", "enabled", "cities"}, {"city", "state", "state_name", "aliases"}
REGIONS, CITIES, ALIASES = "place string, metro string, enabled boolean", "place string, metro string, city string, state string", "place string, metro string, city string, state string, alias string"


class Regions(NamedTuple):
    """Rows of a file, each with its place in it, and what could not be read (place, rule, subject)."""

    regions: DataFrame
    cities: DataFrame
    aliases: DataFrame
    unread: DataFrame


def read_regions(spark: SparkSession, data: dict) -> Regions:
    """The rows of a file's mapping ``{"regions": [...]}``; unknown keys and missing values are told, not raised."""
    regions, cities, aliases, unread = [], [], [], []
    trimmed = lambda v: v.strip() if isinstance(v, str) and v.strip() else None
    for k, region in enumerate(data.get("regions") or []):
        at = f"regions.{k}"
        unread += [(f"{at}.{key}", "unknown key", key) for key in region if key not in REGION_KEYS]
        metro = trimmed(region.get("metro"))
        if metro is None:
            unread.append((at, "no metro", None))
        regions.append((at, metro, bool(region.get("enabled", True))))
        for j, entry in enumerate(region.get("cities") or []):
            here, entry = f"{at}.cities.{j}", entry if isinstance(entry, dict) else {"city": entry}
            unread += [(f"{here}.{key}", "unknown key", key) for key in entry if key not in CITY_KEYS]
            city, state = trimmed(entry.get("city")), trimmed(entry.get("state")) or trimmed(region.get("state"))
            if city is None or state is None:
                unread.append((here, "no city" if city is None else "no state", city))
                continue
            cities.append((here, metro, city, state))
            aliases += [(f"{here}.aliases.{i}", metro, city, state, trimmed(a)) for i, a in enumerate(entry.get("aliases") or []) if trimmed(a)]
    frame = spark.createDataFrame
    return Regions(frame(regions, REGIONS), frame(cities, CITIES), frame(aliases, ALIASES), frame(unread, "place string, rule string, subject string"))


def plain(name: Column) -> Column:
    """A name as it is compared."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def repeated(rows: DataFrame, key: Column, rule: str, subject: str) -> DataFrame:
    """(place, rule, subject) of all but the first row of a key, by place in the file."""
    firsts = rows.withColumn("_key", key).groupBy("_key").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return rows.withColumn("_key", key).join(firsts, "_key").where(F.col("place") != F.col("_first")).select("place", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))


def violations(r: Regions) -> DataFrame:
    """(place, rule, subject) of all that a file breaks; none if it can be used."""
    same_city = F.struct(plain(F.col("city")), F.lower("state"))
    names = r.cities.select(same_city.alias("_name")).distinct()
    spelled = r.aliases.withColumn("_name", F.struct(plain(F.col("alias")), F.lower("state")))
    taken = spelled.join(names, "_name", "left_semi").select("place", F.lit("alias is a city").alias("rule"), F.col("alias").alias("subject"))
    free = spelled.join(names, "_name", "left_anti")
    none_on = r.regions.agg(F.count_if("enabled").alias("_on")).where("_on = 0").select(F.lit("regions").alias("place"), F.lit("none enabled").alias("rule"), F.lit(None).cast("string").alias("subject"))
    found = repeated(r.regions.where("metro IS NOT NULL"), F.lower("metro"), "metro twice", "metro").unionByName(repeated(r.cities, same_city, "city twice", "city"))
    return found.unionByName(taken).unionByName(repeated(free, F.col("_name"), "alias twice", "alias")).unionByName(none_on).unionByName(r.unread)
