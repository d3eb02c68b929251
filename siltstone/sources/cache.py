"""Responses kept by the hash of their URL.

Entries are a table in two levels: what was put lately, rewritten by each put,
and the compacted rest, which a put leaves alone; ``compact`` folds one into the
other.  Both change in one commit.  Of several entries of a URL the one stored
last counts; one whose body does not have its checksum, or that lacks its status
or time, is corrupt, and a corrupt entry is a miss even where an older one is
whole.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.database import Database

ENTRY = "key string, url string, status_code int, headers map<string,string>, body binary, etag string, last_modified string, stored_at timestamp, checksum string"
#: Seconds for which an entry needs no request.
FRESH = 24 * 3600
#: Keys up to which they are broadcast to the entries.
MOST_SENT = 200_000
#: Rows put lately from which a put compacts.
RECENT = 1_000_000


def key_of(url: Column) -> Column:
    return F.sha2(url, 256)


def whole() -> Column:
    """Whether an entry is as it was written."""
    return F.coalesce(F.col("status_code").isNotNull() & F.col("stored_at").isNotNull() & F.col("body").isNotNull() & (F.sha2("body", 256) == F.col("checksum")), F.lit(False))


def latest(entries: DataFrame) -> DataFrame:
    """The entry of each key that was stored last; of entries of one time the one with the greatest checksum."""
    order = F.struct(F.coalesce(F.col("stored_at"), F.lit("1970-01-01").cast("timestamp")), F.coalesce("checksum", F.lit("")))
    columns = [c for c in entries.columns if c != "key"]
    return entries.groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("_e")).select("key", "_e.*")


class ResponseCache:
    def __init__(self, spark: SparkSession, path: str):
        self.db = Database(spark, path, {"recent": ENTRY, "compacted": ENTRY})

    def put(self, responses: DataFrame, now: datetime) -> None:
        """Stores responses (url, status_code, headers, body, etag, last_modified); of several for one URL any one. Null URLs have no entry."""
        new = responses.where("url IS NOT NULL").withColumn("key", key_of(F.col("url"))).withColumn("stored_at", F.lit(now)).withColumn("checksum", F.sha2("body", 256))
        self.db.commit(lambda s: {"recent": latest(s["recent"].unionByName(new.select(*s["recent"].columns)))})
        if self.db.snapshot()["recent"].count() >= RECENT:
            self.compact()

    def get(self, urls: DataFrame, now: Column, fresh: int = FRESH) -> DataFrame:
        """``urls`` with their entry's columns and ``fresh``; all are null for a miss."""
        asked = urls.withColumn("key", key_of(F.col("url")))
        keys = asked.select("key").distinct()
        keys = F.broadcast(keys) if keys.count() <= MOST_SENT else keys
        s = self.db.snapshot()
        found = latest(s["recent"].join(keys, "key", "left_semi").unionByName(s["compacted"].join(keys, "key", "left_semi"))).where(whole())
        age = F.unix_timestamp(now) - F.unix_timestamp("stored_at")
        hit = found.drop("url", "checksum").withColumn("fresh", age < fresh)
        return asked.join(hit, "key", "left").drop("key")

    def compact(self, older: datetime | None = None) -> int:
        """Folds what was put lately into the rest, without superseded and corrupt entries and those stored before ``older``; how many are left.

        A corrupt entry takes the older ones of its URL with it.
        """

        def change(s):
            every = latest(s["recent"].unionByName(s["compacted"])).where(whole())
            every = every if older is None else every.where(F.col("stored_at") >= F.lit(older))
            return {"compacted": every.repartitionByRange("key").sortWithinPartitions("key"), "recent": s["recent"].limit(0)}

        return self.db.commit(change)["compacted"].count()
