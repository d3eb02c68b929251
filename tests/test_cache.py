"""The response cache, and the rules of region files."""

import datetime as dt

from pyspark.sql import functions as F

from siltstone.sources.cache import ResponseCache
from siltstone.sources.regions import read_regions, violations

DAY = lambda d: dt.datetime(2026, 1, d, tzinfo=dt.UTC)
RESPONSE = "url string, status_code int, headers map<string,string>, body binary, etag string, last_modified string"


def test_latest_whole_entry_counts(spark, tmp_path):
    cache = ResponseCache(spark, str(tmp_path / "c"))
    put = lambda day, *rows: cache.put(spark.createDataFrame([(u, 200, {"h": "1"}, b.encode(), e, None) for u, b, e in rows], RESPONSE), DAY(day))
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",), (None,)], "url string")
    got = lambda day: sorted(((r.url, r.body and bytes(r.body).decode(), r.etag, r.fresh) for r in cache.get(asked, F.lit(DAY(day))).collect()), key=str)
    assert got(1) == sorted([(u, None, None, None) for u in ("a", "b", "c", "a", None)], key=str)
    put(1, ("a", "one", "1"), ("b", "bee", "1"), (None, "x", "1"))
    put(3, ("a", "two", "2"))
    want = [("a", "two", "2", True), ("a", "two", "2", True), ("b", "bee", "1", False), ("c", None, None, None), (None, None, None, None)]
    assert got(3) == sorted(want, key=str)
    assert cache.compact() == 2 and got(3) == sorted(want, key=str) and cache.db.snapshot()["recent"].count() == 0
    # the last entry is damaged: a miss, though an older one is whole
    put(4, ("a", "three", "3"))
    cache.db.commit(lambda s: {"recent": s["recent"].withColumn("body", F.lit(b"thr"))})
    assert ("a", None, None, None) in got(4) and ("b", "bee", "1", False) in got(4)
    assert cache.compact() == 1 and ("a", None, None, None) in got(4)
    assert cache.compact(older=DAY(2)) == 0


def rules(spark, *regions):
    return sorted(((r.place, r.rule, r.subject) for r in violations(read_regions(spark, {"regions": list(regions)})).collect()), key=str)


def test_every_broken_rule_is_told(spark):
    good = {"metro": "Denver", "state": "CO", "cities": ["Denver", {"city": "Boulder", "aliases": ["The Bubble"]}]}
    assert rules(spark, good) == []
    assert rules(spark, good, {"metro": " DENVER ", "state": "CO", "cities": []}) == [("regions.1", "metro twice", "DENVER")]
    assert rules(spark, good, {"metro": "Front", "state": "CO", "enabled": False, "cities": ["boulder!", {"city": "Boulder", "state": "UT"}]}) == [("regions.1.cities.0", "city twice", "boulder!")]
    assert rules(spark, good | {"enabled": False}) == [("regions", "none enabled", None)] == rules(spark)
    bad = {"metro": "X", "stat": "CO", "cities": ["Nowhere", {"city": "Vail", "state": "CO", "stat": 1, "aliases": ["denver", "the bubble"]}, {"state": "CO"}]}
    assert rules(spark, good, bad) == [
        ("regions.1.cities.0", "no state", "Nowhere"), ("regions.1.cities.1.aliases.0", "alias is a city", "denver"), ("regions.1.cities.1.aliases.1", "alias twice", "the bubble"),
        ("regions.1.cities.1.stat", "unknown key", "stat"), ("regions.1.cities.2", "no city", None), ("regions.1.stat", "unknown key", "stat"),
    ]
