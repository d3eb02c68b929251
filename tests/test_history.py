"""Lifecycle periods by steps and at once."""

import random

from pyspark.sql import functions as F

from siltstone.operators import history


def test_steps_give_the_periods_of_all(spark):
    rnd = random.Random(4)
    scans = list(range(1, 7))
    there = {(k, s) for k in [None, *range(12)] for s in scans if rnd.random() < 0.6}
    seen = spark.createDataFrame(sorted(there, key=str) * 2, "k int, at int")
    want = history.periods(seen, spark.createDataFrame([(s,) for s in scans], "at int"), ["k"], "at")
    now = spark.createDataFrame([], "k int, period int, opened int, closed int")
    for s in scans:
        now = history.advance(now, seen.where(F.col("at") == s), ["k"], F.lit(s))
        now = spark.createDataFrame(now.collect(), now.schema)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(now) == key(want) and now.where("period > 1").count() > 0
    for s in scans:
        assert key(history.as_of(want, F.lit(s)).select("k")) == sorted(((k,) for k, at in there if at == s), key=str)


def test_nothing_seen_closes_all(spark):
    one = spark.createDataFrame([(1, 1, 5, None), (2, 1, 3, 4)], "k int, period int, opened int, closed int")
    out = history.advance(one, one.limit(0), ["k"], F.lit(9))
    assert sorted(map(tuple, out.collect())) == [(1, 1, 5, 9), (2, 1, 3, 4)]
    again = history.advance(out, one.select("k"), ["k"], F.lit(11))
    assert sorted(map(tuple, again.where("closed IS NULL").collect())) == [(1, 2, 11, None), (2, 2, 11, None)]
