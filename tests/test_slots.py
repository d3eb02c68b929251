"""Slots for each host, replayed and streamed."""

import datetime as dt
import random

from siltstone.streaming import slots

START = dt.datetime(2026, 1, 1)
REQUEST = "host string, id long, at timestamp, delay long"


def by_hand(rows, budget):
    last, used, out = {}, {}, []
    for host, i, at, delay in sorted((r for r in rows if r[0] and r[2]), key=lambda r: (r[2], r[1])):
        if budget is not None and used.get(host, 0) >= budget:
            continue
        slot = at if host not in last else max(at, last[host] + dt.timedelta(milliseconds=delay))
        last[host], used[host] = slot, used.get(host, 0) + 1
        out.append((host, i, slot))
    return sorted(out)


def requests(n):
    rnd = random.Random(n)
    delays = {h: rnd.choice([0, 500, 2000, 60_000]) for h in "abcd"}
    rows = [(h := rnd.choice("abcd"), i, START + dt.timedelta(milliseconds=rnd.randint(0, 100_000)), delays[h]) for i in range(n)]
    return [*rows, (None, n, START, 1), ("a", n + 1, None, delays["a"]), rows[0][:1] + (n + 2,) + rows[0][2:]]


def test_replay(spark):
    rows = requests(200)
    df = spark.createDataFrame(rows, REQUEST).repartition(3)
    for budget in (None, 7, 0):
        got = sorted((r.host, r.id, r.slot) for r in slots.admitted(df, budget=budget).collect())
        assert got == by_hand(rows, budget)
    assert slots.admitted(df.limit(0)).count() == 0


def test_stream_goes_on_from_its_state(spark, tmp_path):
    rows = sorted((r for r in requests(60) if r[0] and r[2]), key=lambda r: (r[2], r[1]))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:25], rows[25:]):  # a micro-batch each, and a restart between
        spark.createDataFrame(part, REQUEST).coalesce(1).write.mode("append").parquet(source)
        stream = slots.stream(spark.readStream.schema(REQUEST).parquet(source), budget=12)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    assert sorted((r.host, r.id, r.slot) for r in spark.read.parquet(out).collect()) == by_hand(rows, 12)
