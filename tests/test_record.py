import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from siltstone.operators.record import merge_records
from siltstone.operators.runs import since
from siltstone.schemas import SOURCE_PRIORITY
from siltstone.sources.feeds import credentials
from siltstone.streaming.dedup import drain

NOW, BEFORE = dt.datetime(2026, 1, 2), dt.datetime(2025, 1, 2)
RECORDS = "rid long, external_id string, domain string, normalized_name string, metro string, enrich_only boolean, line string"
ENTITIES = "id long, domain string, normalized_name string, metro string, line string, owner_line string"
LINKS = "company_id long, connector string, external_id string, last_seen_at timestamp"


def run(spark, records, entities, links):
    out = merge_records(spark.createDataFrame(records, RECORDS), spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(links, LINKS), ["line"], source="lever", now=F.lit(NOW), priority=SOURCE_PRIORITY)
    return [sorted(map(tuple, df.collect()), key=str) for df in out]


STORED = [
    (1, "a.com", "alpha", "SF", "old", "sec_edgar"),
    (2, None, "beta", "SF", "old", "company_site"),
    (3, "c.com", "gamma", "NY", None, None),
    (4, None, "delta", None, "old", None),
]


def test_resolve_insert_merge_links_pairs(spark):
    records = [
        (1, "x2", "b.com", "renamed", None, False, "new"),  # by external id; takes b.com; lower source overwritten
        (2, None, "a.com", "whoever", "LA", False, "new"),  # by domain; a higher source stays
        (3, None, None, "gamma", "NY", None, None),  # by name: nothing known, nothing written
        (4, "x4", "c.com", "delta", None, False, None),  # 3 has that domain: a pair
        (5, None, "new.com", "omega", "SF", False, "first"),  # inserted
        (6, None, "new.com", "omega 2", "SF", False, "second"),  # updates it
        (7, None, None, "omega", "SF", False, None),  # updates it, by name
        (8, None, None, "nobody", "SF", True, "enrich"),  # skipped
        (9, "y", None, "psi", None, False, "one"),  # inserted
        (10, "y", None, "other psi", None, False, "two"),  # the same external id
        (11, None, None, "psi", None, False, None),  # no key: inserted
        (12, None, None, "psi", None, False, None),  # no key: inserted
    ]
    links = [(2, "lever", "x2", BEFORE), (4, "lever", "x4", BEFORE), (1, "ashby", "y", BEFORE)]
    entities, seen, pairs, of_record = run(spark, records, STORED, links)
    assert entities == sorted(
        [
            (1, "a.com", "alpha", "SF", "old", "sec_edgar"),
            (2, "b.com", "beta", "SF", "new", "lever"),
            (3, "c.com", "gamma", "NY", None, None),
            (4, None, "delta", None, "old", None),
            (5, "new.com", "omega", "SF", "second", "lever"),
            (6, None, "psi", None, "two", "lever"),
            (7, None, "psi", None, None, None),
            (8, None, "psi", None, None, None),
        ],
        key=str,
    )
    assert seen == sorted([(2, "lever", "x2", NOW), (4, "lever", "x4", NOW), (1, "ashby", "y", BEFORE), (6, "lever", "y", NOW)], key=str)
    assert pairs == [(3, 4, 1.0)]
    assert sorted(of_record) == [(1, 2, False), (2, 1, False), (3, 3, False), (4, 4, False), (5, 5, True), (6, 5, True), (7, 5, True), (9, 6, True), (10, 6, True), (11, 7, True), (12, 8, True)]


def test_one_new_domain_for_two_entities_and_similar_names(spark):
    stored = [(1, None, "one", "SF", None, None), (2, None, "two", "SF", None, None), (3, None, "international biscuits", "SF", None, None)]
    links = [(1, "lever", "x1", BEFORE), (2, "lever", "x2", BEFORE)]
    records = [(1, "x2", "d.com", "two", "SF", False, None), (2, "x1", "d.com", "one", "SF", False, None), (3, None, None, "international biscuit", "SF", False, None)]
    entities, _, pairs, _ = run(spark, records, stored, links)
    assert [(e[0], e[1]) for e in entities] == [(1, None), (2, "d.com"), (3, None), (4, None)]
    assert [p[:2] for p in pairs] == [(1, 2), (3, 4)]
    assert pairs[0][2] == 1.0 and 0.85 < pairs[1][2] < 1


def test_nothing_new_and_nothing_stored(spark):
    assert run(spark, [], STORED, [])[0] == sorted(STORED, key=str)
    entities, links, pairs, _ = run(spark, [(1, "x", None, None, None, None, None)], [], [])
    assert entities == [(1, None, None, None, None, None)] and links == [(1, "lever", "x", NOW)] and pairs == []


def test_since():
    assert since(None) is None and since("2026-03-04") == dt.datetime(2026, 3, 4, tzinfo=dt.UTC)
    with pytest.raises(ValueError, match="YYYY-MM-DD"):
        since("4 March")


def test_credentials(spark):
    key = "a" * 19 + "="
    pages = [f'<script>x = {{"app": "AB12CD", "key" : "{key}"}}</script>', f'"appId":"AB1","apiKey":"{key}"', "", None]
    df = spark.createDataFrame([(p,) for p in pages], "page string").select(credentials(F.col("page")).alias("c"))
    assert [r.c and tuple(r.c) for r in df.collect()] == [("AB12CD", key), None, None, None]


def test_a_drain_gives_up_and_goes_on(spark, tmp_path):
    spark.createDataFrame([(1, BEFORE)], "id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    calls, written = [], {}

    def slow(df, number):
        calls.append(number)
        time.sleep(8 if len(calls) == 1 else 0)
        written[number] = [r.id for r in df.collect()]

    run = lambda patience: drain(spark, str(tmp_path / "in"), "id long, ts timestamp", str(tmp_path / "ck"), slow, ["id"], "ts", patience=patience)
    assert run(2) is False and not written
    # the batch that was not completed is given again; an empty one may follow it
    assert run(60) is True and calls[:2] == [0, 0] and written[0] == [1]
