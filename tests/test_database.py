"""Several tables in one commit, folds of all children, derived columns kept up by differences."""

import datetime as dt
import random
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.database import Conflict, Database
from siltstone.operators import denormal
from siltstone.operators import fold_all as G

UTC = dt.UTC
DAY = lambda d: dt.datetime(2026, 1, d, tzinfo=UTC)
TWO = {"a": "id long, v string", "b": "id long, w double"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def one(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_all_tables_change_or_none(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), TWO)
    assert db.snapshot().version == 0 and rows(db.snapshot()["a"]) == []
    first = db.commit(lambda s: {"a": one(spark, TWO["a"], (1, "x")), "b": one(spark, TWO["b"], (1, 0.5))})
    assert first.version == 1

    def crashes(s):
        # the second table fails while it is written, after the first has been
        bad = one(spark, TWO["b"], (2, 1.0)).withColumn("w", F.raise_error(F.lit("lost")).cast("double"))
        return {"a": one(spark, TWO["a"], (2, "y")), "b": bad}

    with pytest.raises(Exception, match="lost"):
        db.commit(crashes)
    assert db.snapshot().version == 1 and rows(db.snapshot()["a"]) == [(1, "x")] and rows(db.snapshot()["b"]) == [(1, 0.5)]
    assert db.commit(lambda s: {}).version == 1
    # a table that a commit leaves out keeps its snapshot; old versions stay readable
    db.commit(lambda s: {"a": s["a"].withColumn("v", F.lit("z"))})
    assert rows(db.snapshot()["a"]) == [(1, "z")] and rows(db.snapshot()["b"]) == [(1, 0.5)] and rows(db.snapshot(1)["a"]) == [(1, "x")]
    assert db.vacuum(keep=1) == 1 and db.versions() == [2] and rows(db.snapshot()["a"]) == [(1, "z")]


def test_commits_that_meet_are_made_again(spark, tmp_path):
    db, seen = Database(spark, str(tmp_path / "db"), TWO), []
    db.commit(lambda s: {"a": one(spark, TWO["a"], (0, "first"))})

    def change(s):
        seen.append(s.version)
        if len(seen) == 1:  # another writer is faster
            Database(spark, db.path, TWO).commit(lambda t: {"a": t["a"].unionByName(one(spark, TWO["a"], (1, "other")))})
        return {"a": s["a"].unionByName(one(spark, TWO["a"], (2, "mine")))}

    assert db.commit(change).version == 3 and seen == [1, 2]
    assert rows(db.snapshot()["a"]) == [(0, "first"), (1, "other"), (2, "mine")]

    def hopeless(s):
        Database(spark, db.path, TWO).commit(lambda t: {"b": one(spark, TWO["b"], (t.version, 0.0))})
        return {"a": s["a"]}

    with pytest.raises(Conflict):
        db.commit(hopeless, attempts=2)


def test_writers_in_threads_lose_nothing(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), TWO)
    add = lambda k: db.commit(lambda s: {"a": s["a"].unionByName(one(spark, TWO["a"], (k, "t"))).coalesce(1)}, attempts=50)
    threads = [threading.Thread(target=add, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert rows(db.snapshot()["a"]) == [(k, "t") for k in range(4)] and db.snapshot().version == 4


# --- folds --------------------------------------------------------------------------------


def decided(spark, *pairs):
    return spark.createDataFrame(list(pairs), "keep_id long, drop_id long")


def test_chains_are_settled(spark):
    chain = [(k, k + 1) for k in range(1, 20)] + [(1, 50), (50, 51), (1, 50)]
    assert rows(G.settled(decided(spark, *chain))) == sorted([(1, k) for k in [*range(2, 21), 50, 51]], key=str)
    for bad, why in (([(1, 1)], "itself"), ([(1, 2), (3, 2)], "two others"), ([(1, 2), (2, 1)], "circle"), ([(1, 2), (2, 3), (3, 1)], "circle")):
        with pytest.raises(ValueError, match=why):
            G.settled(decided(spark, *bad))


@pytest.fixture
def tables(spark):
    company = lambda i, domain, one_liner, prov, first: (i, f"c{i}", f"c{i}", domain, None, one_liner, None, None, None, "seed", "active", None, None, None, None, 0, prov, DAY(first), DAY(first + 1))
    data = {
        "companies": [company(1, None, None, {"name": "lever"}, 5), company(2, "two.com", None, {"domain": "yc"}, 3), company(3, "three.com", "line", {"one_liner": "sec", "name": "sec"}, 8), company(4, "four.com", None, None, 2)],
        "jobs": [(10, 1, "x", "t", None, DAY(1), None), (11, 2, "x", "t", DAY(2), DAY(1), None), (12, 2, None, "t", DAY(4), DAY(1), None), (13, 3, "x", "t", DAY(9), DAY(1), None), (14, 3, "y", "t", DAY(9), DAY(1), DAY(9)), (15, 4, "x", "t", DAY(3), DAY(1), None), (16, 3, None, "t", DAY(1), DAY(1), None)],
        "bookmarks": [(11, "first star"), (13, "second star"), (15, None)],
        "rounds": [(20, 2, "seed", 5, dt.date(2026, 1, 1)), (21, 3, "a", 6, None), (22, 1, "a", 6, dt.date(2025, 1, 1))],
        "people": [(30, 1, "Ann", None, "u"), (31, 2, "Ann", None, "u"), (32, 3, "Ann", "ceo", "u"), (33, 4, "Bo", None, None), (34, 4, "Bo", None, None)],
        "contacts": [(40, 1, "email", "a@x", "constructed"), (41, 2, "email", "a@x", "published"), (42, 3, "email", "b@x", "constructed"), (43, 4, "email", "a@x", "constructed")],
        "locations": [(1, 7, False), (2, 7, True), (3, 8, True)],
        "sectors": [(1, 1), (2, 1), (2, 2), (3, 2)],
        "sources": [(1, "lever", None, DAY(1)), (2, "lever", "l2", DAY(1)), (3, "lever", "l3", DAY(2)), (3, "yc", "y3", DAY(1))],
        "notes": [(1, "none", None, None, DAY(1)), (2, "applied", 5, "mine", DAY(1)), (3, "none", None, "other", DAY(1)), (4, "none", None, None, DAY(1))],
        "pairs": [(1, 2, 0.9, None), (2, 4, 0.5, None), (3, 4, 0.7, None), (1, 3, 0.6, None), (2, 3, 0.8, DAY(1)), (4, 9, 0.4, DAY(2))],
    }
    return {t: spark.createDataFrame(data[t], s) for t, s in G.SCHEMAS.items()}


def test_fold_takes_every_child_along(spark, tables, tmp_path):
    """2 and 3 (through 2) go into 1; 4 is not touched."""
    db = Database(spark, str(tmp_path / "db"), G.SCHEMAS)
    db.commit(lambda s: tables)
    told = []

    def fold(s):
        out, report = G.fold_tables({t: s[t] for t in G.SCHEMAS}, decided(spark, (1, 2), (2, 3)), F.lit(DAY(20)))
        told.extend(tuple(r) for r in report.collect())
        return out

    s = db.commit(fold)
    assert s.version == 2
    pick = lambda t, *cols: rows(s[t].select(*cols))
    assert pick("jobs", "id", "company_id") == [(10, 1), (12, 1), (14, 1), (15, 4), (16, 1)]
    assert pick("bookmarks", "job_id", "note") == [(10, "first star"), (15, None)]
    assert pick("rounds", "id", "company_id") == [(20, 1), (21, 1), (22, 1)]
    assert pick("people", "id", "company_id") == [(30, 1), (32, 1), (33, 4), (34, 4)]
    assert pick("contacts", "id", "company_id", "confidence") == [(40, 1, "published"), (42, 1, "constructed"), (43, 4, "constructed")]
    assert pick("locations", "company_id", "location_id", "is_hq") == [(1, 7, False), (1, 8, True)]
    assert pick("sectors", "company_id", "sector_id") == [(1, 1), (1, 2)]
    assert pick("sources", "company_id", "connector", "external_id") == [(1, "lever", "l2"), (1, "yc", "y3")]
    assert pick("notes", "company_id", "status", "note", "rating") == [(1, "applied", "mine", 5), (4, "none", None, None)]
    assert pick("pairs", "a", "b", "similarity", F.col("resolved_at").isNull()) == [(1, 4, 0.7, True), (4, 9, 0.4, False)]
    c = {r.id: r for r in s["companies"].collect()}
    assert c.keys() == {1, 4} and (c[1].name, c[1].domain, c[1].one_liner) == ("c1", "two.com", "line")
    assert c[1].field_provenance == {"name": "lever", "domain": "yc", "one_liner": "sec"}
    assert (c[1].open_job_count, c[1].latest_round_id, c[1].latest_job_posted_at.day) == (3, 20, 4)
    assert (c[1].first_seen_at.day, c[1].last_seen_at.day) == (3, 9) and (c[4].open_job_count, c[4].first_seen_at.day) == (0, 2)
    assert sorted(told, key=str) == sorted([(1, 2, "job discarded", "11"), (1, 3, "job discarded", "13"), (1, 3, "bookmark note discarded", "second star"), (1, 3, "external id discarded", "lever:l3"), (1, 3, "note discarded", "other")], key=str)
    with pytest.raises(ValueError, match="not there"):
        G.fold_tables({t: s[t] for t in G.SCHEMAS}, decided(spark, (1, 77)), F.lit(DAY(20)))


def test_folds_of_nothing_change_nothing(spark, tables):
    out, report = G.fold_tables(tables, decided(spark).limit(0), F.lit(DAY(20)))
    assert report.count() == 0
    assert all(rows(out[t]) == rows(tables[t]) for t in G.SCHEMAS if t != "companies") and out["companies"].count() == 4


# --- derived columns ----------------------------------------------------------------------


def state(rnd):
    at = lambda: None if rnd.random() < 0.3 else DAY(rnd.randint(1, 28))
    jobs = {k: (k, rnd.randint(1, 6), str(k), "t", at(), DAY(rnd.randint(1, 28)), at()) for k in rnd.sample(range(40), 25)}
    rounds = {k: (k, rnd.randint(1, 6), "a", 1, (d := at()) and d.date()) for k in rnd.sample(range(20), 12)}
    return jobs, rounds


def test_differences_give_the_full_refresh(spark):
    rnd = random.Random(11)
    companies = spark.createDataFrame([(i, f"c{i}", None, None, 0) for i in range(1, 8)], "id long, name string, latest_round_id long, latest_job_posted_at timestamp, open_job_count long")
    frame = lambda rows, t: spark.createDataFrame(list(rows.values()), G.SCHEMAS[t])
    jobs, rounds = state(rnd)
    now = denormal.refresh_denormalized(companies, frame(jobs, "jobs"), frame(rounds, "rounds"))
    for _ in range(4):
        before_j, before_r = dict(jobs), dict(rounds)
        other_j, other_r = state(rnd)
        touched_j, touched_r = set(rnd.sample(range(40), 12)), set(rnd.sample(range(20), 6))
        for k in touched_j:
            jobs.pop(k, None)
            jobs.update({k: other_j[k]} if k in other_j else {})
        for k in touched_r:
            rounds.pop(k, None)
            rounds.update({k: other_r[k]} if k in other_r else {})
        ids = lambda s: spark.createDataFrame([(k,) for k in s], "id long")
        job_changes = denormal.changes(frame(before_j, "jobs"), frame(jobs, "jobs"), ids(touched_j))
        round_changes = denormal.changes(frame(before_r, "rounds"), frame(rounds, "rounds"), ids(touched_r))
        now = denormal.apply_changes(now, job_changes, round_changes, frame(jobs, "jobs"), frame(rounds, "rounds"))
        now = spark.createDataFrame(now.collect(), now.schema)
        assert rows(now) == rows(denormal.refresh_denormalized(companies, frame(jobs, "jobs"), frame(rounds, "rounds")))


def test_subsets_leave_others_alone(spark):
    rnd = random.Random(5)
    jobs, rounds = state(rnd)
    j, r = spark.createDataFrame(list(jobs.values()), G.SCHEMAS["jobs"]), spark.createDataFrame(list(rounds.values()), G.SCHEMAS["rounds"])
    companies = spark.createDataFrame([(i, 99, None, -1) for i in range(1, 7)], "id long, latest_round_id long, latest_job_posted_at timestamp, open_job_count long")
    full = {x.id: x for x in denormal.refresh_denormalized(companies, j, r).collect()}
    part = {x.id: x for x in denormal.refresh_denormalized(companies, j, r, spark.createDataFrame([(2,), (5,), (2,)], "id long")).collect()}
    assert all(part[i] == full[i] for i in (2, 5)) and all(part[i].open_job_count == -1 for i in (1, 3, 4, 6)) and len(part) == 6
    none = companies.limit(0).select("id")
    assert rows(denormal.refresh_denormalized(companies, j, r, none)) == rows(companies)
