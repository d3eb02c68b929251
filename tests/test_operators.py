import datetime as dt

import pytest
from pyspark.sql import functions as F

from siltstone import store
from siltstone.operators import browse as B
from siltstone.operators import fold as G
from siltstone.operators import health as H
from siltstone.operators import resolve as R
from siltstone.operators import search
from siltstone.operators import similar as S
from siltstone.operators import upsert as U
from siltstone.schemas import MERGE_CANDIDATES


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_rules_and_idempotence(spark):
    old = spark.createDataFrame([(1, "a", True), (2, None, False), (3, "c", None)], "id long, name string, hq boolean")
    new = spark.createDataFrame([(2, "b", True), (3, None, False), (4, "d", None)], "id long, name string, hq boolean")
    rules = {"name": U.coalesce_new, "hq": U.either}
    once = U.upsert(old, new, ["id"], rules)
    assert rows(once) == [(1, "a", True), (2, "b", True), (3, "c", False), (4, "d", None)]
    twice = [(i, n, bool(h) if i > 1 else h) for i, n, h in rows(once)]
    assert rows(U.upsert(once, new, ["id"], rules)) == twice


def test_close_missing(spark):
    t = dt.datetime(2026, 1, 1)
    stored = spark.createDataFrame([(1, None), (2, None), (3, dt.datetime(2025, 1, 1))], "id long, closed_at timestamp")
    now = F.lit(t)
    seen = spark.createDataFrame([(1,)], "id long")
    assert rows(U.close_missing(stored, seen, ["id"], "closed_at", now)) == [(1, None), (2, t), (3, dt.datetime(2025, 1, 1))]
    assert rows(U.close_missing(stored, seen.limit(0), ["id"], "closed_at", now))[0] == (1, t)


def test_new_ids_are_dense_and_ordered(spark):
    old = spark.createDataFrame([(7, 100)], "id long, k long")
    new = spark.createDataFrame([(k,) for k in range(90, 130)], "k long")
    got = rows(U.insert_missing(old, new, ["k"], "id", "k"))
    assert [(r[0], r[1]) for r in got] == sorted(((k, i) for i, k in enumerate([k for k in range(90, 130) if k != 100], 8)), key=str)


SORT = B.Sort("amount", "amount_usd", descending=True)


def test_pages_walk_the_whole_sort(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, None, 7.0, 5.0, None, 1.0, 7.0, 5.0])], "id long, amount_usd double")
    want = [r.id for r in df.orderBy(*SORT.order()).collect()]
    got, cursor = [], None
    while True:
        page = B.read_page(df, SORT, cursor, 3)
        got += [r.id for r in page.rows]
        if page.next is None:
            break
        cursor = B.cursor_of(page.next, "amount")
    assert got == want == [2, 6, 0, 3, 7, 5, 1, 4]


def test_cursor_refuses(spark):
    token = B.token_of(B.Cursor("amount", 5.0, 3))
    assert B.cursor_of(token, "amount") == B.Cursor("amount", 5.0, 3)
    for bad in ("x", token[:-3], B.token_of(B.Cursor("amount", "\0", 1)), B.token_of(B.Cursor("amount", 1, -1)), B.token_of(B.Cursor("amount", True, 1)), token + "=", token + "A"):
        with pytest.raises(ValueError):
            B.cursor_of(bad, "amount")
    with pytest.raises(ValueError):
        B.cursor_of(token, "name")
    with pytest.raises(ValueError):
        B.page_of(spark.range(3), B.Sort("id", "id"), limit=0)


def test_filter_object():
    assert B.Filters().is_empty and B.Filters(q="  ").text is None
    assert B.Filters(flexible=True).has_job_filters
    assert B.clean_list([" a ", "", "a", "b"]) == ("a", "b")
    with pytest.raises(ValueError):
        B.clean_list(["z"], ("a",))
    assert B.whole_number(" ") is None and B.whole_number("7") == 7


def test_one_job_meets_all_filters(spark):
    companies = spark.createDataFrame([(1, "seed", 1, 9), (2, "seed", 1, 9)], "id long, stage string, open_job_count int, latest_round_id long")
    jobs = spark.createDataFrame([(1, "a", "x", None), (1, "b", "y", None), (2, "a", "y", None)], "company_id long, role_family string, seniority string, closed_at timestamp").withColumn("flexible_signal", F.lit(True)).withColumn("employment_type", F.lit("full_time"))
    notes = spark.createDataFrame([(1, "contacted")], "company_id long, status string")
    places = spark.createDataFrame([(1, "Oslo", "N"), (1, "Rome", "S"), (2, "Rome", "S")], "company_id long, city string, metro string")
    rounds = spark.createDataFrame([(9, "seed", None, None)], "id long, round_type string, amount_usd double, announced_date date")
    none = spark.createDataFrame([], "company_id long, name string, kind string, confidence string")

    def ids(f):
        got = B.filter_companies(companies, f, locations=places, sectors=none, rounds=rounds, contacts=none, notes=notes, jobs=jobs, today=F.current_date())
        return sorted(r.id for r in got.collect())

    assert ids(B.Filters(families=("a",), seniorities=("y",))) == [2]
    assert ids(B.Filters(tracking=("none",))) == [2]
    assert ids(B.Filters(cities=("Oslo",), metros=("S",))) == [1]
    assert ids(B.Filters(amount_min=1)) == []
    assert ids(B.Filters(has_email=True)) == []
    assert ids(B.Filters()) == [1, 2]


def test_streaks(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    runs = spark.createDataFrame([("a", 1, t(1), "error"), ("a", 2, t(2), "ok"), ("a", 3, t(3), "error"), ("a", 4, t(3), "error"), ("b", 5, t(1), "error"), ("b", 6, t(2), "partial")], "source string, id long, at timestamp, status string")
    assert rows(H.failure_streaks(runs, "source", F.col("status") == "error", [F.desc("at"), F.desc("id")])) == [("a", 2)]


def test_similarity_boundary(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(S.similarity(F.col("a"), F.col("b"))).first()[0]
    assert not pair("applied intuition", "applied intuitions") > float(0.85) + 1e-6
    assert pair("", "x") == 0.0
    df = spark.createDataFrame([(1, "acme robotics systems", "m"), (2, "acme robotics system", "m"), (3, "acme robotics system", "m"), (4, "acme robotics system", "n")], "id long, name string, metro string")
    assert [(r.a, r.b) for r in S.similar_pairs(df, "id", "name", ["metro"], 0.85).orderBy("a", "b").collect()] == [(1, 2), (1, 3)]


def test_resolution_order(spark):
    stored = spark.createDataFrame([(1, "x", "a.com", "acme", "sf"), (2, "x", None, "acme", "ny"), (3, "y", None, "beta", "sf")], "id long, external_id string, domain string, normalized_name string, metro string")
    records = spark.createDataFrame([("x", "a.com", "zeta", "sf"), ("y", "a.com", "zeta", "sf"), (None, "no.com", "beta", "sf"), (None, None, "acme", None)], "external_id string, domain string, normalized_name string, metro string")
    got = [(r.entity_id, r.matched_by) for r in R.resolve(records, stored).collect()]
    assert sorted(got, key=str) == sorted([(1, "domain"), (3, "external_id"), (3, "name"), (None, None)], key=str)


def test_fold_refuses_chains(spark):
    with pytest.raises(ValueError):
        G.check_decisions(spark.createDataFrame([(1, 2), (2, 3)], "keep_id long, drop_id long"))


def test_guarded_move(spark):
    kids = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "company long, kind string")
    d = spark.createDataFrame([(1, 2)], "keep_id long, drop_id long")
    assert rows(G.guarded_move(kids, d, "company", ["kind"])) == [(1, "a", False), (1, "b", True)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "The red fox runs"), (2, "a fox, red"), (3, "")], "id long, text string")
    find = lambda q: sorted(r.id for r in search.documents_with(docs, "id", "text", q).collect())
    assert find("red fox") == [1, 2] and find('"red fox"') == [1] and find("fox -runs") == [2] and find("the") == []
    assert find("running foxes") == [1] and find("-run") == [2, 3] and find("runs or RED -fox") == [1] and find('fox or "red run"') == [1, 2] and find('"running the red" or zebra') == []
    assert find('"fox a red"') == [] and find('"the red fox"') == [1] and find("or") == []
    assert ("fox", 1, [2]) in rows(search.postings(docs, "id", "text"))


def test_snapshots(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), MERGE_CANDIDATES)
    assert t.read().count() == 0
    one = spark.createDataFrame([(1, 2, 0.9, "name", None)], MERGE_CANDIDATES)
    t.write(one)
    before = t.read()
    t.write(before.unionByName(spark.createDataFrame([(1, 3, 0.8, "name", None)], MERGE_CANDIDATES)))
    assert t.read().count() == 2 and before.count() == 1


def test_filters_from_a_form():
    f = B.filters_of({"q": [" x\0 "], "city": ["Oslo", " Oslo ", ""], "amount_min": ["5"], "flexible": ["on"], "stage": ["seed"]}, {"stage": ("seed",)})
    assert f == B.Filters(q="x", cities=("Oslo",), amount_min=5, flexible=True, stages=("seed",))
    for bad in ({"stage": ["x"]}, {"amount_max": ["many"]}, {"round_months": ["0"]}):
        with pytest.raises(ValueError):
            B.filters_of(bad, {"stage": ("seed",)})


def test_run_log(spark):
    from siltstone.operators import runs

    t = dt.datetime(2026, 1, 1)
    log = runs.started(spark, 1, "lever", t)
    assert log.first().status == "error" and runs.anchor(log, "lever").first().anchor is None
    done = runs.completed(log, 1, t, 5, 4, [], ["odd  item"])
    r = done.first()
    assert (r.connector, r.status, r.fetched, r.error_text, r.started_at) == ("lever", "partial", 5, "odd item", t)
    assert runs.anchor(done, "lever").first().anchor == t
    assert runs.join_errors([]) is None and runs.join_errors(["a" * 10] * 5, 30) == "a" * 10 + "\n... (+4 more)"


def test_cron_period():
    from siltstone.operators.runs import period

    assert [period(c) for c in ("0 6 * * *", "*/15 * * * *", "0 6 * * 1", "0 0 1 * *", None)] == [dt.timedelta(days=1), dt.timedelta(minutes=15), dt.timedelta(days=7), dt.timedelta(days=31), None]
    with pytest.raises(ValueError):
        period("61 * * * *")


def test_candidates_are_similar_names_of_one_place(spark):
    stored = spark.createDataFrame([(1, "applied intuition", "sf"), (2, "applied intuition", "ny"), (3, "quantum widget works", "sf"), (4, None, "sf")], "id long, normalized_name string, metro string")
    records = spark.createDataFrame([(7, "applied intuitions", "sf"), (8, "quantum widgets works", "sf"), (9, "applied intuition", "sf"), (10, "quantum widgets works", None)], "rid long, normalized_name string, metro string")
    got = {(r.rid, r.entity_id) for r in R.candidates(records, stored, "rid", threshold=0.8).collect()}
    assert got == {(7, 1), (8, 3)}
    # exactly 0.85 is no candidate
    assert {(r.rid, r.entity_id) for r in R.candidates(records, stored, "rid").collect()} <= {(8, 3)}


def test_repointing_meets_decisions_by_equality(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5)], "a long, b long")
    moved = G.repoint_pairs(pairs, spark.createDataFrame([(9, 2), (5, 3)], "keep_id long, drop_id long"))
    assert rows(moved) == [(1, 9), (2, 5), (3, 9), (4, 5)]
    assert "NestedLoop" not in moved._jdf.queryExecution().toString()
