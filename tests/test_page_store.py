"""Pages from a clustered snapshot are those of the whole list sorted."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators.browse import Cursor, Sort, cursor_of
from siltstone.operators.page_store import PageStore, combinations, some


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("kind", ["double", "string"])
def test_walk_of_all_pages(spark, tmp_path, descending, kind):
    rnd = random.Random(1)
    values = [None, *range(12)] if kind == "double" else [None, "a", "B", "é", "zz", "", "b"]
    data = [(i, rnd.choice(values), rnd.randint(0, 3)) for i in range(300)]
    data = [(i, float(v) if kind == "double" and v is not None else v, w) for i, v, w in data]
    df = spark.createDataFrame(data, f"id long, k {kind}, w int").repartition(3)
    sort = Sort("k", "k", descending)
    store = PageStore.build(df, str(tmp_path / "p"), sort, rows=40)
    assert len(store.files) >= 7 and sum(f.rows for f in store.files) == 300
    for where in (None, F.col("w") == 1):
        want = [(r.id, r.k) for r in (df if where is None else df.where(where)).orderBy(*sort.order()).collect()]
        got, cursor = [], None
        while True:
            page = store.page(cursor, 23, where)
            got += [(r.id, r.k) for r in page.rows]
            if page.next is None:
                break
            cursor = cursor_of(page.next, "k")
        assert got == want
    again = PageStore.open(spark, str(tmp_path / "p"))
    assert again.files == store.files and again.schema == store.schema


def test_deep_pages_open_few_files(spark, tmp_path):
    df = spark.range(10_000).select("id", (F.col("id") * 7 % 10_000).cast("double").alias("k"))
    store = PageStore.build(df, str(tmp_path / "p"), Sort("k", "k"), rows=250)
    rows = store.rows(Cursor("k", 7777.0, 1111), 50)
    assert [r.k for r in rows][:2] == [7778.0, 7779.0] and len(rows) == 51 and store.opened <= 3
    assert store.rows(Cursor("k", 9999.0, 1 << 40)) == [] and store.opened <= 1
    assert store.frame(["id"], Cursor("k", 9990.0, 1 << 40), 20).count() == 9
    with pytest.raises(ValueError):
        store.rows(limit=0)


def test_empty_list(spark, tmp_path):
    store = PageStore.build(spark.range(0).select("id", F.col("id").alias("k")), str(tmp_path / "p"), Sort("k", "k"))
    assert store.page().rows == [] and store.page().next is None


def test_one_child_meets_all_conditions(spark):
    kids = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", False), (2, "b", True), (1, "a", True)], "company_id long, family string, open boolean")
    found = combinations(kids, "company_id", ["family", "open"])
    assert {r.company_id for r in found.where(some("kinds", lambda c: c["family"] == "a", lambda c: c["open"])).collect()} == {1}
    assert max(r.n for r in found.select(F.size("kinds").alias("n")).collect()) == 2
