"""Edits of ordered vocabularies."""

import pytest
from pyspark.sql import functions as F

from siltstone.database import Database
from siltstone.operators import vocabulary as V


def test_edits_and_old_versions(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), {V.TABLE: V.SCHEMA, "t": "id long, stage string", "u": "id long, stage string"})
    uses = [("t", "stage"), ("u", "stage")]
    frame = lambda *rows: spark.createDataFrame(rows, "id long, stage string")
    db.commit(lambda s: {"t": frame((1, "seed"), (2, "late"), (3, None), (4, "odd")), "u": frame((1, "late"))})
    first = V.create(db, "stage", ["seed", "late"])
    order = lambda s: [r.id for r in s["t"].select("id", V.place(s, "stage", F.col("stage")).alias("p")).orderBy(F.asc_nulls_last("p"), "id").collect()]
    assert order(db.snapshot()) == [1, 2, 3, 4] and [tuple(r) for r in V.strays(db.snapshot(), "stage", uses).collect()] == [("t", "stage", "odd", 1)]
    V.add(db, "stage", "odd")
    V.add(db, "stage", "early", after="seed")
    assert V.values(db.snapshot(), "stage") == ["odd", "seed", "early", "late"] and order(db.snapshot()) == [4, 1, 2, 3]
    version = db.snapshot().version
    assert V.add(db, "stage", "early") == version and V.remove(db, "stage", "nothing", uses) == version
    V.rename(db, "stage", "late", "growth", uses)
    assert sorted((r.id, r.stage) for r in db.snapshot()["t"].where("stage IS NOT NULL").collect()) == [(1, "seed"), (2, "growth"), (4, "odd")]
    V.remove(db, "stage", "growth", uses)
    assert sorted(r.id for r in db.snapshot()["t"].collect()) == [1, 3, 4] and db.snapshot()["u"].count() == 0
    # what was is still there
    old = db.snapshot(first)
    assert V.values(old, "stage") == ["seed", "late"] and order(old) == [1, 2, 3, 4] and old["u"].count() == 1
    for bad in (lambda: V.create(db, "stage", ["x"]), lambda: V.create(db, "other", ["x", "x"]), lambda: V.add(db, "stage", "x", after="none"), lambda: V.rename(db, "stage", "none", "x", uses), lambda: V.rename(db, "stage", "odd", "seed", uses)):
        with pytest.raises(ValueError):
            bad()
