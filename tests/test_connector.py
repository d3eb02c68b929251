"""Sources as Spark data sources: files and archives, filters, limits, columns, streams."""

import datetime as dt
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from siltstone.sources import connector
from siltstone.sources.registry import MAPPERS


def board(*titles):
    return json.dumps({"jobs": [{"id": k, "title": t} for k, t in enumerate(titles, 1)]})


@pytest.fixture
def folder(tmp_path):
    """Payload files of three targets, a hidden one, and one without a target."""
    root = tmp_path / "saved"
    for k, (target, name, text) in enumerate([("acme", "jobs.json", board("Dev", "Ops")), ("beta", "jobs.json", "not json"), ("gamma", "jobs.json", board("Dev")), ("", "loose.json", board()), ("acme", ".part", "x"), ("_tmp", "jobs.json", "x")]):
        (root / target).mkdir(parents=True, exist_ok=True)
        (root / target / name).write_text(text)
        os.utime(root / target / name, (1_700_000_000 + 86_400 * k,) * 2)
    return root


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", list(MAPPERS))
def test_every_source_is_a_format(spark, folder, name):
    df = connector.register(spark).read.format(name).load(str(folder))
    assert df.columns == list(connector.COLUMNS) and df.count() == 4
    assert got(df.select("target", "name")) == [("acme", "jobs.json"), ("beta", "jobs.json"), ("gamma", "jobs.json"), (None, "loose.json")]
    assert {r.fetched_at.astimezone(dt.UTC).day for r in df.where("target = 'acme'").collect()} == {14}


def test_scan_maps_payloads(spark, folder):
    assert got(connector.scan(spark, "greenhouse", str(folder)).select("target", "external_id", "title")) == [("acme", "1", "Dev"), ("acme", "2", "Ops"), ("gamma", "1", "Dev")]
    assert got(connector.scan(spark, "greenhouse", str(folder), dt.date(2023, 11, 16)).select("target")) == [("gamma",)]
    assert connector.scan(spark, "greenhouse", f"file://{folder}").count() == 3
    with pytest.raises(KeyError, match="known"):
        connector.scan(spark, "nowhere", str(folder))


def test_limit_columns_and_filters(spark, folder, monkeypatch):
    read = lambda **o: connector.payloads(spark, "lever", str(folder), **o)
    assert got(read(limit=2).select("target")) == [("acme",), (None,)] and read(limit=0).count() == 0 and read(limit=99).count() == 4
    # a filter above a limit does not raise it
    assert got(read(limit=2).where("target = 'gamma'")) == []
    assert read(columns="target,name").columns == ["target", "name"]
    (folder / "beta" / "jobs.json").unlink()  # no file is opened without payload, nor where a filter leaves it out
    (folder / "beta" / "jobs.json").symlink_to(folder / "gone")
    reader = connector.PayloadReader(str(folder), ["name"], None)
    reader.filters = [(connector.EqualTo, "target", "gamma")]
    assert [s.target for p in reader.partitions() for s, _ in p.files] == ["gamma"]
    assert got(read().where("target = 'gamma' AND name LIKE 'jobs%'").select("target")) == [("gamma",)]
    assert got(read().where(F.col("target").isin("gamma", "acme") & (F.col("fetched_at") > "2023-11-15")).select("target")) == [("gamma",)]
    with pytest.raises(Exception, match="no such columns"):
        read(columns="name,size").count()
    with pytest.raises(Exception, match="not negative"):
        read(limit=-1).count()


def test_archives_are_payloads_too(spark, tmp_path):
    root = str(tmp_path / "archive")
    rows = [(f"n{k}", f"t{k % 3}", dt.datetime(2026, 1, 1 + k), board(f"J{k}")) for k in range(9)]
    spark.createDataFrame(rows, "name string, target string, fetched_at timestamp, payload string").repartition(3).write.parquet(root)
    read = lambda **o: connector.payloads(spark, "greenhouse", root, **o)
    assert got(read().select("name")) == sorted((f"n{k}",) for k in range(9))
    assert read(limit=4).count() == 4 and got(read().where("target = 't1' AND fetched_at >= '2026-01-05'").select("name")) == [("n4",), ("n7",)]
    assert got(connector.scan(spark, "greenhouse", root).where("target = 't2'").select("title")) == [("J2",), ("J5",), ("J8",)]


def test_stream_reads_each_file_once(spark, folder, tmp_path):
    connector.register(spark)
    out, seen = str(tmp_path / "out"), lambda: got(spark.read.parquet(out).select("target", "name"))

    def drain():
        stream = spark.readStream.format("greenhouse").load(str(folder))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    drain()
    assert seen() == [("acme", "jobs.json"), ("beta", "jobs.json"), ("gamma", "jobs.json"), (None, "loose.json")]
    (folder / "delta").mkdir()
    (folder / "delta" / "jobs.json").write_text(board("New"))
    drain()
    assert len(seen()) == 5 and ("delta", "jobs.json") in seen()


def test_a_source_needs_a_path(spark):
    with pytest.raises((AnalysisException, Exception), match="path"):
        connector.register(spark).read.format("ashby").load().count()
