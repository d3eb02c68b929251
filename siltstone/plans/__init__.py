"""Every operator applied to the driver's tables, with DuckDB SQL for its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.browse import Sort
from siltstone.operators.page_store import PageStore
from siltstone.store import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


#: What is kept in the shared folder for lists and searches, by application, name and the state of the tables below.
KEPT: dict[tuple, object] = {}


def kept(t: Tables, name: str, tables: tuple[str, ...], build: Callable[[str], object]) -> object:
    """What ``build`` writes to a path for these tables as they are: made when it is first asked for."""
    sc = t.spark.sparkContext
    state = []
    for table in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{table}.parquet")
        files = path.getFileSystem(sc._jsc.hadoopConfiguration()).listStatus(path)
        state += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    key = (sc.applicationId, name, tuple(state))
    if key not in KEPT:
        KEPT[key] = build(scratch(t.spark, name))
    return KEPT[key]


def page_store(t: Tables, name: str, tables: tuple[str, ...], rows: Callable[[], DataFrame], sort: Sort) -> PageStore:
    """A list's page store."""
    return kept(t, name, tables, lambda path: PageStore.build(rows(), path, sort))


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(tables) under its name, with the SQL that gives the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[key] = sql
        return fn

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from siltstone.plans import aggregates, lists, payloads, scans, stored, texts, writes  # noqa: F401
