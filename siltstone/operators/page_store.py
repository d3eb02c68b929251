"""Lists kept in the order in which they are paged: a snapshot clustered by (sort key, id) with an index of its files.

``build`` deals rows to ranges of the order, sorts each, and writes about
``rows`` of them to a file; the index has each file's first and last place and
its number of rows.  A page finds its place in the index and opens the files
from there, twice as many each time until it is full, so a keyset page of any
depth reads a few files whatever the list's size.  Filters are on columns of
the list itself: children that a filter asks about are kept as the set of
different combinations of what it can ask (``combinations``), since one child must
meet all conditions.
"""

from __future__ import annotations

import json
from functools import cmp_to_key, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.operators.browse import MOST, PAGE, Cursor, Page, Sort, token_of

ROWS = 5_000


class File(NamedTuple):
    """A file's rows lie from (first key, first id) to (last key, last id)."""

    path: str
    rows: int
    first: tuple
    last: tuple


def compare(sort: Sort, a: tuple, b: tuple) -> int:
    """The order of two places (key, id): by key, nulls last, then id."""
    (x, i), (y, j) = a, b
    if x != y:
        if x is None or y is None:
            return 1 if x is None else -1
        return (1 if x < y else -1) if sort.descending else (1 if x > y else -1)
    return (i > j) - (i < j)


def combinations(children: DataFrame, by: str, columns: list[str], name: str = "kinds") -> DataFrame:
    """(by, name): the different combinations of ``columns`` that each entity's children have; as many as vocabularies allow at most."""
    return children.groupBy(by).agg(F.collect_set(F.struct(*columns)).alias(name))


def some(name: str, *conds) -> Column:
    """Whether one child meets all conditions, each a function of the child."""
    return F.exists(name, lambda c: reduce(lambda a, b: a & b, [f(c) for f in conds]))


class PageStore:
    """A list in one order; ``files`` is its index, one entry for each file, in that order."""

    def __init__(self, spark: SparkSession, path: str, sort: Sort, id_col: str, schema: StructType, files: list[File]):
        self.spark, self.path, self.sort, self.id_col, self.schema, self.files = spark, path, sort, id_col, schema, files
        #: Files that the last page opened.
        self.opened = 0

    @classmethod
    def build(cls, df: DataFrame, path: str, sort: Sort, id_col: str = "id", rows: int = ROWS) -> PageStore:
        """Writes the snapshot and its index; (key, id) has no ties."""
        spark, order = df.sparkSession, sort.order(id_col)
        parts = max(1, -(-df.count() // rows))
        clustered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        clustered.write.option("maxRecordsPerFile", rows).parquet(f"{path}/rows")
        place = F.struct(F.col(sort.key).alias("k"), F.col(id_col).alias("i"))
        # the greatest rank stands last; descending, the least non-null key does, before all nulls
        if sort.descending:
            rank = F.struct(F.col(sort.key).isNotNull(), sort.key, -F.col(id_col))
            first, last = F.max_by(place, rank), F.min_by(place, rank)
        else:
            rank = F.struct(F.col(sort.key).isNull(), sort.key, id_col)
            first, last = F.min_by(place, rank), F.max_by(place, rank)
        stored = spark.read.schema(df.schema).parquet(f"{path}/rows")
        index = stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"), first.alias("first"), last.alias("last"))
        index.coalesce(1).write.parquet(f"{path}/index")
        spark.createDataFrame([(sort.name, sort.key, sort.descending, id_col, df.schema.json())], "name string, key string, descending boolean, id_col string, schema string").coalesce(1).write.json(f"{path}/about")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageStore:
        about = spark.read.json(f"{path}/about").first()
        sort = Sort(about["name"], about["key"], about["descending"])
        files = [File(r["path"], r["rows"], tuple(r["first"]), tuple(r["last"])) for r in spark.read.parquet(f"{path}/index").collect()]
        files.sort(key=cmp_to_key(lambda a, b: compare(sort, a.first, b.first)))
        return cls(spark, path, sort, about["id_col"], StructType.fromJson(json.loads(about["schema"])), files)

    def start(self, cursor: Cursor | None) -> int:
        """The first file with a place behind the cursor, by bisection."""
        if cursor is None:
            return 0
        lo, hi, at = 0, len(self.files), (cursor.key, cursor.id)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if compare(self.sort, self.files[mid].last, at) > 0 else (mid + 1, hi)
        return lo

    def rows(self, cursor: Cursor | None = None, limit: int = PAGE, where: Column | None = None, columns: list[str] | None = None) -> list:
        """The page's rows and one more, in order; at most ``limit`` + 1 of them."""
        if not 1 <= limit <= MOST:
            raise ValueError(f"limit is 1 to {MOST}")
        at, step, out, self.opened = self.start(cursor), 1, [], 0
        while len(out) <= limit and at < len(self.files):
            some_files = [f.path for f in self.files[at : at + step]]
            df = self.spark.read.schema(self.schema).parquet(*some_files)
            if cursor is not None:
                df = df.where(self.sort.after(cursor.key, cursor.id, self.id_col))
            if where is not None:
                df = df.where(where)
            if columns is not None:
                df = df.select(*dict.fromkeys([*columns, self.sort.key, self.id_col]))
            # files follow each other, and so do their rows
            out += df.orderBy(*self.sort.order(self.id_col)).limit(limit + 1 - len(out)).collect()
            self.opened += len(some_files)
            at, step = at + step, step * 2
        return out

    def page(self, cursor: Cursor | None = None, limit: int = PAGE, where: Column | None = None) -> Page:
        """A page with the token of the next one, if there is one."""
        rows = self.rows(cursor, limit, where)
        shown = rows[:limit]
        return Page(shown, token_of(Cursor(self.sort.name, shown[-1][self.sort.key], shown[-1][self.id_col])) if len(rows) > limit else None)

    def frame(self, columns: list[str], cursor: Cursor | None = None, limit: int = PAGE, where: Column | None = None) -> DataFrame:
        """The same rows as a DataFrame of ``columns``."""
        kinds = {f.name: f for f in self.schema}
        rows = self.rows(cursor, limit, where, columns)
        return self.spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], StructType([kinds[c] for c in columns]))
