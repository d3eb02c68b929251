"""Ordered vocabularies kept in the database: values sort by their place, and edits are commits.

A value can be added behind another or first, renamed, or removed together with
the rows that have it.  Each edit changes the vocabulary and all tables that use
it in one commit, so a reader never meets a value without a place; versions
before an edit stay readable with the order that they had.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.database import Database, Snapshot

SCHEMA = "vocabulary string, place int, value string"
TABLE = "vocabularies"

#: (table, column) that hold values of a vocabulary.
Uses = list[tuple[str, str]]


def values(s: Snapshot, name: str) -> list[str]:
    """A vocabulary's values in order; a few."""
    return [r["value"] for r in s[TABLE].where(F.col("vocabulary") == name).orderBy("place").collect()]


def _written(s: Snapshot, name: str, now: list[str]) -> DataFrame:
    rows = s.database.spark.createDataFrame([(name, k, v) for k, v in enumerate(now)], SCHEMA)
    return s[TABLE].where(F.col("vocabulary") != name).unionByName(rows)


def create(db: Database, name: str, now: list[str]) -> int:
    """A vocabulary of different values; the version that has it."""
    if len(set(now)) < len(now):
        raise ValueError(f"a value is twice in {name}")

    def change(s: Snapshot) -> dict[str, DataFrame]:
        if values(s, name):
            raise ValueError(f"{name} is there already")
        return {TABLE: _written(s, name, now)}

    return db.commit(change).version


def add(db: Database, name: str, value: str, after: str | None = None) -> int:
    """``value`` behind ``after``, or as the first; nothing changes if it is there already."""

    def change(s: Snapshot) -> dict[str, DataFrame]:
        have = values(s, name)
        if value in have:
            return {}
        if after is not None and after not in have:
            raise ValueError(f"{after} is no value of {name}")
        at = 0 if after is None else have.index(after) + 1
        return {TABLE: _written(s, name, [*have[:at], value, *have[at:]])}

    return db.commit(change).version


def rename(db: Database, name: str, old: str, new: str, uses: Uses) -> int:
    """``old`` is called ``new`` from now on, in its place and in all rows."""

    def change(s: Snapshot) -> dict[str, DataFrame]:
        have = values(s, name)
        if old not in have or new in have:
            raise ValueError(f"cannot rename {old} to {new} in {name}")
        out = {TABLE: _written(s, name, [new if v == old else v for v in have])}
        for table, column in uses:
            out[table] = out.get(table, s[table]).withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
        return out

    return db.commit(change).version


def remove(db: Database, name: str, value: str, uses: Uses) -> int:
    """The vocabulary without ``value``, and the tables without the rows that have it; nothing changes if it is not there."""

    def change(s: Snapshot) -> dict[str, DataFrame]:
        have = values(s, name)
        if value not in have:
            return {}
        out = {TABLE: _written(s, name, [v for v in have if v != value])}
        for table, column in uses:
            rows = out.get(table, s[table])
            out[table] = rows.where(~F.coalesce(F.col(column) == value, F.lit(False)))
        return out

    return db.commit(change).version


def place(s: Snapshot, name: str, col: Column) -> Column:
    """The place of a value in the snapshot's order, from 1; null if it has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, values(s, name))).cast("array<string>"), col), F.lit(0)).cast("int")


def strays(s: Snapshot, name: str, uses: Uses) -> DataFrame:
    """(table, column, value, rows) of values in use that the vocabulary lacks; nulls are none."""
    have, out = values(s, name), s.database.spark.createDataFrame([], "table string, column string, value string, rows long")
    for table, column in uses:
        odd = s[table].where(F.col(column).isNotNull() & ~F.col(column).isin(*have)) if have else s[table].where(F.col(column).isNotNull())
        out = out.unionByName(odd.groupBy(F.lit(table).alias("table"), F.lit(column).alias("column"), F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows")))
    return out
