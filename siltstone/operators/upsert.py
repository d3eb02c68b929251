"""Set-based upserts: a full outer join on the keys and one rule for each column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]


def take_new(old: Column, new: Column) -> Column:
    return new


def keep_old(old: Column, new: Column) -> Column:
    return old


def coalesce_new(old: Column, new: Column) -> Column:
    """A null never overwrites."""
    return F.coalesce(new, old)


def either(old: Column, new: Column) -> Column:
    """Once true, always true."""
    return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))


def reset(old: Column, new: Column) -> Column:
    return F.lit(None)


def known(unknown: str) -> Rule:
    """A new value unless it is null or says that it is unknown."""
    return lambda old, new: F.coalesce(F.nullif(new, F.lit(unknown)), old)


def sticky(value: str) -> Rule:
    """``value`` is never replaced by another."""
    return lambda old, new: F.when((old == value) & ~new.eqNullSafe(F.lit(value)), old).otherwise(new)


def toggle(old: Column, new: Column) -> Column:
    return ~old


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Rule] | None = None, default: Rule = take_new) -> DataFrame:
    """``old`` with the rows of ``new`` merged in; the columns are those of ``old``.

    Keys are unique on either side.  A row on one side only is kept as it is.
    """
    rules = rules or {}
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o_here"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns if c in new.columns], F.lit(True).alias("n_here"))
    both = o.join(n, all_of([F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]), "full")
    out = []
    for c in old.columns:
        a = F.col(f"o_{c}")
        b = F.col(f"n_{c}") if c in new.columns else F.lit(None)
        value = F.coalesce(a, b) if c in keys else F.when(F.col("o_here").isNull(), b).when(F.col("n_here").isNull(), a).otherwise(rules.get(c, default)(a, b))
        out.append(value.cast(old.schema[c].dataType).alias(c))
    return both.select(*out)


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the last in ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def numbered(df: DataFrame, key: str, name: str, parts: int | None = None) -> DataFrame:
    """Dense numbers from 1 in the order of a numeric key without nulls.

    Rows are dealt to ranges between approximate quantiles (at most ``parts``
    limits reach the driver), numbered there, and chained by the ranges' counts.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limits = sorted(set(df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5])).first()[0] or []))
    steps = [1 << i for i in reversed(range(len(limits).bit_length()))]
    have = F.array(*map(F.lit, limits))
    part = F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(have, at + s - 1) <= F.col(key), at + s).otherwise(at)) if limits else F.lit(0)
    dealt = df.withColumn("_part", part)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = dealt.withColumn("_in", F.row_number().over(W.partitionBy("_part").orderBy(key)))
    return inner.join(before, "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_before", "_in")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], id_col: str, order: str) -> DataFrame:
    """Rows of ``new`` without a twin in ``old``, with ids after the largest in the order of a numeric key."""
    fresh = new.join(old.select(*keys), keys, "left_anti")
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))  # one row
    return numbered(fresh, order, "_n").crossJoin(F.broadcast(top)).withColumn(id_col, (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top")


def close_missing(stored: DataFrame, seen: DataFrame, keys: list[str], closed_col: str, now: Column, scope: Column | None = None) -> DataFrame:
    """Open rows within ``scope`` that ``seen`` does not list are closed at ``now``; an empty list closes all."""
    mark = seen.select(*[F.col(k).alias(f"s_{k}") for k in keys]).distinct().withColumn("_seen", F.lit(True))
    joined = stored.join(mark, all_of([F.col(k) == F.col(f"s_{k}") for k in keys]), "left")
    gone = F.col(closed_col).isNull() & F.col("_seen").isNull()
    gone = gone if scope is None else gone & scope
    return joined.withColumn(closed_col, F.when(gone, now).otherwise(F.col(closed_col))).select(*stored.columns)


def desired_state(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """What brings ``current`` to ``desired``: keys with action add or remove."""
    add = desired.select(*keys).join(current.select(*keys), keys, "left_anti").withColumn("action", F.lit("add"))
    remove = current.select(*keys).join(desired.select(*keys), keys, "left_anti").withColumn("action", F.lit("remove"))
    return add.unionByName(remove)


def priority_merge(fields: list[str], priority: tuple[str, ...], source: Column, fill_only: tuple[str, ...] = ()) -> list[Column]:
    """Columns <f> and owner_<f> from s_<f> (stored), owner_<f> and i_<f> (incoming).

    An incoming null is unknown.  A value is written where the stored one is
    null or unowned, the source owns it, or it ranks strictly higher; fields in
    ``fill_only`` are never changed once set.
    """
    rank = lambda c: F.coalesce(F.lit(len(priority) + 1) - F.nullif(F.array_position(F.array(*map(F.lit, priority)), c), F.lit(0)), F.lit(0))
    out = []
    for f in fields:
        s, i, o = F.col(f"s_{f}"), F.col(f"i_{f}"), F.col(f"owner_{f}")
        may = s.isNull() | o.isNull() | (o == source) | (rank(source) > rank(o))
        if f in fill_only:
            may = s.isNull()
        wins = i.isNotNull() & may
        out += [F.when(wins, i).otherwise(s).alias(f), F.when(wins, source).otherwise(o).alias(f"owner_{f}")]
    return out
