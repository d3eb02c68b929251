"""Connected components of a link table: forests within partitions, then stars across them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import checkpointed, compact

#: Rows of one key that a join deals to one task.
HUB = 10_000
#: Keys with more rows up to which their table is broadcast.
MOST_SENT = 200_000


def hubs(rows: DataFrame, *keys: str) -> DataFrame | None:
    """(hub, ways): the values of ``keys`` with more than ``HUB`` rows in all, and how many parts these go to."""
    if rows.count() <= HUB:
        return None
    ends = rows.select(F.explode(F.array(*keys)).alias("hub"))
    many = checkpointed(ends.groupBy("hub").count().where(F.col("count") > HUB).select("hub", F.ceil(F.col("count") / HUB).cast("int").alias("ways")))
    found = many.count()
    return None if not found else F.broadcast(many) if found <= MOST_SENT else many


def looked_up(rows: DataFrame, key: str, spread: str, table: DataFrame, many: DataFrame | None) -> DataFrame:
    """``rows`` with the row of ``table`` (one for each value in its column n) of their key; a hub's rows go to parts by ``spread``."""
    if many is None:
        return rows.join(table, F.col(key) == F.col("n"), "inner").drop("n")
    ways = F.coalesce("ways", F.lit(1))
    dealt = rows.join(many, F.col(key) == F.col("hub"), "left").withColumn("part", F.pmod(F.xxhash64(spread), ways).cast("int")).drop("hub", "ways")
    parts = table.join(many, F.col("n") == F.col("hub"), "left").withColumn("its", F.explode(F.sequence(F.lit(0), ways - 1))).drop("hub", "ways")
    return dealt.join(parts, (F.col(key) == F.col("n")) & (F.col("part") == F.col("its")), "inner").drop("n", "part", "its")


def local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a partition's links (a, b) linked to the smallest it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    pairs = [(n, find(n)) for n in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def stars(e: DataFrame, large: bool) -> DataFrame:
    """Links of nodes to the smallest node near them: of larger neighbours (large) or of smaller ones.

    A node can have most nodes as larger neighbours, but has no more smaller ones than there were forests.
    """
    ways = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = ways.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    out = looked_up(ways, "a", "b", low, hubs(e, "a", "b") if large else None)
    if large:
        out = out.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def forests(links: DataFrame) -> DataFrame:
    """Links (a, b), b < a, that connect what ``links`` connects: a forest for each partition."""
    return links.select("a", "b").where(F.col("a") != F.col("b")).mapInArrow(local_forest, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the component's smallest node.

    A partition's links become a forest of no more links than nodes.  Rounds of
    large and small stars then join the forests; their number grows with the
    logarithm of what is left of a component's length.  They end when every node
    has one root that has none itself; only the count of others reaches the driver.
    """
    e = checkpointed(compact(forests(links)))
    while True:
        e = checkpointed(compact(stars(stars(e, True), False)))
        ends = e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if not seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).count():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
