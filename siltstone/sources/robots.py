"""Which paths a site's robots.txt lets a product read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules(files: DataFrame, product: str, host: str = "host", text: str = "text") -> DataFrame:
    """(host, allow, pattern, length) of the group for ``product``, or else of the group for all.

    A group is the agents that follow each other and the lines up to the next
    agent; groups of one agent are one.
    """
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = files.select(F.col(host).alias("host"), F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))
    kind, value = F.lower(F.trim(F.regexp_extract(line, r"^([A-Za-z-]+)\s*:", 1))), F.trim(F.regexp_extract(line, r"^[A-Za-z-]+\s*:(.*)$", 1))
    rows = parts.select("host", "n", kind.alias("kind"), value.alias("value")).where(F.col("kind").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy("host").orderBy("n")
    rows = rows.withColumn("starts", (F.col("kind") == "user-agent") & (F.coalesce(F.lag("kind").over(w), F.lit("")) != "user-agent"))
    rows = rows.withColumn("block", F.sum(F.col("starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    agents = rows.where(F.col("kind") == "user-agent").select("host", "block", F.lower("value").alias("agent")).where(F.col("agent").isin(product.lower(), "*"))
    best = agents.groupBy("host").agg(F.max((F.col("agent") == product.lower()).cast("int")).alias("own"))
    ours = agents.join(best, "host").where((F.col("agent") != "*") == (F.col("own") == 1)).select("host", "block").distinct()
    lines = rows.where((F.col("kind") != "user-agent") & (F.col("value") != "")).join(ours, ["host", "block"], "left_semi")
    return lines.select("host", (F.col("kind") == "allow").alias("allow"), pattern(F.col("value")).alias("pattern"), F.octet_length("value").alias("length"))


def pattern(rule: Column) -> Column:
    """A rule's path as a regular expression: ``*`` is anything, a last ``$`` the end."""
    end = rule.endswith("$")
    body = F.when(end, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    escaped = F.regexp_replace(body, r"([.?+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(escaped, r"\*+", ".*"), F.when(end, "$").otherwise(""))


def allowed(paths: DataFrame, known: DataFrame) -> DataFrame:
    """``paths`` (host, path, ...) with allowed: the longest fitting rule decides, allow wins ties, none allows."""
    hits = paths.select("host", "path").distinct().join(known, "host").where(F.rlike("path", F.col("pattern")))
    verdict = hits.groupBy("host", "path").agg(F.max_by("allow", F.struct("length", "allow")).alias("_a"))
    return paths.join(verdict, ["host", "path"], "left").withColumn("allowed", F.coalesce("_a", F.lit(True))).drop("_a")
