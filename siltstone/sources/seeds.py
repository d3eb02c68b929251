"""Hand-kept seed lists in YAML, and the verdict on a seed's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as X


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(name, domain, sector, group) of a file of groups: ``{group: {label, companies: [...]}}``.

    An entry is a name or a mapping; its sector is its own, else the group's
    label, else the group's key in title case.
    """
    import yaml

    with open(path, encoding="utf-8") as f:
        groups = yaml.safe_load(f) or {}
    rows = []
    for key, group in groups.items():
        for entry in group.get("companies", []):
            entry = entry if isinstance(entry, dict) else {"name": entry}
            rows.append((entry["name"], entry.get("website"), entry.get("sector") or group.get("label") or key.replace("_", " ").title(), key))
    seeds = spark.createDataFrame(rows, "name string, website string, sector string, group string")
    return seeds.withColumn("domain", X.normalize_domain(F.col("website"), international=True)).withColumn("external_id", X.slugify(F.col("name")))


def verdict(code: Column) -> Column:
    """dead for gone pages and for no answer (null); otherwise nothing is known."""
    return F.when(code.isNull() | code.isin(404, 410), "dead")
