"""Which stored entity a record means: by external id, then domain, then name within a metro; and which it may mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.similar import similar_pairs


def only(df: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    """The id for each key that exactly one entity has."""
    found = df.dropna(subset=keys).groupBy(*keys).agg(F.count_distinct(id_col).alias("_c"), F.min(id_col).alias(name))
    return found.where(F.col("_c") == 1).drop("_c")


def lowest(df: DataFrame, keys: list[str], id_col: str, name: str) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(F.min(id_col).alias(name))


def resolve(records: DataFrame, stored: DataFrame, *, id_col: str = "id") -> DataFrame:
    """``records`` (external_id, domain, normalized_name, metro) with entity_id and matched_by.

    An external id counts only if one entity has it.  A record whose domain
    matches nothing still goes on to its name; a name needs a metro.
    """
    steps = [("external_id", ["external_id"], only), ("domain", ["domain"], lowest), ("name", ["normalized_name", "metro"], lowest)]
    out = records
    for name, keys, how in steps:
        found = how(stored, keys, id_col, f"_by_{name}").select(*[F.col(k).alias(f"_k_{k}") for k in keys], f"_by_{name}")
        cond = F.lit(True)
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_k_{k}"))
        out = out.join(found, cond, "left").drop(*[f"_k_{k}" for k in keys])
    by = F.when(F.col("_by_external_id").isNotNull(), "external_id").when(F.col("_by_domain").isNotNull(), "domain").when(F.col("_by_name").isNotNull(), "name")
    return out.withColumn("matched_by", by).withColumn("entity_id", F.coalesce("_by_external_id", "_by_domain", "_by_name")).select(*records.columns, "entity_id", "matched_by")


def collapse_new(unmatched: DataFrame, order: list[str]) -> DataFrame:
    """Of records that match nothing stored, the first by arrival for each key: domain, else name and metro."""
    key = F.coalesce(F.concat(F.lit("d:"), F.col("domain")), F.concat_ws("|", F.lit("n:"), "normalized_name", "metro"))
    return unmatched.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*unmatched.columns), F.struct(*order)).alias("_r")).select("_r.*")


#: A name more similar than this to a stored one is a candidate for review, never a match.
SIMILAR = 0.85


def candidates(unmatched: DataFrame, stored: DataFrame, record_col: str, *, id_col: str = "id", threshold: float = SIMILAR) -> DataFrame:
    """(record, entity_id, similarity) of records that match nothing and stored entities of their metro with similar names.

    Both need a name and a metro; equal names are matches and no candidates.
    """
    name = lambda df, kind, key: df.dropna(subset=["normalized_name", "metro"]).where("normalized_name <> ''").select(F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key")).alias("of"), "normalized_name", "metro")
    both = name(stored, 0, id_col).unionByName(name(unmatched, 1, record_col))
    pairs = similar_pairs(both, "of", "normalized_name", ["metro"], threshold)
    # stored entities are the smaller kind
    found = pairs.where((F.col("a.kind") == 0) & (F.col("b.kind") == 1))
    return found.select(F.col("b.key").alias(record_col), F.col("a.key").alias("entity_id"), "similarity")
