"""A batch of one source's records merged into the stored entities: resolve, insert, merge, links, pairs for review."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.resolve import candidates, resolve
from siltstone.operators.upsert import all_of, insert_missing, priority_merge, upsert
from siltstone.store import cut

IDENTITY = ("domain", "normalized_name", "metro")


class Merged(NamedTuple):
    """The tables after the batch; ``of_record`` (record, entity_id, created) leaves out skipped records."""

    entities: DataFrame
    links: DataFrame
    pairs: DataFrame
    of_record: DataFrame


def _known_by(entities: DataFrame, links: DataFrame, source: str) -> DataFrame:
    mine = links.where(F.col("connector") == source).select(F.col("company_id").alias("id"), "external_id")
    return entities.select("id", *IDENTITY).join(mine, "id", "left")


def _first(records: DataFrame, order: str, key: Column) -> DataFrame:
    """The first record by arrival of each key; without a key each stands for itself."""
    own = F.when(key.isNull(), F.col(order))
    return records.groupBy(key.alias("_key"), own.alias("_own")).agg(F.min_by(F.struct(*records.columns), order).alias("_r")).select("_r.*")


def _inserted(entities: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """New entities with their ids, and the record that each came from."""
    return insert_missing(entities.select("id", F.lit(None).cast("long").alias(order)), fresh, [order], "id", order).select("id", *IDENTITY, order, "external_id")


def _grown(entities: DataFrame, new: DataFrame) -> DataFrame:
    return entities.unionByName(new.select("id", *IDENTITY), allowMissingColumns=True)


def _linked(new: DataFrame, source: str) -> DataFrame:
    return new.where(F.col("external_id").isNotNull()).select(F.col("id").alias("company_id"), F.lit(source).alias("connector"), "external_id")


def merge_records(records: DataFrame, entities: DataFrame, links: DataFrame, fields: list[str], *, source: str, now: Column, priority: tuple[str, ...], order: str = "rid") -> Merged:
    """``records`` (``order``, external_id, domain, normalized_name, metro, enrich_only, fields) merged into ``entities``.

    Entities have id, domain, normalized_name, metro and, for each field, its
    value and owner_<field>; links are (company_id, connector, external_id,
    last_seen_at).  ``order`` is a record's number by arrival, without ties.

    * A record that may only enrich and matches nothing is skipped.
    * Of new records with one external id the first counts.  Of those, the first
      for each domain is inserted, and of what still matches nothing the first for
      each name and metro.  New records of different domains stay apart.  All
      others of the batch update what was inserted.
    * Of several records for one entity the last known value of a field counts;
      it is written as ``priority_merge`` decides.
    * An entity without a domain takes the first one of its records, unless another
      entity has it: then both are a pair for review (similarity 1).
    * New entities make pairs with stored ones of their metro with similar names.
    """
    only_new = lambda df: df.where(F.col("entity_id").isNull() & ~F.coalesce("enrich_only", F.lit(False))).select(*records.columns)
    key = lambda *cols: F.when(all_of([F.col(c).isNotNull() for c in cols]), F.to_json(F.struct(*cols)))

    fresh = cut(_first(only_new(resolve(records, _known_by(entities, links, source))), order, F.col("external_id")))
    by_domain = cut(_inserted(entities, _first(fresh.where(F.col("domain").isNotNull()), order, key("domain")), order))
    more = _grown(entities, by_domain)
    rest = cut(only_new(resolve(fresh.where(F.col("domain").isNull()), _known_by(more, links, source))))
    by_name = cut(_inserted(more, _first(rest, order, key("normalized_name", "metro")), order))
    everyone = _grown(more, by_name)
    created = by_domain.unionByName(by_name)

    # every record again, now that the new entities and their links are there
    have = links.select("company_id", "connector", "external_id").unionByName(_linked(created, source))
    own = created.select(F.col("id").alias("_own"), F.col(order).alias("_from"))
    placed = resolve(records, _known_by(everyone, have, source)).join(own, F.col(order) == F.col("_from"), "left")
    placed = cut(placed.withColumn("entity_id", F.coalesce("entity_id", "_own")).drop("_own", "_from").where(F.col("entity_id").isNotNull()))

    last = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f"i_{f}") for f in fields]
    wanted = F.min_by("domain", F.when(F.col("domain").isNotNull(), F.col(order))).alias("_domain")
    folded = placed.groupBy(F.col("entity_id").alias("_id")).agg(*last, wanted, F.min(order).alias("_order"))

    # who has a domain: its entity, else the first that asks for it
    has = everyone.where(F.col("domain").isNotNull()).groupBy(F.col("domain").alias("_d")).agg(F.min("id").alias("_has"))
    asks = folded.join(everyone.select(F.col("id").alias("_id"), "domain"), "_id").where(F.col("domain").isNull() & F.col("_domain").isNotNull())
    taken = asks.groupBy(F.col("_domain").alias("_d2")).agg(F.min_by("_id", "_order").alias("_takes"))
    owner = folded.join(has, F.col("_domain") == F.col("_d"), "left").join(taken, F.col("_domain") == F.col("_d2"), "left").withColumn("_owner", F.coalesce("_has", "_takes"))

    stored = everyone.select("id", *IDENTITY, *[F.col(f).alias(f"s_{f}") for f in fields], *[f"owner_{f}" for f in fields])
    both = stored.join(owner, F.col("id") == F.col("_id"), "left")
    domain = F.coalesce("domain", F.when(F.col("_owner") == F.col("id"), F.col("_domain")))
    merged = both.select("id", domain.alias("domain"), "normalized_name", "metro", *priority_merge(fields, priority, F.lit(source), ())).select(*entities.columns)

    conflict = owner.where(F.col("_owner") != F.col("_id")).select(F.least("_id", "_owner").alias("a"), F.greatest("_id", "_owner").alias("b"), F.lit(1.0).alias("similarity"))
    near = candidates(created.select(F.col("id").alias("new_id"), "normalized_name", "metro"), entities, "new_id")
    near = near.select(F.least("new_id", "entity_id").alias("a"), F.greatest("new_id", "entity_id").alias("b"), F.col("similarity").cast("double").alias("similarity"))
    pairs = conflict.unionByName(near).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))

    seen = placed.where(F.col("external_id").isNotNull()).select(F.col("entity_id").alias("company_id"), F.lit(source).alias("connector"), "external_id", now.alias("last_seen_at")).distinct()
    new = created.select(F.col("id").alias("entity_id"), F.lit(True).alias("created"))
    of_record = placed.select(order, "entity_id").join(new, "entity_id", "left").select(order, "entity_id", F.coalesce("created", F.lit(False)).alias("created"))
    return Merged(merged, upsert(links, seen, ["company_id", "connector", "external_id"]), pairs, of_record)
