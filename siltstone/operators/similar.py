"""Trigram similarity, and pairs of similar texts by an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.store import cut

#: Ids of one text that travel together, and rows of the input for each task that pairs are dealt to.
IDS_TOGETHER, ROWS_A_TASK = 1000, 2000


def trigrams(text: Column) -> Column:
    """The set of 3-character pieces of the words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams, in single precision as thresholds are; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_intersect(x, y))
    return F.coalesce((both / F.nullif(F.size(F.array_union(x, y)), F.lit(0))).cast("float"), F.lit(0.0).cast("float"))


def similar_pairs(df: DataFrame, id_col: str, text_col: str, scope: list[str], threshold: float) -> DataFrame:
    """Pairs (a, b, similarity), a < b, of different texts within a scope, above ``threshold``.

    Each text is indexed by its rarest trigrams only: two sets whose overlap is
    over t of their union share one of the first n - ceil(t n) + 1 trigrams of
    each in any common order, here by frequency.  Texts are joined on (scope,
    trigram) and verified once.  Ids of equal texts are paired in parts of about
    ``IDS_TOGETHER``, dealt to as many tasks as the input has rows for.
    """
    base = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *scope).where(F.col("_t").isNotNull())
    # equal texts of a scope are one text
    counted = cut(base.groupBy("_t", *scope).agg(F.count(F.lit(1)).alias("_c")))
    texts = counted.select("_t", *scope).withColumn("_g", trigrams(F.col("_t")))
    grams = texts.select("_t", *scope, F.size("_g").alias("_n"), F.explode("_g").alias("_gram"))
    often = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_f"))
    ordered = grams.join(often, "_gram").groupBy("_t", "_n", *scope).agg(F.array_sort(F.collect_list(F.struct("_f", "_gram"))).alias("_o"))
    keep = (F.col("_n") - F.ceil(F.col("_n") * threshold) + 1).cast("int")
    index = ordered.select("_t", *scope, F.col("_n"), F.explode(F.slice("_o", F.lit(1), keep)).alias("_p")).select("_t", "_n", *scope, F.col("_p._gram").alias("_gram"))
    other = index.select(F.col("_t").alias("_u"), F.col("_n").alias("_m"), "_gram", *scope)
    near = index.join(other, ["_gram", *scope]).where((F.col("_t") < F.col("_u")) & (F.col("_n") >= F.col("_m") * threshold) & (F.col("_m") >= F.col("_n") * threshold))
    near = near.select("_t", "_u", *scope).distinct().withColumn("similarity", similarity(F.col("_t"), F.col("_u"))).where(F.col("similarity") > F.lit(threshold).cast("float"))
    many = counted.where(F.col("_c") > IDS_TOGETHER)
    part = F.coalesce(F.pmod(F.xxhash64("_id"), F.ceil(F.col("_c") / IDS_TOGETHER)), F.lit(0))
    ids = base.join(many, ["_t", *scope], "left").groupBy("_t", *scope, part.alias("_k")).agg(F.collect_list("_id").alias("_ids"))
    left = ids.withColumnsRenamed({"_ids": "_left", "_k": "_i"})
    right = ids.withColumnsRenamed({"_t": "_u", "_ids": "_right", "_k": "_j"})
    tasks = 1 + (counted.agg(F.sum("_c")).first()[0] or 0) // ROWS_A_TASK
    # a number of its own, since a few small rows make many pairs
    dealt = near.join(left, ["_t", *scope]).join(right, ["_u", *scope]).repartition(min(tasks, 10_000), "_t", "_u", *scope, "_i", "_j")
    pairs = dealt.select(*scope, F.explode("_left").alias("_a"), "_right", "similarity").select(*scope, "_a", F.explode("_right").alias("_b"), "similarity")
    return pairs.select(*scope, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "similarity")
