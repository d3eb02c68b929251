"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Every step is a DataFrame expression.  A URL becomes the set of expressions
``host suffix + path prefix`` that could be a rule; each is known by its SHA-256
digest.  Rules and expressions meet on the first 32 bits of the digest (an
equi-join) and the whole digest decides.  Of the rules that fit, the longest
wins.

Defined results: a null URL, or one without ``://``, has an empty host and path
and gets the default verdict.  Equal URLs get equal verdicts, once per row.  A
rule listed twice with both verdicts blocks.  Rules with a null field are
ignored.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The last labels of the host, as many as each number in ``counts`` that it has."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    wanted = F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= labels) if counts else F.expr("cast(array() as array<int>)")
    return F.transform(wanted, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


#: Rules up to which their table is broadcast.
MOST_SENT = 50_000


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judges each row of ``pages`` by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains, if the URL's path starts with the
    rule's path.  Only prefixes as long as some rule's path and suffixes with as
    many labels as some rule's host are made, so every expression that matters is
    made, whether or not it ends at a slash, and a URL of any length makes no
    more; the lists of those numbers are no longer than the longest rule.
    Returns id, host, path, rule, verdict.
    """
    known = (
        rules.select(F.translate("host", UPPER, LOWER).alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"))
        .where(F.col("_rh").isNotNull() & F.col("_rp").isNotNull() & F.col("_rv").isNotNull())
        .withColumn("_rule", F.concat("_rh", "_rp"))
        .withColumn("_rd", F.sha2("_rule", 256))
        .withColumn("_r8", short("_rd"))
    )
    labels = F.length("_rh") - F.length(F.replace("_rh", F.lit("."), F.lit(""))) + 1
    lengths, counts, many = known.agg(F.collect_set(F.length("_rp")), F.collect_set(labels), F.count(F.lit(1))).first()
    if many <= MOST_SENT:
        known = F.broadcast(known)
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).withColumn("_host", url_host(F.col("_url"))).withColumn("_path", url_path(F.col("_url")))
    wanted = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("_path")) if lengths else F.expr("cast(array() as array<int>)")
    # equal URLs have equal verdicts: terms carry 128 bits of the URL's digest
    row = F.substring(F.sha2("_url", 256), 1, 32)
    terms = (
        judged.where(F.col("_host") != "")
        .select(row.alias("_row"), "_path", F.explode(host_suffixes(F.col("_host"), sorted(counts))).alias("_suffix"))
        .select("_row", "_suffix", F.explode(F.transform(wanted, lambda n: F.col("_path").substr(F.lit(1), n))).alias("_prefix"))
        .select("_row", F.sha2(F.concat("_suffix", "_prefix"), 256).alias("_d"))
        .withColumn("_d8", short("_d"))
    )
    # the short prefixes meet; then whole digests are compared
    hits = terms.join(known, F.col("_d8") == F.col("_r8"), "inner").where(agree("_d", "_rd"))
    rank = F.struct(F.length("_rule").alias("a"), F.length("_rh").alias("b"), F.col("_rule").alias("rule"), F.col("_rv").alias("verdict"))
    best = hits.groupBy(F.col("_row").alias("_u")).agg(F.max(rank).alias("_best"))
    return judged.join(best, row == F.col("_u"), "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best.rule").alias("rule"), F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict")
    )


def short(digest: str) -> Column:
    """The first 32 bits of a digest, as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def agree(a: str, b: str) -> Column:
    """Whole digests, all of one length, are equal; said so that this is no key of the join."""
    return F.startswith(F.col(a), F.col(b))
