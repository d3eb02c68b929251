"""Order MinHash fingerprints, as DataFrame expressions only.

A text's words are cut into k-mers of five words (five characters where there are
fewer words than that, or hardly any blanks); a k-mer that occurs again in the text
is numbered, so repetitions count.  Hashes fall into 64 bins by their
leading bits, and each bin keeps its two smallest.  The two stand in the order
of the text and are hashed together, so a fingerprint depends on which k-mers a
text has, how often, and in what order: texts with a small edit distance agree
in most bins.

Documents are chained to the next id by buckets of ids between approximate
quantiles; only the first document of each bucket is looked up elsewhere.

Defined results: a null text is empty; a text of fewer than five characters is one
k-mer; texts without words have an empty fingerprint and are fully alike; null
ids come last; rows with equal ids follow each other by their texts; a single
document is its own next one; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import buckets

K = 5
LONG = 40  # characters for each word from which characters are counted instead
PLACE_BITS = 26  # of a word's position; hashes have the rest
BIN_BITS = 6
_PLACE = (1 << PLACE_BITS) - 1
_HASH = ~_PLACE
_BLANK = r"\x20\x09-\x0D"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(text: str) -> str:
    trimmed = rf"regexp_replace({text}, r'^[{_BLANK}]+', '')"
    return _let("tx", trimmed, rf"if(tx = '', cast(array() as array<string>), split(tx, r'[{_BLANK}]+'))")


def signature(text: str) -> Column:
    """The bins' tuple hashes of a string expression, by bin: (bin << 26 | hash), at most 64."""
    # a blank end leaves an empty last word
    words = _let("ws", _words(text), "if(size(ws) > 0 and ws[size(ws) - 1] = '', slice(ws, 1, size(ws) - 1), ws)")
    units = f"if(size(w) >= {K} and length({text}) <= {LONG} * size(w), w, split(array_join(w, ' '), ''))"
    kmers = _let("e", "transform(u, x -> xxhash64(x))", f"transform(sequence(0, size(e) - {K}), i -> xxhash64({', '.join(f'e[i + {j}]' for j in range(K))}))")
    hashes = f"if(size(w) = 0, cast(array() as array<bigint>), if(size(u) < {K}, array(xxhash64(u)), {kmers}))"
    plain = f"transform(h, (x, i) -> (x & {_HASH}L) | (i & {_PLACE}L))"
    # sorted by hash and place: an occurrence's number is its distance from the run's start
    high = lambda x: f"shiftrightunsigned({x}, {PLACE_BITS})"
    begins = f"filter(sequence(0, size(t) - 1), i -> i = 0 or {high('t[i]')} != {high('t[i - 1]')})"
    number = "flatten(transform(b, (x, j) -> sequence(0, coalesce(get(b, j + 1), size(t)) - x - 1)))"
    mixed = f"transform(t, (x, i) -> if(n[i] = 0, x, (xxhash64({high('x')}, n[i]) & {_HASH}L) | (x & {_PLACE}L)))"
    numbered = _let("t", f"sort_array({plain})", _let("b", begins, _let("n", number, mixed)))
    each = f"if(size(array_distinct(h)) = size(h), {plain}, {numbered})"
    bin_of = lambda x: f"shiftrightunsigned({x}, {64 - BIN_BITS})"
    least = f"filter(s, (x, i) -> i < 2 or {bin_of('get(s, i - 2)')} != {bin_of('x')})"
    # a bin's second member adds nothing of its own; its first one holds the pair in the order of the text
    after = "get(p, i + 1)"
    pair = f"if({after} is null or {bin_of(after)} != {bin_of('x')}, xxhash64({high('x')}), if((x & {_PLACE}L) < ({after} & {_PLACE}L), xxhash64({high('x')}, {high(after)}), xxhash64({high(after)}, {high('x')})))"
    entry = f"if(i > 0 and {bin_of('get(p, i - 1)')} = {bin_of('x')}, null, shiftleft({bin_of('x')}, {PLACE_BITS}) | ({pair} & {_PLACE}L))"
    tuples = f"filter(transform(p, (x, i) -> {entry}), y -> y is not null)"
    return F.expr(_let("w", words, _let("u", units, _let("h", hashes, _let("s", f"sort_array({each})", _let("p", least, tuples))))))


def likeness(a: str, b: str) -> Column:
    """Equal tuples over the bins that either has; 1 if neither has any."""
    bins = lambda x: f"transform({x}, y -> shiftrightunsigned(y, {PLACE_BITS}))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, size(array_intersect({a}, {b})) / cast(size(array_union({bins(a)}, {bins(b)})) as double))")


def as_string(sig: str) -> Column:
    return F.expr(f"array_join(transform({sig}, y -> lower(lpad(hex(y), 8, '0'))), '')")


def id_buckets(docs: DataFrame, n: int) -> Column:
    """The bucket of ``doc_id`` between approximate quantiles; at most n - 1 limits reach the driver."""
    got = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0]
    limits = sorted(set(got or []))
    steps = [1 << i for i in reversed(range(len(limits).bit_length()))]
    if not limits:
        return F.lit(0)
    have = F.array(*[F.lit(x).cast("long") for x in limits])
    own = F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, s: F.when(F.get(have, at + s - 1) <= own, at + s).otherwise(at))


def fingerprint_documents(docs: DataFrame, *, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compares each text with the next document's, and with itself after an edit.

    The edit replaces the last 1/``share`` of the code points by the first as
    many of the next document.  Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # several for each partition: hashed buckets then fill partitions alike
    d = d.withColumn("bucket", id_buckets(d, 4 * buckets(d.sparkSession)))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    signed = d.withColumn("sig", signature("text"))
    follow = W.partitionBy("bucket").orderBy(*order)
    rows = signed.withColumn("after", F.lead(F.struct("text", "sig")).over(follow)).withColumn("last", F.col("after").isNull())
    # the first document of each bucket: at most as many rows as buckets
    least = d.groupBy(F.col("bucket").alias("b")).agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("least"))
    heads = d.join(F.broadcast(least), (F.col("bucket") == F.col("b")) & (F.coalesce("doc_id", F.lit((1 << 63) - 1)) == F.col("least")), "inner")
    heads = heads.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).withColumn("sig", signature("text"))
    chain = W.orderBy("bucket")
    whole = chain.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select(F.col("bucket").alias("b"), F.coalesce(F.lead(F.struct("text", "sig")).over(chain), F.first(F.struct("text", "sig")).over(whole)).alias("head"))
    rows = rows.join(heads, F.col("bucket") == F.col("b"), "left").withColumn("next", F.when(F.col("last"), F.col("head")).otherwise(F.col("after")))
    n = F.length("text")
    many = F.floor(n / share).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - many), F.col("next.text").substr(F.lit(1), many)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sig", F.col("next.sig").alias("next_sig"))
    rows = rows.withColumn("edited_sig", signature("edited"))
    return rows.coalesce(4 * d.sparkSession.sparkContext.defaultParallelism).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("sig").alias("fingerprint"),
        as_string("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
