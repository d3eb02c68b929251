"""Upserts, folds and entity resolution.

Two date slices of orders are the stored and the new snapshot: the old one ends
in 1997, the new one begins in 1996, so both have the orders between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import fold as G
from siltstone.operators import record as M
from siltstone.operators import resolve as R
from siltstone.operators import upsert as U
from siltstone.plans import Tables, query
from siltstone.schemas import SOURCE_PRIORITY

OLD = "o AS (SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount, o_orderstatus = 'F' AS hq, o_orderpriority AS kind FROM orders WHERE o_orderdate < DATE '1997-01-01')"
NEW = "n AS (SELECT o_orderkey AS id, o_custkey AS cust, CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice + 1 END AS amount, o_orderkey % 5 = 0 AS hq, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'new ' || o_orderpriority END AS kind FROM orders WHERE o_orderdate >= DATE '1996-01-01')"
MERGED = f"WITH {OLD}, {NEW} SELECT coalesce(o.id, n.id) AS id, "
FROM = " FROM o FULL JOIN n ON o.id = n.id"
day = lambda s: F.lit(s).cast("timestamp_ntz")


def old(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") < day("1997-01-01")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("amount"), (F.col("o_orderstatus") == "F").alias("hq"), F.col("o_orderpriority").alias("kind")
    )


def new(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.where(F.col("o_orderdate") >= day("1996-01-01")).select(
        k.alias("id"), F.col("o_custkey").alias("cust"), F.when(k % 2 != 0, F.col("o_totalprice") + 1).alias("amount"), (k % 5 == 0).alias("hq"), F.when(k % 4 == 0, "unknown").otherwise(F.concat(F.lit("new "), "o_orderpriority")).alias("kind")
    )


@query(MERGED + "CASE WHEN n.id IS NULL THEN o.amount WHEN o.id IS NULL THEN n.amount ELSE coalesce(n.amount, o.amount) END AS amount" + FROM)
def upsert_coalesce(t: Tables) -> DataFrame:
    return U.upsert(old(t).select("id", "amount"), new(t), ["id"], {"amount": U.coalesce_new})


@query(MERGED + "coalesce(o.hq, false) OR coalesce(n.hq, false) AS hq" + FROM)
def upsert_bool_or(t: Tables) -> DataFrame:
    return U.upsert(old(t).select("id", "hq"), new(t), ["id"], {"hq": U.either})


@query(MERGED + "CASE WHEN o.id IS NULL THEN n.kind WHEN n.id IS NULL THEN o.kind ELSE coalesce(nullif(n.kind, 'unknown'), o.kind) END AS kind" + FROM)
def upsert_keep_known(t: Tables) -> DataFrame:
    return U.upsert(old(t).select("id", "kind"), new(t), ["id"], {"kind": U.known("unknown")})


@query(MERGED + "CASE WHEN o.id IS NULL THEN n.kind WHEN n.id IS NULL THEN o.kind WHEN o.kind = '1-URGENT' AND n.kind <> '1-URGENT' THEN o.kind ELSE n.kind END AS kind" + FROM)
def upsert_guarded(t: Tables) -> DataFrame:
    return U.upsert(old(t).select("id", "kind"), new(t), ["id"], {"kind": U.sticky("1-URGENT")})


@query(MERGED + "CASE WHEN n.id IS NULL THEN o.amount ELSE n.amount END AS amount, coalesce(n.kind, o.kind) AS kind" + FROM)
def upsert_overwrite(t: Tables) -> DataFrame:
    return U.upsert(old(t).select("id", "amount", "kind"), new(t), ["id"])


@query(MERGED + "CASE WHEN o.id IS NULL THEN true WHEN n.id IS NULL THEN o.hq ELSE NOT o.hq END AS starred" + FROM)
def upsert_toggle(t: Tables) -> DataFrame:
    marks = old(t).select("id", F.col("hq").alias("starred"))
    return U.upsert(marks, new(t).select("id", F.lit(True).alias("starred")), ["id"], {"starred": U.toggle})


@query("WITH p AS (SELECT lower(p_type) AS k, min(p_partkey) AS id FROM part GROUP BY 1), n AS (SELECT lower(p_type) AS k, max(p_retailprice) AS price FROM part WHERE p_size > 25 GROUP BY 1) SELECT p.id, CASE WHEN n.k IS NOT NULL THEN round(n.price, 4) END AS price FROM p LEFT JOIN n ON p.k = n.k")
def upsert_ci(t: Tables) -> DataFrame:
    """Matched without case, lowest id; only non-null fields update."""
    low = F.lower("p_type").alias("k")
    people = t.part.groupBy(low).agg(F.min("p_partkey").alias("id")).withColumn("price", F.lit(None).cast("double"))
    fresh = t.part.where(F.col("p_size") > 25).groupBy(low).agg(F.round(F.max("p_retailprice"), 4).alias("price"))
    return U.upsert(people, fresh, ["k"], {"price": U.coalesce_new, "id": U.keep_old}).select("id", "price")


@query(MERGED + "CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'old' ELSE 'seen again' END AS state, coalesce(n.amount, o.amount) AS amount, CASE WHEN n.id IS NULL THEN o.hq ELSE false END AS closed" + FROM)
def jobs_upsert(t: Tables) -> DataFrame:
    """A row seen again keeps its first state and is open again; null text keeps the stored one."""
    stored = old(t).select("id", F.lit("old").alias("state"), "amount", F.col("hq").alias("closed"))
    seen = new(t).select("id", F.lit("new").alias("state"), "amount", F.lit(False).alias("closed"))
    return U.upsert(stored, seen, ["id"], {"state": lambda o, n: F.lit("seen again"), "amount": U.coalesce_new, "closed": lambda o, n: F.lit(False)})


@query(f"WITH {OLD}, {NEW} SELECT id, CASE WHEN NOT hq AND id NOT IN (SELECT id FROM n) AND kind <> '5-LOW' THEN 'closed' END AS closed FROM o")
def close_missing(t: Tables) -> DataFrame:
    stored = old(t).withColumn("closed", F.when(F.col("hq"), F.lit("before")))
    out = U.close_missing(stored, new(t), ["id"], "closed", F.lit("closed"), scope=F.col("kind") != "5-LOW")
    return out.select("id", F.when(F.col("closed") == "closed", F.col("closed")).alias("closed"))


@query(f"WITH {OLD}, {NEW} SELECT id + 0 AS source_id, (SELECT max(id) FROM o) + row_number() OVER (ORDER BY id) AS id FROM n WHERE id NOT IN (SELECT id FROM o)")
def insert_anti(t: Tables) -> DataFrame:
    fresh = new(t).select(F.col("id").alias("source_id"))
    stored = old(t).select("id", F.col("id").alias("source_id"))
    return U.insert_missing(stored, fresh, ["source_id"], "id", "source_id").select("source_id", "id")


@query("SELECT lower(p_type) AS slug, arg_min(p_type, p_partkey) AS name FROM part GROUP BY 1")
def get_or_create(t: Tables) -> DataFrame:
    """The first spelling of a slug keeps the name."""
    return t.part.groupBy(F.lower("p_type").alias("slug")).agg(F.min_by("p_type", "p_partkey").alias("name"))


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderdate DESC, o_orderpriority <> '1-URGENT' DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def last_wins_upsert(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("day", F.to_date("o_orderdate"))
    return U.last_wins(rows, ["o_custkey", "day"], [F.desc("o_orderdate"), (F.col("o_orderpriority") != "1-URGENT").desc(), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey")


@query(
    """WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN c_name END AS s, ['sec_edgar', 'lever', 'company_site', 'blog', NULL][c_custkey % 5 + 1] AS o, CASE WHEN c_custkey % 3 <> 0 THEN 'in ' || c_name END AS i, ['lever', 'company_site', 'sec_edgar', 'blog'][c_custkey % 4 + 1] AS src FROM customer),
r AS (SELECT * FROM (VALUES ('sec_edgar', 9), ('lever', 6), ('company_site', 3), ('blog', 0)) v(name, rank)),
m AS (SELECT c.*, i IS NOT NULL AND (s IS NULL OR o IS NULL OR o = src OR b.rank > a.rank) AS wins FROM c LEFT JOIN r a ON o = a.name LEFT JOIN r b ON src = b.name)
SELECT id, CASE WHEN wins THEN i ELSE s END AS name, CASE WHEN wins THEN src ELSE o END AS owner_name FROM m"""
)
def priority_merge(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), (k % n).cast("int"))
    rows = t.customer.select(
        k.alias("id"), F.when(k % 5 != 0, F.col("c_name")).alias("s_name"), pick(("sec_edgar", "lever", "company_site", "blog", None), 5).alias("owner_name"), F.when(k % 3 != 0, F.concat(F.lit("in "), "c_name")).alias("i_name"), pick(("lever", "company_site", "sec_edgar", "blog"), 4).alias("src")
    )
    return rows.select("id", *U.priority_merge(["name"], SOURCE_PRIORITY, F.col("src")))


@query("WITH d AS (SELECT c_custkey AS id, c_custkey % 400 AS domain, c_custkey < 400 AS owns FROM customer) SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(1.0 AS DOUBLE) AS similarity FROM d a JOIN d b ON a.domain = b.domain AND b.owns AND NOT a.owns AND a.id <> b.id")
def domain_conflict(t: Tables) -> DataFrame:
    """A domain that another entity owns stays there and makes a pair."""
    d = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 400).alias("domain"))
    owner = d.where(F.col("id") < 400).select(F.col("id").alias("other"), "domain")
    return d.where(F.col("id") >= 400).join(owner, "domain").where(F.col("id") != F.col("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.lit(1.0).alias("similarity"))


@query("WITH p AS (SELECT o_custkey AS x, o_orderkey % 300 AS y, o_totalprice AS s FROM orders) SELECT least(x, y) AS a, greatest(x, y) AS b, max(s) AS similarity FROM p WHERE x <> y GROUP BY 1, 2")
def pair_upsert(t: Tables) -> DataFrame:
    p = t.orders.select(F.col("o_custkey").alias("x"), (F.col("o_orderkey") % 300).alias("y"), "o_totalprice").where(F.col("x") != F.col("y"))
    return p.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("o_totalprice").alias("similarity"))


@query("WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') SELECT k, 'add' AS action FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'remove' FROM a WHERE k NOT IN (SELECT k FROM b)")
def desired_state_diff(t: Tables) -> DataFrame:
    current = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("k"))
    desired = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("k")).distinct()
    return U.desired_state(current, desired, ["k"])


@query("SELECT o_orderkey, (SELECT min(x.o_orderkey) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderpriority = o.o_orderpriority AND (CASE WHEN x.o_orderkey % 3 <> 0 THEN x.o_orderdate END) IS NOT DISTINCT FROM (CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderdate END)) AS matched FROM orders o")
def round_identity(t: Tables) -> DataFrame:
    """The lowest round of the same company, type and date; undated ones match each other."""
    d = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", d.alias("d"))
    low = rows.groupBy("o_custkey", "o_orderpriority", "d").agg(F.min("o_orderkey").alias("matched"))
    cond = (rows.o_custkey == low.o_custkey) & (rows.o_orderpriority == low.o_orderpriority) & rows.d.eqNullSafe(low.d)
    return rows.join(low, cond).select("o_orderkey", "matched")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'metro ' || n_name ELSE r_name END AS metro, n_nationkey % 3 = 0 AS changed FROM nation JOIN region ON n_regionkey = r_regionkey")
def region_relabel(t: Tables) -> DataFrame:
    """Places whose label differs from the configured one get it; unknown places stay."""
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").alias("metro"))
    config = t.nation.where(F.col("n_nationkey") % 3 == 0).select("n_name", F.concat(F.lit("metro "), "n_name").alias("label"))
    both = places.join(config, "n_name", "left")
    changed = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("metro"))
    return both.select("n_nationkey", F.coalesce("label", "metro").alias("metro"), changed.alias("changed"))


# --- folds -----------------------------------------------------------------------------


def decisions(t: Tables) -> DataFrame:
    """Every customer whose key is 1 modulo 10 is folded into the one before."""
    d = t.customer.where(F.col("c_custkey") % 10 == 1).select(F.col("c_custkey").alias("drop_id"), (F.col("c_custkey") - 1).alias("keep_id"))
    return d.join(t.customer.select(F.col("c_custkey").alias("keep_id")), "keep_id", "left_semi")


DECIDED = "d AS (SELECT c_custkey AS drop_id, c_custkey - 1 AS keep_id FROM customer WHERE c_custkey % 10 = 1 AND c_custkey - 1 IN (SELECT c_custkey FROM customer))"


@query(
    f"""WITH {DECIDED}, k AS (SELECT DISTINCT o_custkey AS entity, o_orderpriority AS kind FROM orders), m AS (SELECT coalesce(keep_id, entity) AS entity, kind, keep_id IS NOT NULL AS moved FROM k LEFT JOIN d ON entity = drop_id)
SELECT entity, kind, moved FROM m WHERE NOT moved OR NOT EXISTS (SELECT 1 FROM m x WHERE x.entity = m.entity AND x.kind = m.kind AND NOT x.moved)"""
)
def guarded_move(t: Tables) -> DataFrame:
    children = t.orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("kind")).distinct()
    return G.guarded_move(children, G.check_decisions(decisions(t)), "entity", ["kind"])


@query(
    f"""WITH {DECIDED}, o AS (SELECT coalesce(keep_id, o_custkey) AS id, count(*) AS rounds FROM orders LEFT JOIN d ON o_custkey = drop_id GROUP BY 1), x AS (SELECT coalesce(keep_id, c_custkey) AS id, min(c_acctbal) AS low, max(CASE WHEN keep_id IS NULL THEN c_name END) AS name FROM customer LEFT JOIN d ON c_custkey = drop_id GROUP BY 1)
SELECT x.id, name, low, coalesce(rounds, 0) AS rounds FROM x LEFT JOIN o ON x.id = o.id"""
)
def fold_entity(t: Tables) -> DataFrame:
    """Children counted at the kept entity, its own name, the least of both balances."""
    d = G.check_decisions(decisions(t))
    own = lambda df, key: df.join(d, F.col(key) == F.col("drop_id"), "left").withColumn("id", F.coalesce("keep_id", key))
    rounds = own(t.orders, "o_custkey").groupBy("id").agg(F.count(F.lit(1)).alias("rounds"))
    kept = own(t.customer, "c_custkey").groupBy("id").agg(F.max(F.when(F.col("keep_id").isNull(), F.col("c_name"))).alias("name"), F.min("c_acctbal").alias("low"))
    return kept.join(rounds, "id", "left").select("id", "name", "low", F.coalesce("rounds", F.lit(0).cast("long")).alias("rounds"))


@query(f"WITH {DECIDED}, s AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') SELECT a.o_orderkey AS lost, min(b.o_orderkey) AS twin FROM d JOIN s a ON a.o_custkey = drop_id JOIN orders b ON b.o_custkey = keep_id AND b.o_orderpriority = a.o_orderpriority WHERE b.o_orderstatus <> 'F' GROUP BY 1")
def rescue_join(t: Tables) -> DataFrame:
    """Marks of the dropped entity's rows that have an unmarked twin at the kept one."""
    d = decisions(t)
    lost = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("drop_id"), F.col("o_orderkey").alias("lost"), F.col("o_orderpriority").alias("kind"))
    twin = t.orders.where(F.col("o_orderstatus") != "F").select(F.col("o_custkey").alias("keep_id"), F.col("o_orderkey").alias("twin"), F.col("o_orderpriority").alias("kind"))
    return d.join(lost, "drop_id").join(twin, ["keep_id", "kind"]).groupBy("lost").agg(F.min("twin").alias("twin"))


@query(f"WITH {DECIDED}, k AS (SELECT o_custkey AS entity, o_orderpriority AS kind, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS v FROM orders GROUP BY 1, 2) SELECT a.entity, a.kind, coalesce(a.v, b.v) AS v FROM k a LEFT JOIN d ON a.entity = keep_id LEFT JOIN k b ON b.entity = drop_id AND b.kind = a.kind")
def self_join_update(t: Tables) -> DataFrame:
    """A missing value at the kept entity is filled from its twin at the dropped one."""
    k = t.orders.groupBy(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("kind")).agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("v"))
    gone = k.join(decisions(t), F.col("entity") == F.col("drop_id")).select(F.col("keep_id").alias("entity"), "kind", F.col("v").alias("w"))
    return k.join(gone, ["entity", "kind"], "left").select("entity", "kind", F.coalesce("v", "w").alias("v"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE (CASE WHEN a.s_suppkey % 3 <> 0 THEN a.s_nationkey % 2 END) IS DISTINCT FROM (CASE WHEN b.s_suppkey % 3 <> 0 THEN b.s_nationkey % 2 END)")
def is_distinct_from(t: Tables) -> DataFrame:
    v = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") % 2).alias("v"))
    b = v.select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.col("v").alias("w"))
    return v.join(b, F.col("s_suppkey") == F.col("a")).where(~F.col("v").eqNullSafe(F.col("w"))).select("a", "b")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, text")
def dedupe_lowest_id(t: Tables) -> DataFrame:
    key = F.sha2("text", 256)
    return G.dedupe_lowest(t.documents.select("doc_id", "lang", key.alias("k")), ["lang", "k"], "doc_id").select("doc_id")


@query(f"WITH {DECIDED}, n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS note FROM customer) SELECT keep_id AS id, coalesce(a.note, b.note) AS note, CASE WHEN a.note IS NOT NULL AND b.note IS NOT NULL THEN b.note END AS stranded FROM d JOIN n a ON a.id = keep_id JOIN n b ON b.id = drop_id")
def note_precedence(t: Tables) -> DataFrame:
    """The kept entity's note wins if it says anything; else the other's; what is lost is told."""
    n = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).alias("note"))
    both = decisions(t).join(n.select(F.col("id").alias("keep_id"), F.col("note").alias("x")), "keep_id").join(n.select(F.col("id").alias("drop_id"), F.col("note").alias("y")), "drop_id")
    return both.select(F.col("keep_id").alias("id"), F.coalesce("x", "y").alias("note"), F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("y")).alias("stranded"))


@query(
    f"""WITH {DECIDED}, p AS (SELECT DISTINCT least(o_custkey, o_orderkey % 200) AS a, greatest(o_custkey, o_orderkey % 200) AS b FROM orders WHERE o_custkey <> o_orderkey % 200),
t AS (SELECT keep_id, CASE WHEN a = drop_id THEN b ELSE a END AS other FROM p JOIN d ON a = drop_id OR b = drop_id), m AS (SELECT DISTINCT least(keep_id, other) AS a, greatest(keep_id, other) AS b FROM t WHERE keep_id <> other) SELECT a, b FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.a = m.a AND p.b = m.b)"""
)
def pair_repoint(t: Tables) -> DataFrame:
    other = F.col("o_orderkey") % 200
    p = t.orders.where(F.col("o_custkey") != other).select(F.least("o_custkey", other).alias("a"), F.greatest("o_custkey", other).alias("b")).distinct()
    return G.repoint_pairs(p, decisions(t))


@query("WITH p AS (SELECT c_nationkey AS pair, c_custkey AS id, c_custkey % 3 <> 0 AS has_domain, CAST(floor(c_acctbal / 1000) AS BIGINT) AS jobs FROM customer) SELECT pair, id AS survivor FROM p QUALIFY row_number() OVER (PARTITION BY pair ORDER BY has_domain DESC, jobs DESC, id) = 1")
def survivor_pick(t: Tables) -> DataFrame:
    p = t.customer.select(F.col("c_nationkey").alias("pair"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3 != 0).alias("has_domain"), F.floor(F.col("c_acctbal") / 1000).alias("jobs"))
    return G.survivor(p, "pair", "id", "has_domain", "jobs")


# --- resolution --------------------------------------------------------------------------

STORED = "s AS (SELECT c_custkey AS id, 'x' || (c_custkey // 2 * CASE WHEN c_custkey % 10 < 2 THEN 1 ELSE 2 END) AS external_id, CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey % 100 END AS domain, 'n' || c_custkey % 50 AS normalized_name, c_nationkey AS metro FROM customer)"
RECORDS = "r AS (SELECT o_orderkey AS rid, CASE WHEN o_orderkey % 4 = 0 THEN 'x' || o_orderkey % 500 END AS external_id, CASE WHEN o_orderkey % 4 = 1 THEN 'd' || o_orderkey % 150 END AS domain, 'n' || o_orderkey % 70 AS normalized_name, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 25 AS INTEGER) END AS metro FROM orders)"


def stored(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("id"), F.concat(F.lit("x"), (F.floor(k / 2) * F.when(k % 10 < 2, 1).otherwise(2)).cast("string")).alias("external_id"), F.when(k % 3 == 0, F.concat(F.lit("d"), (k % 100).cast("string"))).alias("domain"),
        F.concat(F.lit("n"), (k % 50).cast("string")).alias("normalized_name"), F.col("c_nationkey").alias("metro"),
    )


@query(
    f"""WITH {STORED}, {RECORDS}, e AS (SELECT external_id, min(id) AS id FROM s GROUP BY 1 HAVING count(DISTINCT id) = 1), d AS (SELECT domain, min(id) AS id FROM s WHERE domain IS NOT NULL GROUP BY 1), n AS (SELECT normalized_name, metro, min(id) AS id FROM s WHERE metro IS NOT NULL GROUP BY 1, 2)
SELECT rid, coalesce(e.id, d.id, n.id) AS entity_id, CASE WHEN e.id IS NOT NULL THEN 'external_id' WHEN d.id IS NOT NULL THEN 'domain' WHEN n.id IS NOT NULL THEN 'name' END AS matched_by FROM r LEFT JOIN e ON r.external_id = e.external_id LEFT JOIN d ON r.domain = d.domain LEFT JOIN n ON r.normalized_name = n.normalized_name AND r.metro = n.metro"""
)
def resolve_ordered(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    records = t.orders.select(k.alias("rid"), F.when(k % 4 == 0, text("x", k % 500)).alias("external_id"), F.when(k % 4 == 1, text("d", k % 150)).alias("domain"), text("n", k % 70).alias("normalized_name"), F.when(k % 5 != 0, (F.col("o_custkey") % 25).cast("int")).alias("metro"))
    return R.resolve(records, stored(t)).select("rid", "entity_id", "matched_by")


@query(
    """WITH p AS (SELECT p_partkey AS id, p_name AS name, p_type AS metro, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS g FROM part),
c AS (SELECT r.id AS rid, s.id AS entity_id, len(list_intersect(r.g, s.g)) AS n, len(r.g) + len(s.g) AS m FROM p r JOIN p s ON r.metro = s.metro AND r.name <> s.name WHERE r.id % 2 = 1 AND s.id % 2 = 0)
SELECT rid, entity_id, CAST(n / CAST(m - n AS DOUBLE) AS FLOAT) AS similarity FROM c WHERE CAST(n / CAST(m - n AS DOUBLE) AS FLOAT) > CAST(0.5 AS FLOAT)"""
)
def resolve_candidates(t: Tables) -> DataFrame:
    """Parts with odd keys are new records, those with even keys are stored."""
    p = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("normalized_name"), F.col("p_type").alias("metro"))
    return R.candidates(p.where("id % 2 = 1").withColumnRenamed("id", "rid"), p.where("id % 2 = 0"), "rid", threshold=0.5)


@query("SELECT 'n' || c_custkey % 1000 AS name, min(c_custkey) AS id FROM customer WHERE c_custkey % 1000 % 3 <> 0 GROUP BY 1 HAVING count(DISTINCT c_nationkey) = 1")
def unique_lookup(t: Tables) -> DataFrame:
    """Names that occur in one place only, whatever the number of entities there."""
    k = F.col("c_custkey") % 1000
    s = t.customer.where(k % 3 != 0).groupBy(F.concat(F.lit("n"), k.cast("string")).alias("name"))
    return s.agg(F.count_distinct("c_nationkey").alias("c"), F.min("c_custkey").alias("id")).where(F.col("c") == 1).select("name", "id")


@query(
    f"""WITH {STORED}, {RECORDS}, m AS (SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.domain = r.domain) AND NOT EXISTS (SELECT 1 FROM s WHERE s.normalized_name = r.normalized_name AND s.metro = r.metro) AND r.external_id IS NULL)
SELECT min(rid) AS rid FROM m GROUP BY coalesce('d:' || domain, 'n:|' || concat_ws('|', normalized_name, CAST(metro AS VARCHAR)))"""
)
def upsert_pipeline(t: Tables) -> DataFrame:
    """Records that match nothing stored, folded among themselves: the first by arrival is inserted."""
    k = F.col("o_orderkey")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    records = t.orders.where(k % 4 != 0).select(k.alias("rid"), F.lit(None).cast("string").alias("external_id"), F.when(k % 4 == 1, text("d", k % 150)).alias("domain"), text("n", k % 70).alias("normalized_name"), F.when(k % 5 != 0, (F.col("o_custkey") % 25).cast("int")).alias("metro"))
    fresh = R.resolve(records, stored(t)).where(F.col("entity_id").isNull()).drop("entity_id", "matched_by")
    return R.collapse_new(fresh, ["rid"]).select("rid")


@query(
    """WITH t AS (SELECT max(c_custkey) AS top FROM customer WHERE c_custkey % 2 = 0), r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'new ' || c_name END AS line, row_number() OVER (PARTITION BY c_custkey % 2 ORDER BY c_custkey) AS n FROM customer),
m AS (SELECT CASE WHEN k % 2 = 0 THEN k ELSE top + n END AS id, k, line, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN 'old' END AS stored, CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'sec_edgar' ELSE 'company_site' END END AS owner FROM r, t)
SELECT id, 'n' || k AS normalized_name, CASE WHEN line IS NOT NULL AND owner IS DISTINCT FROM 'sec_edgar' THEN line ELSE stored END AS line, CASE WHEN line IS NOT NULL AND owner IS DISTINCT FROM 'sec_edgar' THEN 'lever' ELSE owner END AS owner_line FROM m"""
)
def merge_records(t: Tables) -> DataFrame:
    """Customers with even keys are stored (those divisible by 4 are known by their external id), all are records."""
    k = F.col("c_custkey")
    name, kept = F.concat(F.lit("n"), k.cast("string")), k % 7 != 0
    c = t.customer.select(k.alias("rid"), F.concat(F.lit("x"), k.cast("string")).alias("external_id"), F.lit(None).cast("string").alias("domain"), name.alias("normalized_name"), F.col("c_nationkey").alias("metro"), F.lit(False).alias("enrich_only"), F.when(k % 3 != 0, F.concat(F.lit("new "), "c_name")).alias("line"))
    stored = t.customer.where(k % 2 == 0).select(k.alias("id"), F.lit(None).cast("string").alias("domain"), name.alias("normalized_name"), F.col("c_nationkey").alias("metro"), F.when(kept, F.lit("old")).alias("line"), F.when(kept, F.when(k % 5 == 0, "sec_edgar").otherwise("company_site")).alias("owner_line"))
    links = t.customer.where(k % 4 == 0).select(k.alias("company_id"), F.lit("lever").alias("connector"), F.concat(F.lit("x"), k.cast("string")).alias("external_id"), day("2026-01-01").alias("last_seen_at"))
    out = M.merge_records(c, stored, links, ["line"], source="lever", now=day("2026-01-02"), priority=SOURCE_PRIORITY)
    return out.entities.select("id", "normalized_name", "line", "owner_line")
