"""The registered queries of this subpackage, with DuckDB SQL where there is any."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays, fingerprints, mixing, packing, pattern_packing, periodic_runs, quality, ranked_search, secret_scan, simhash, substring_dedup, suffix_dedup, toxicity, url_filter

#: Rules of the URL query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MIX_WEIGHTS, MIX_LIMIT, MIX_SEED = (1.0, 2.0, 3.0), 3, 20240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return arrays.visible(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=MIX_WEIGHTS, limit=MIX_LIMIT, seed=MIX_SEED)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.compact(quality.judge(table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    join = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return arrays.compact(found.select("doc_id", *map(of, base), F.sha2(join(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), join(F.col("spans")).alias("spans")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


#: The labels' categories in the chain's order.
TOXIC_CHAIN = ["low_quality", "toxic"]


def toxic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, toxic_labels(spark, sf_dir), TOXIC_CHAIN)
    return arrays.compact(toxicity.score(docs, chain)).withColumnRenamed("rejected", "toxic")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The edit of op11: in a tenth of the documents, by id, the words from some place on repeat a stretch from there; null ids are left alone."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(table(spark, sf_dir, "documents"), rewrite=looped)
    # exact fractions are compared crosswise; of equal ones the first stays
    best = F.aggregate(F.slice("runs", F.lit(2), F.size("runs")), F.get("runs", 0), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return arrays.compact(out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"))


def op12_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_packing.pack(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secrets": op10_secrets,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pattern_packing": op12_pattern_packing,
    "op13_ranked_search": op13_ranked_search,
}

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)


def _secrets_sql() -> str:
    """Each rule's matches are put between two marks; their places follow from the lengths of the parts."""
    rules, parts = secret_scan.BASE_RULES + secret_scan.MORE_RULES, []
    for k, r in enumerate(rules):
        pattern = r.pattern
        if r.ignore_case:
            names, rest = r.pattern.split(")", 1)
            pattern = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names) + ")" + rest
        pattern = pattern.replace("'", "''")
        size = f"length(regexp_extract(hit, '{pattern}', {r.group}))" if r.group else "length(hit)"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, a, a + length(hit) AS b FROM (SELECT doc_id, n, split_part(piece, chr(57345), 1) AS hit, sum(CASE WHEN n = 1 THEN length(piece) ELSE length(piece) - 1 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::BIGINT AS a "
            f"FROM (SELECT doc_id, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS n FROM (SELECT doc_id, string_split(regexp_replace(text, '{pattern}', chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS p FROM documents WHERE regexp_matches(text, '{pattern}')))) WHERE n > 1 AND {size} >= {r.least}"
        )
    base = ", ".join(f"count(s.k) FILTER (s.k = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE_RULES))
    line = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"WITH s AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {base}, sha256(coalesce({line} FILTER (s.k < {len(secret_scan.BASE_RULES)}), '')) AS base_sha256, coalesce({line} FILTER (s.k IS NOT NULL), '') AS spans FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id"


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH r(rh, rp, v) AS (VALUES {_RULES}),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
m AS (SELECT page_id, max(struct_pack(a := length(rh || rp), b := length(rh), rule := rh || rp, verdict := v)) AS best
      FROM q JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT q.page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id""",
    "op4_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT doc_id, list_transform(range(0, length(x) // 2 - 199), lambda i: md5(substr(x, 2 * i + 1, 400))) AS h FROM d WHERE length(x) >= 400),
r AS (SELECT doc_id, unnest(h) AS k, unnest(range(0, len(h))) AS i FROM h),
t AS (SELECT k FROM r GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM r JOIN t ON r.k = t.k),
n AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM f),
m AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM n GROUP BY doc_id, span),
p AS (SELECT m.doc_id, a, b, substr(x, 2 * lag(b, 1, 0) OVER (PARTITION BY m.doc_id ORDER BY a) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY m.doc_id ORDER BY a))) AS piece FROM m JOIN d ON m.doc_id = d.doc_id),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS gone, count(*) AS spans, max(b) AS last, string_agg(piece, '' ORDER BY a) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, length(x) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
b AS (SELECT *, CASE WHEN size < 16 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)) % 8 END AS band,
             substr(md5(doc_id::VARCHAR), 1, 2) AS spread FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3 AS cap FROM s),
x AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS share
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, max(share) OVER () AS lvl FROM x),
z AS (SELECT source, source_size, least(cap::DOUBLE, lvl * w) AS target,
             ('0x' || substr(md5('20240:' || coalesce('=' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM y),
j AS (SELECT b.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
             size > target / 50.0::DOUBLE AS large FROM b JOIN z ON b.source IS NOT DISTINCT FROM z.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source, large ORDER BY band, spread, size, doc_id) AS rk FROM j),
c AS (SELECT *, least(floor(u + rate * rk) - floor(u + rate * (rk - 1)), 3)::BIGINT AS first FROM n),
e AS (SELECT source, coalesce(sum(CASE WHEN large THEN first * size END), 0)::BIGINT AS got, coalesce(sum(CASE WHEN NOT large THEN size END), 0)::BIGINT AS left_over, max(target) AS t FROM c GROUP BY source),
f AS (SELECT source, CASE WHEN left_over > 0 THEN least(greatest((t - got) / left_over, 0.0::DOUBLE), 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rest FROM e)
SELECT doc_id, size, source_size, target, size * CASE WHEN large THEN first ELSE least(floor(u + rest * rk) - floor(u + rest * (rk - 1)), 3)::BIGINT END AS taken
FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source""",
    "op9_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT doc_id, list_transform(range(1, len(ws) - 11), lambda i: md5(array_to_string(ws[i:i + 12], ' '))) AS h FROM w WHERE len(ws) >= 13),
r AS (SELECT doc_id, unnest(h) AS k, unnest(range(1, len(h) + 1)) AS i FROM h),
f AS (SELECT k, min(doc_id) AS first FROM r GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM r JOIN f ON r.k = f.k WHERE first < doc_id),
l AS (SELECT doc_id, list(p) AS ps FROM g GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' ')) AS kept_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id""",
    "op10_secrets": _secrets_sql(),
    # a run repeats at least 16 words one period on, so it is a stretch of places whose 16 words stand there again
    "op11_periodic_runs": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
bits AS (SELECT range AS b, list_reduce(list_prepend(range::BIGINT, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS e FROM range(256)),
tab AS (SELECT list(e ORDER BY b) AS t FROM bits),
k AS (SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM w, tab),
v AS (SELECT doc_id, ws, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS m FROM k),
e AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + m)) END + 1]) END AS ws FROM v),
g AS (SELECT doc_id, unnest(list_transform(range(1, n - 14), lambda i: md5(array_to_string(ws[i:i + 15], ' ')))) AS k, unnest(range(0, n - 15)) AS i FROM e WHERE n >= 16),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.k = y.k AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM p),
l AS (SELECT doc_id, q, min(i) AS start, count(*) + 15 + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM l GROUP BY doc_id, start, length),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM r),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r) GROUP BY doc_id)
SELECT e.doc_id, coalesce(n_runs, 0) AS n_runs, o.start, o.length, o.period, (1000 * o.length) // o.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(gone, []), i - 1)), ' ')) AS collapsed_sha256
FROM e LEFT JOIN b ON e.doc_id = b.doc_id LEFT JOIN o ON e.doc_id = o.doc_id AND o.place = 1 LEFT JOIN c ON e.doc_id = c.doc_id""",
    "op13_ranked_search": rf"""
WITH p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_TERM}')) AS t FROM documents) GROUP BY doc_id, t),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
f AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, docs),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_TERM}')) AS t FROM benchmark),
x AS (SELECT item_id, p.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score FROM q JOIN f ON q.t = f.t JOIN p ON p.t = q.t JOIN d ON d.doc_id = p.doc_id, s GROUP BY item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
}
