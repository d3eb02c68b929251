import json

import pytest
from pyspark.sql import functions as F

from siltstone.sources import boards, feeds, registry
from siltstone.streaming.dedup import drain


def payload(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, payload string")


def test_lever(spark):
    job = {"id": "1", "text": "Dev", "hostedUrl": "u", "createdAt": 1700000000000, "workplaceType": "remote", "descriptionPlain": "Hi", "categories": {"commitment": "Full-time", "location": "Rome", "allLocations": ["Rome", "Oslo", "Rome"]}, "salaryRange": {"min": 1000, "max": 2000, "currency": "USD", "interval": "per-year"}}
    r = boards.lever(payload(spark, json.dumps([job, {"id": None}]), "not json"), ["k"]).collect()
    assert len(r) == 1 and (r[0].location_text, r[0].is_remote, r[0].employment_type, r[0].compensation_raw, r[0].description_raw) == ("Rome; Oslo", True, "Full-time", "USD 1,000-2,000 per-year", "Hi")


def test_workable(spark):
    got = {"jobs": [{"shortcode": "A", "title": "T", "telecommuting": False, "published_on": "2026-01-02", "locations": [{"city": "Rome", "region": "", "country": "IT", "hidden": False}, {"city": "X", "hidden": True}]}]}
    r = boards.workable(payload(spark, json.dumps(got)), ["k"]).first()
    assert (r.external_id, r.location_text, str(r.posted_at)) == ("A", "Rome, IT", "2026-01-02 00:00:00")
    flags = payload(spark, json.dumps(got), '{"jobs": [], "description": " "}').select(boards.board_has_content(F.col("payload"))).collect()
    assert [f[0] for f in flags] == [True, False]


def test_directory(spark):
    hit = {"name": "Acme", "slug": "acme", "website": "https://www.acme.com", "all_locations": "SF, CA, USA; Remote", "team_size": "12", "industries": ["B2B"], "tags": ["B2B", "AI"], "batch": "Winter 2024", "status": "Active"}
    r = feeds.directory(payload(spark, json.dumps({"results": [{"hits": [hit, {"name": " "}]}]})), ["k"]).collect()
    assert len(r) == 1 and (r[0].domain, r[0].employee_est, r[0].sectors, r[0].locations, r[0].status) == ("acme.com", 12, ["B2B", "AI", "YC W24"], [["SF", "CA", "USA"]], "active")


def test_feed(spark):
    xml = "<rss><channel><item><title>Acme raises $3M</title><link>l</link><pubDate>Fri, 02 Jan 2026 10:00:00 GMT</pubDate></item><item><title>Old</title><pubDate>Fri, 02 Jan 2015 10:00:00 GMT</pubDate></item><item><title>Undated</title><guid>g</guid></item></channel></rss>"
    r = feeds.feed_items(payload(spark, xml), ["k"], F.lit("2026-01-10").cast("timestamp")).orderBy("position").collect()
    assert [(x.title, x.external_id) for x in r] == [("Acme raises $3M", "l"), ("Undated", "g")]
    title = spark.createDataFrame([("Crusoe reportedly raises $3B",), ("Acme, an AI startup, lands $1M",), ("A b c d e f g raises",), ("Nothing",)], "t string")
    assert [x[0] for x in title.select(feeds.headline_name(F.col("t"))).collect()] == ["Crusoe", "Acme", None, None]
    assert spark.createDataFrame([("raises $0", "got $2M")], "t string, s string").select(feeds.funding_amount(F.col("t"), F.col("s"))).first()[0] == 2_000_000


def test_rejects(spark):
    hits = spark.createDataFrame([("a", "1", "2026-01-01", "D", ("Oslo", "NO")), ("a", "1", "2026-01-02", "D/A", ("Oslo", "NO")), (None, "1", None, "D", ("Oslo", "NO")), ("b", "1", None, "D", ("Rome", "IT"))], "accession string, cik string, file_date string, form string, place struct<city: string, state: string>")
    regions = spark.createDataFrame([("oslo", "no")], "city string, state string")
    got = sorted(str(r.reason) for r in feeds.rejects(hits, regions).collect())
    assert got == ["None", "duplicate", "malformed", "out_of_region"]


def test_registry_and_saved_payloads(spark, tmp_path):
    with pytest.raises(KeyError, match="greenhouse"):
        registry.mapper("nope")
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text("[]")
    got = registry.saved_payloads(spark, str(tmp_path)).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a.json", "{}"), ("b.json", "[]")]


def test_stream_takes_each_item_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.sql("SELECT 1L AS id, TIMESTAMP '2026-01-01 00:00:00' AS ts UNION ALL SELECT 1L, TIMESTAMP '2026-01-01 01:00:00' UNION ALL SELECT 2L, TIMESTAMP '2026-01-02 00:00:00'").write.parquet(src)
    schema = spark.read.parquet(src).schema
    write = lambda df, n: df.write.mode("append").parquet(out)
    drain(spark, src, schema, ck, write, ["id"], "ts")
    spark.sql("SELECT 2L AS id, TIMESTAMP '2026-01-02 05:00:00' AS ts UNION ALL SELECT 3L, TIMESTAMP '2026-01-02 06:00:00'").write.mode("append").parquet(src)
    drain(spark, src, schema, ck, write, ["id"], "ts")
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_seeds(spark, tmp_path):
    from siltstone.sources import seeds

    f = tmp_path / "s.yaml"
    f.write_text("deep_tech:\n  companies: [Acme Labs, {name: Beta, website: 'https://www.beta.io', sector: Chips}]\nbio:\n  label: Life\n  companies: [Gene]\n")
    got = sorted((r.name, r.domain, r.sector, r.external_id) for r in seeds.load_seeds(spark, str(f)).collect())
    assert got == [("Acme Labs", None, "Deep Tech", "acme-labs"), ("Beta", "beta.io", "Chips", "beta"), ("Gene", None, "Life", "gene")]
    codes = spark.createDataFrame([(404,), (200,), (None,)], "c int").select(seeds.verdict(F.col("c"))).collect()
    assert [r[0] for r in codes] == ["dead", None, "dead"]


def test_people():
    from siltstone.sources.people import people_of

    page = """<div class=team><div><h3>Ada Lovelace</h3><span>CEO &amp; Founder</span><p><a href="https://linkedin.com/in/ada">in</a></p></div>
    <div><h3>Grace Hopper</h3><a href="https://linkedin.com/in/g1">in</a><a href="https://linkedin.com/in/g2">in</a></div><a href="https://linkedin.com/in/nobody">x</a></div>"""
    assert people_of(page) == [("Ada Lovelace", "CEO & Founder", "https://www.linkedin.com/in/ada")]
    assert people_of("") == people_of(None) == []
    one = lambda html: people_of(html) and people_of(html)[0][:2]
    link = '<a href="https://www.linkedin.com/in/Jo-1">{}</a>'
    jane = ("Jane Doe", None)
    assert one("<a href='//linkedin.com/in/jd/?a'><img><h2>Jane Doe, M.D., MBA</h2><p>CEO\u200b &amp; Founder</p></a>") == ("Jane Doe", "CEO & Founder")
    assert one("<div><h3>Leadership</h3><p>Boss</p>" + link.format("Jane Doe") + "</div>") == jane  # the heading is not hers, nor its next line
    assert one("<h3>" + link.format("Jane Doe") + "</h3><p>jane doe</p><p>CTO</p>") == jane  # only what comes first
    assert one("<div><h3>Jane Doe</h3><p>" + "x" * 81 + "</p>" + link.format("in") + "</div>") == jane
    deep = "<div>" * 4 + link.format("in") + "</div>" * 4
    assert one(f"<section><h3>Jane Doe</h3>{deep}</section>") == [] and one(f"<section><h3>Jane Doe</h3>{deep[5:-6]}</section>") == ("Jane Doe", "in")
    assert one(link.format("Visit Our LinkedIn")) == [] == one(link.format("jane doe")) == one(link.format("Jane 2 Doe"))
    assert people_of("<a href='https://linkedin.com/company/x'>Jane Doe</a><a href='https://notlinkedin.com/in/x'>Jane Doe</a>") == []
    two = "".join(f"<div><a href='https://linkedin.com/in/{s}'>{n}</a></div>" for s, n in (("a", "Jane Doe"), ("b", "jane Doe X"), ("c", "JANE DOE"), ("a", "Other Name"), ("d", "Max Roe")))
    assert [p[0] for p in people_of(two)] == ["jane Doe X", "Max Roe"]


def test_board_records(spark):
    jobs = boards.greenhouse(payload(spark, json.dumps({"jobs": [{"id": 2, "title": "B"}, {"id": 1, "title": "A"}]})), ["k"])
    targets = spark.createDataFrame([(0, "Acme", True), (1, "Beta", None)], "k long, name string, read boolean")
    got = boards.records(targets, jobs, ["k"]).orderBy("k").collect()
    assert [([j.external_id for j in r.jobs], r.jobs_complete, r.enrich_only) for r in got] == [(["2", "1"], True, True), ([], False, True)]


def test_hiring_comments(spark):
    items = [{"id": 1, "title": "Ask HN: Who is hiring? (May)", "time": 5, "kids": [11, 12, 13]}, {"id": 2, "title": "Ask HN: Who wants to be hired?", "time": 9, "kids": [14]}]
    items += [{"id": 11, "time": 1700000000, "text": "Acme | Rome | Full-time | https://www.acme.com/jobs<p>Write to Jobs@acme.com"}, {"id": 12, "deleted": True}, {"id": 13, "time": 1, "text": "Late | x"}, {"id": 14, "text": "No | x"}]
    r = registry.mapper("hn_hiring")(payload(spark, *map(json.dumps, items)), newest=1, kids=2).collect()
    assert len(r) == 1 and (r[0].comment, r[0].name, r[0].domain, r[0].commitment, r[0].others, r[0].addresses) == (11, "Acme", "acme.com", "Full-time", ["Rome"], ["jobs@acme.com"])


def test_company_site(spark):
    home = '<title>Acme</title><meta name="description" content="We make it"><a href="https://github.com/acme">g</a><a href="mailto:Hi@acme.com">m</a>'
    team = '<meta name="description" content="Team"><a href="https://www.linkedin.com/company/acme/">l</a><a href="mailto:hi@acme.com">m</a>'
    pages = spark.createDataFrame([("https://acme.com/", home), ("https://www.acme.com/team", team), ("nowhere", home), ("https://b.org/", None)], "url string, html string")
    r = {x.domain: x for x in registry.mapper("company_site")(pages).collect()}
    assert set(r) == {"acme.com", "b.org"} and r["b.org"].pages == 1 and r["b.org"].one_liner is None
    a = r["acme.com"]
    assert (a.pages, a.one_liner, a.addresses) == (2, "We make it", ["hi@acme.com"])
    assert [(x.kind, x.url) for x in a.links] == [("github", "https://github.com/acme"), ("linkedin_company", "https://www.linkedin.com/company/acme/")]


def test_international_hosts_and_resolved_links(spark):
    from siltstone.functions import text as X
    from siltstone.sources import sites

    hosts = ["https://www.Bücher.de/x", "bücher.de:80", "BÜCHER.DE.", "plain.com", "http://ü", "mailto:a@bücher.de", None, "xn--bcher-kva.de"]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, h string")
    got = [r.d for r in df.select("k", X.normalize_domain(F.col("h"), international=True).alias("d")).orderBy("k").collect()]
    assert got == ["xn--bcher-kva.de", "xn--bcher-kva.de", "xn--bcher-kva.de", "plain.com", None, None, None, "xn--bcher-kva.de"]
    page = '<a href="//www.linkedin.com/company/acme">in</a><a href="mailto:hi@acme.com">m</a><a href="http://[bad">x</a><a href="../team">t</a>'
    pages = spark.createDataFrame([("https://bücher.de/about/us", page), ("https://bücher.de/", None)], "url string, html string")
    row = sites.site(pages).collect()
    assert len(row) == 1 and row[0].domain == "xn--bcher-kva.de" and row[0].pages == 2 and row[0].addresses == ["hi@acme.com"]
    assert [link.url for link in row[0].links] == ["https://www.linkedin.com/company/acme"]


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    from siltstone.operators.search import Index, documents_with

    docs = spark.createDataFrame([(1, "Licensed to the public"), (2, "A public licence"), (3, "rights reserved here"), (4, "reserved rights"), (5, None), (6, ""), (7, "right now reserves")], "doc_id long, text string")
    index = Index.build(docs, "doc_id", "text", str(tmp_path / "i"))
    for q in ("licensing public", '"rights reserved"', "-public", "the of", 'rights or licence -public', "", "nothing"):
        ids = lambda df: sorted(r.doc_id for r in df.collect())
        assert ids(index.documents_with(q)) == ids(documents_with(docs, "doc_id", "text", q)), q
