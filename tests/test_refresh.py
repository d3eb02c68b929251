"""A source refreshed end to end: records, children, lists that close, the log of runs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from siltstone.database import Database
from siltstone.operators.refresh import SCHEMAS, refresh

NOW = lambda d: dt.datetime(2026, 3, d, 12, tzinfo=dt.UTC)


def hit(name, slug, website=None, **more):
    return {"name": name, "slug": slug, "website": website, **more}


def page(*hits):
    return json.dumps({"results": [{"hits": list(hits)}]})


def board(*jobs):
    return json.dumps({"jobs": [{"id": i, "title": t, "updated_at": f"2026-02-{d:02d}T00:00:00Z"} for i, t, d in jobs]})


def save(root, target, name, text):
    (root / target).mkdir(parents=True, exist_ok=True)
    (root / target / name).write_text(text)


@pytest.fixture
def db(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), SCHEMAS)
    places = spark.createDataFrame([(1, "Oslo", "", "NO", "nordic")], SCHEMAS["places"])
    db.commit(lambda s: {"places": places})
    return db


def companies(db):
    return {r.name: r for r in db.snapshot()["companies"].collect()}


def test_two_sources_and_their_children(spark, db, tmp_path):
    root = tmp_path / "yc"
    save(root, "p", "1.json", page(hit("Acme Inc.", "acme", "https://acme.com", one_liner="Things", industries=["B2B", "Fintech"], all_locations="Oslo, NO; Rome, IT"), hit("Beta", "beta", industries=["B2B"])))
    assert refresh(db, "ycombinator", str(root), now=NOW(1)) == 1
    c = companies(db)
    assert c.keys() == {"Acme Inc.", "Beta"} and (c["Acme Inc."].domain, c["Acme Inc."].one_liner, c["Acme Inc."].field_provenance["one_liner"]) == ("acme.com", "Things", "ycombinator")
    s = db.snapshot()
    assert sorted(r.slug for r in s["sector_names"].collect()) == ["b2b", "fintech"] and s["sectors"].count() == 3
    offices = {r.city: (r.is_hq, r.id) for r in s["locations"].join(s["places"], F.col("location_id") == F.col("id")).collect()}
    assert offices.keys() == {"Oslo", "Rome"} and offices["Oslo"] == (True, 1) and not offices["Rome"][0] and c["Acme Inc."].metro == "nordic"
    # the board is found by the token that the site shows
    db.commit(lambda s: {"companies": s["companies"].withColumn("ats_provider", F.when(F.col("domain") == "acme.com", "greenhouse")).withColumn("ats_token", F.when(F.col("domain") == "acme.com", "acme-token"))})
    gh = tmp_path / "gh"
    save(gh, "acme-token", "jobs.json", board((1, "Dev", 3), (2, "Ops", 9)))
    save(gh, "stranger", "jobs.json", board((7, "Nobody", 1)))
    save(gh, "broken", "jobs.json", "<html>")
    assert refresh(db, "greenhouse", str(gh), now=NOW(2)) == 2
    a = companies(db)["Acme Inc."]
    assert (a.open_job_count, a.latest_job_posted_at.day, db.snapshot()["companies"].count()) == (2, 9, 2)
    ids = {r.external_id: r.id for r in db.snapshot()["jobs"].collect()}
    # one is gone, one is new; then the board is empty, then the first is back under its id
    save(gh, "acme-token", "jobs.json", board((2, "Ops lead", 9), (3, "QA", 11)))
    refresh(db, "greenhouse", str(gh), now=NOW(3))
    jobs = {r.external_id: r for r in db.snapshot()["jobs"].collect()}
    assert {k: j.closed_at is None for k, j in jobs.items()} == {"1": False, "2": True, "3": True} and jobs["2"].title == "Ops lead" and jobs["2"].id == ids["2"]
    save(gh, "acme-token", "jobs.json", board())
    refresh(db, "greenhouse", str(gh), now=NOW(4))
    assert companies(db)["Acme Inc."].open_job_count == 0 and companies(db)["Acme Inc."].latest_job_posted_at is None
    save(gh, "acme-token", "jobs.json", board((1, "Dev", 3)))
    refresh(db, "greenhouse", str(gh), now=NOW(5))
    jobs = {r.external_id: r for r in db.snapshot()["jobs"].collect()}
    assert jobs["1"].closed_at is None and jobs["1"].id == ids["1"] and jobs["1"].first_seen_at.day == 2 and companies(db)["Acme Inc."].open_job_count == 1
    runs = db.snapshot()["runs"].orderBy("id").collect()
    assert [(r.connector, r.status, r.fetched, r.upserted) for r in runs] == [("ycombinator", "ok", 2, 2), *[("greenhouse", "ok", 2, 1)] * 4]


def test_a_filing_and_a_run_that_breaks(spark, db, tmp_path):
    root = tmp_path / "sec"
    filing = "<edgarSubmission><primaryIssuer><cik>{}</cik>{}<issuerAddress><city>Oslo</city></issuerAddress></primaryIssuer><relatedPersonsList><relatedPersonInfo><relatedPersonName><firstName>Ada</firstName><lastName>L</lastName></relatedPersonName></relatedPersonInfo></relatedPersonsList><offeringData><typeOfFiling><dateOfFirstSale><value>2026-01-05</value></dateOfFirstSale></typeOfFiling><offeringSalesAmounts><totalAmountSold>500</totalAmountSold></offeringSalesAmounts></offeringData></edgarSubmission>"
    save(root, "a1", "doc.xml", filing.format(1, "<entityName>Gamma LLC</entityName>"))
    save(root, "a2", "doc.xml", filing.format(2, ""))
    for d in (1, 2):  # the second run changes nothing but the log
        refresh(db, "sec_edgar", str(root), now=NOW(d), since=dt.date(2020, 1, 1))
    s = db.snapshot()
    assert [(r.amount_usd, r.announced_date) for r in s["rounds"].collect()] == [(500, dt.date(2026, 1, 5))] and [r.full_name for r in s["people"].collect()] == ["Ada L"]
    g = companies(db)["Gamma LLC"]
    assert (g.latest_round_id, g.normalized_name, g.first_seen_at.day, g.last_seen_at.day) == (1, "gamma", 1, 2)
    runs = s["runs"].orderBy("id").collect()
    assert [(r.status, r.error_text) for r in runs] == [("partial", "1 payloads: no issuer")] * 2
    before = s.version
    refresh(db, "ycombinator", str(tmp_path / "nowhere"), now=NOW(3))
    last = db.snapshot()["runs"].orderBy(F.desc("id")).first()
    # only the run's own row was written, twice
    assert last.status == "error" and last.error_text and db.snapshot().version == before + 2 and db.snapshot()["companies"].count() == 1
    with pytest.raises(KeyError):
        refresh(db, "nobody", str(root), now=NOW(3))
    with pytest.raises(ValueError):
        refresh(db, "ycombinator", str(root), now=dt.datetime(2026, 1, 1))
