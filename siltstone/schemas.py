"""Schemas, as DDL, and ordered vocabularies."""

from __future__ import annotations

# fixed values: vocabularies in the order in which they sort
SENIORITY = ("intern", "junior", "mid", "senior", "staff", "principal", "lead", "manager", "director", "executive", "unknown")
RUN_STATUS = ("ok", "partial", "error")
TRACKING = ("none", "interested", "contacted", "applied", "interviewing", "rejected", "archived")

# fixed values: sources from the most to the least authoritative
SOURCE_PRIORITY = ("sec_edgar", "ycombinator", "greenhouse", "lever", "ashby", "workable", "company_site", "funding_rss", "product_hunt")

LOCATION = "struct<city: string, state: string, country: string, metro: string, is_hq: boolean>"
JOB = "struct<external_id: string, title: string, url: string, location_text: string, is_remote: boolean, employment_type: string, compensation_raw: string, posted_at: timestamp, description_raw: string>"
ROUND = "struct<external_id: string, round_type: string, amount_usd: bigint, announced_date: date, investors: array<struct<name: string, is_lead: boolean>>, source_url: string>"
PERSON = "struct<full_name: string, title: string, role_type: string, linkedin_url: string>"
CONTACT = "struct<kind: string, value: string, confidence: string>"

#: The nested record that every source maps to.
RECORD = f"""name string, external_id string, source_url string, domain string, website_url string, one_liner string,
    thesis string, founded_year int, employee_est int, stage string, status string, ats_provider string, ats_token string,
    locations array<{LOCATION}>, sectors array<string>, funding_rounds array<{ROUND}>, people array<{PERSON}>,
    contacts array<{CONTACT}>, jobs array<{JOB}>, jobs_complete boolean, enrich_only boolean"""

COMPANIES = """id bigint, name string, normalized_name string, domain string, website_url string, one_liner string, thesis string,
    founded_year smallint, employee_est int, stage string, status string, ats_provider string, ats_token string,
    latest_round_id bigint, latest_job_posted_at timestamp, open_job_count int, field_provenance map<string,string>,
    first_seen_at timestamp, last_seen_at timestamp"""
JOBS = """id bigint, company_id bigint, source_id bigint, external_id string, title string, url string, location_text string,
    is_remote boolean, employment_type string, role_family string, seniority string, flexible_signal boolean,
    compensation_raw string, posted_at timestamp, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp,
    description_raw string, raw_payload string"""
FETCH_RUNS = "id bigint, connector string, started_at timestamp, finished_at timestamp, status string, fetched int, upserted int, error_text string"
MERGE_CANDIDATES = "company_a_id bigint, company_b_id bigint, similarity double, reason string, resolved_at timestamp"
