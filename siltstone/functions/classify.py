"""Ordered keyword rules: the first rule with a hit gives the value.

Rules are (value, keywords) in order of precedence, or YAML of lists of
``{<key>: value, any: [keywords]}``.  A plan has one pattern for each rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How much of a body is read.
BODY = 8000
EDGE = r"[^\p{L}\p{N}_]"

# small sets in order of precedence, for callers without rules of their own
FAMILIES = (
    ("ml_ai", ("machine learning", "deep learning", "ai engineer")),
    ("security", ("security", "infosec")),
    ("data", ("data scientist", "data engineer", "analytics")),
    ("software", ("software", "backend", "frontend", "engineer", "developer")),
    ("sales", ("sales", "account executive")),
    ("legal", ("legal", "counsel")),
)
EMPLOYMENT = (("internship", ("intern", "internship")), ("part_time", ("part-time", "hourly")), ("contract", ("contract", "contractor", "freelance")), ("full_time", ("full-time", "permanent")))
SENIORITIES = (("intern", ("intern",)), ("executive", ("chief", "vp")), ("director", ("director", "head of")), ("senior", ("senior", "sr")), ("junior", ("junior", "jr")))
FLEXIBLE = ("flexible hours", "flexible schedule", "four-day week", "part-time")


def keyword_pattern(keyword: str) -> str:
    """The keyword between edges; a dash and a space stand for each other."""
    body = "".join(r"[-‐-―\s]" if c in "-‐‑‒–—" or c.isspace() else re.escape(c) for c in re.sub(r"\s+", " ", keyword.strip()))
    left = rf"(?:^|{EDGE})" if keyword[:1].isalnum() or keyword[:1] == "_" else ""
    right = rf"(?:{EDGE}|$)" if keyword[-1:].isalnum() or keyword[-1:] == "_" else ""
    return left + body + right


def any_pattern(keywords: Iterable[str]) -> str:
    return "(?i)" + "|".join(keyword_pattern(k) for k in keywords)


def load_rules(path: str, block: str, key: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Rules of a YAML file: its ``block`` is a list of {key: value, any: [...]}."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f)
    for part in block.split("."):
        entries = entries[part]
    return tuple((str(e[key]), tuple(map(str, e["any"]))) for e in entries)


def found(text: Column, keywords: Iterable[str]) -> Column:
    """Whether any keyword occurs; its longest piece is looked for before the pattern runs."""
    low, out = F.lower(text), None
    for k in keywords:
        piece = max(re.findall(r"[a-z0-9_]+", k.lower()) or [""], key=len) if k.isascii() else ""
        hit = F.contains(low, F.lit(piece)) & text.rlike("(?i)" + keyword_pattern(k))
        out = hit if out is None else out | hit
    return F.lit(False) if out is None else out


def first_match(text: Column, rules, default: str | None = None) -> Column:
    out = F.lit(default)
    for value, keywords in reversed(tuple(rules)):
        out = F.when(found(text, keywords), F.lit(value)).otherwise(out)
    return out


def matched_keyword(text: Column, rules) -> Column:
    """The keyword that decided, or null."""
    hits = [F.when(text.rlike("(?i)" + keyword_pattern(k)), F.lit(k)) for _, keywords in rules for k in keywords]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def classify_round(text: Column, rules) -> list[Column]:
    """round type of a headline and the keyword that told it; unknown where no rule fits."""
    line = F.regexp_replace(text, r"\s+", " ")
    return [first_match(line, rules, "unknown").alias("round_type"), matched_keyword(line, rules).alias("keyword")]


def classify_person(title: Column, rules) -> list[Column]:
    """role type of a person's title and the keyword that told it; null where no rule fits."""
    line = F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))
    return [first_match(line, rules).alias("role_type"), matched_keyword(line, rules).alias("keyword")]


def classify_role(title: Column, body: Column, hint: Column, *, families=FAMILIES, employment=EMPLOYMENT, seniorities=SENIORITIES, flexible=FLEXIBLE) -> list[Column]:
    """family, seniority, employment type and flexibility of a role.

    Family and seniority read the title; the employment type is the source's
    hint, else from the title, else from the body; flexibility reads both.
    """
    body = F.substring(body, 1, BODY)
    kind = F.coalesce(hint, first_match(title, employment), first_match(body, employment), F.lit("unknown"))
    both = F.coalesce(title.rlike(any_pattern(flexible)), F.lit(False)) | F.coalesce(body.rlike(any_pattern(flexible)), F.lit(False))
    return [first_match(title, families, "other").alias("role_family"), first_match(title, seniorities, "unknown").alias("seniority"), kind.alias("employment_type"), both.alias("flexible_signal")]


def source_value(value: Column, table: dict[str, str]) -> Column:
    """A source's own label looked up without case, spaces, dashes and underscores."""
    key = F.regexp_replace(F.lower(value), r"[\s_-]+", "")
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (re.sub(r"[\s_-]+", "", k.lower()), v)])[key]
