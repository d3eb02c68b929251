"""Text functions as column expressions.

Expressions are exact for ASCII input; what needs Unicode tables comes from
``unicode``, whose functions take Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.unicode import fold, idna

# fixed values: legal and generic endings that a comparison name loses
NAME_SUFFIXES = ("inc", "llc", "corp", "co", "ltd", "technologies", "labs", "holdings", "incorporated", "corporation", "limited", "company", "lp", "llp", "plc", "pbc")
# fixed values: public suffixes of two labels under a two-letter country
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_domain(value: Column, international: bool = False) -> Column:
    """The canonical host of a URL or bare host: lower case, one ``www.`` less; null if it is none.

    With ``international`` hosts with other than ASCII characters are encoded for
    the DNS, which takes an Arrow-batched function; without it they are none.
    """
    raw = F.trim(value)
    rest = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^//", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"[.]+$", ""))
    host = F.regexp_replace(host, r"^www[.]", "")
    if international:
        # only these need Unicode's tables
        host = F.coalesce(idna(F.when(host.rlike(r"[^\x00-\x7F]"), host)), host)
    return F.when(~F.lower(raw).startswith("mailto:") & host.rlike(r"^[a-z0-9.-]+$") & host.contains("."), host)


def normalize_name(name: Column) -> Column:
    """The comparison form of a name: folded, punctuation as spaces, endings stripped, never empty."""
    # only names with other than ASCII letters need Unicode's tables
    text = F.coalesce(fold(F.when(name.rlike(r"[^\x00-\x7F]"), name)), F.lower(name))
    text = F.regexp_replace(text, "&", " and ")
    # dots between single letters go, however many letters: l.l.c. -> llc
    text = F.regexp_replace(text, r"(?<=(?<![\p{L}\p{N}_])[a-z])[.](?=[a-z](?![a-z0-9]))", "")
    text = F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(text, rf"( ({'|'.join(NAME_SUFFIXES)}))+$", "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def registrable_domain(domain: Column) -> Column:
    """The last two labels, or three below a second-level suffix of a country."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    three = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    return F.when(n < 2, None).otherwise(F.array_join(F.slice(labels, F.when(three, n - 2).otherwise(n - 1), F.lit(3)), "."))


def ordered_distinct(values: Column, sep: str = "; ") -> Column:
    """Non-empty values in first-seen order, joined."""
    return F.array_join(F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != ""))), sep)


def split_location(value: Column) -> Column:
    """(city, state) at the last comma, or null."""
    city = F.trim(F.regexp_extract(value, r"^(.*), (.*)$", 1))
    state = F.trim(F.regexp_extract(value, r"^(.*), (.*)$", 2))
    return F.when((city != "") & (state != ""), F.struct(city.alias("city"), state.alias("state")))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}"


def normalize_email(raw: Column) -> Column:
    """One address in canonical form: ``mailto:`` and query dropped, first of a list, lower case."""
    text = F.regexp_replace(F.trim(raw), r"(?i)^mailto:", "")
    text = F.lower(F.trim(F.split(F.try_url_decode(F.regexp_replace(F.split(text, r"\?")[0], r"\+", "%2B")), ",")[0]))
    return F.when(text.rlike(rf"^(?i){EMAIL}$"), text)


def text_emails(text: Column) -> Column:
    """Addresses written in prose, canonical, in first-seen order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"({EMAIL})"), 1), F.lower))


def person_name(raw: Column, furniture: tuple[str, ...] = ("team", "leadership", "contact", "about", "company")) -> Column:
    """The text if it looks like a person's name: 2 to 5 tokens, no digits, two capitals."""
    text = collapse(raw)
    tokens = F.split(text, " ")
    capital = F.size(F.filter(tokens, lambda t: t.rlike("^[A-Z]")))
    plain = ~text.rlike("[0-9@]") & (F.length(text) <= 60) & ~F.lower(text).rlike("|".join(furniture))
    return F.when(plain & F.size(tokens).between(2, 5) & (capital >= 2), text)


def leading_name(text: Column) -> Column:
    """Up to four capitalised words at the start."""
    found = F.regexp_extract(text, r"^\s*([A-Z][\w.&'+-]*(?:\s+[A-Z0-9][\w.&'+-]*){0,3})", 1)
    return F.nullif(F.regexp_replace(found, r"[ .,:;-]+$", ""), F.lit(""))


def clamp(text: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), r"\s+\S*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("...")))


def legal_entity(name: Column, markers: tuple[str, ...]) -> Column:
    """Whether a whole word of the folded name is a marker of an organisation."""
    folded = F.concat(F.lit(" "), collapse(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", " ")), F.lit(" "))
    return folded.rlike(f" ({'|'.join(markers)}) ")


def shared_inbox(address: Column, locals_: tuple[str, ...]) -> Column:
    return F.lower(F.substring_index(address, "@", 1)).isin(*locals_)


def search_text(*cols: Column) -> Column:
    """What a search reads: the texts that are there, apart by spaces."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


# --- HTML, by patterns -----------------------------------------------------------


ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_title(html: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """A page's title, its white space (HTML's, which has no vertical tab) collapsed."""
    found = unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), entities)
    return F.nullif(F.trim(F.regexp_replace(found, r"[ \t\n\f\r]+", " ")), F.lit(""))


def unescape(text: Column, entities: dict[str, str] = ENTITIES) -> Column:
    """Entities decoded in their order, that of the ampersand last."""
    for entity, char in entities.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_links(html: Column) -> Column:
    """The non-empty href values in document order."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)
    return F.filter(F.transform(found, lambda u: unescape(u)), lambda u: F.trim(u) != "")


def html_to_text(html: Column, limit: int | None = None) -> Column:
    """Scripts, styles and comments dropped, block tags as line ends, entities decoded, space squeezed."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer)[^>]*>", "\n")
    text = unescape(F.regexp_replace(text, r"<[^>]*>", ""))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" *\n *", "\n"), r"\n+", "\n"))
    text = F.regexp_replace(text, r"^\n|\n$", "")
    return text if limit is None else F.substring(text, 1, limit)


def meta_content(html: Column, *names: str) -> Column:
    """The content of the first of these meta names that the page has."""
    found = [F.nullif(F.trim(unescape(F.regexp_extract(html, rf'(?is)<meta\s[^>]*(?:name|property)="{n}"[^>]*content="([^"]*)"', 1))), F.lit("")) for n in names]
    return F.coalesce(*found)


# --- contacts -----------------------------------------------------------------------


def linkedin_url(url: Column) -> Column:
    """Company and profile links in one form, or null."""
    kind = F.regexp_extract(url, r"(?i)^(?:https?:)?//(?:[a-z0-9-]+[.])*linkedin[.]com/(company|in)/([^/?#]+)", 1)
    slug = F.regexp_extract(url, r"(?i)^(?:https?:)?//(?:[a-z0-9-]+[.])*linkedin[.]com/(company|in)/([^/?#]+)", 2)
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/"), F.lower(kind), F.lit("/"), F.lower(slug)))


def constructed_link(domain: Column) -> Column:
    """A likely company link from the registrable label."""
    return F.concat(F.lit("https://www.linkedin.com/company/"), F.split(registrable_domain(domain), r"\.")[0])


def people_search_url(name: Column, terms: tuple[str, ...]) -> Column:
    words = F.concat(F.lit('"'), name, F.lit('" ('), F.lit(" OR ".join(terms)), F.lit(")"))
    return F.concat(F.lit("https://www.linkedin.com/search/results/people/?keywords="), F.url_encode(words))


def social_kind(url: Column) -> Column:
    """Which kind of account a link is."""
    host = normalize_domain(url)
    return (
        F.when(linkedin_url(url).contains("/company/"), F.lit("linkedin_company"))
        .when(host.isin("x.com", "twitter.com"), F.lit("x"))
        .when(host == "github.com", F.lit("github"))
        .when(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).rlike(r"(?i)/contact"), F.lit("contact_form"))
    )


def safe_url(url: Column) -> Column:
    """http and https links only."""
    return F.when(url.rlike(r"(?i)^https?://[^\s/]+"), url)


def first_domain(text: Column, blocked: tuple[str, ...], strip: tuple[str, ...] = ()) -> Column:
    """The host of the first link that is on no blocked host or below one; career-like first labels dropped."""
    hosts = F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"')\]]+)"), 1), lambda u: normalize_domain(u))
    block = "|".join(b.replace(".", "[.]") for b in blocked)
    good = F.filter(hosts, lambda h: h.isNotNull() & ~h.rlike(rf"(^|[.])({block})$"))
    host = F.get(good, 0)
    return F.regexp_replace(host, rf"^({'|'.join(strip)})[.](?=[^.]+[.])", "") if strip else host
