"""People on a page: profile links with the heading they belong to."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HIDDEN = frozenset({"script", "style", "template", "noscript", "svg", "head"})

FOUND = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("full_name", "title", "url")]))


class _Node:
    __slots__ = ("tag", "href", "parent", "parts")

    def __init__(self, tag, href=None, parent=None):
        self.tag, self.href, self.parent, self.parts = tag, href, parent, []

    def walk(self):
        for p in self.parts:
            yield p
            if isinstance(p, _Node):
                yield from p.walk()

    def text(self) -> str:
        return " ".join(" ".join(p for p in self.walk() if isinstance(p, str)).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("")

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs).get("href"), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in HIDDEN and data.strip():
            self.at.parts.append(data)


# fixed values: endings that are no part of a name, and what page furniture says
CREDENTIALS = frozenset({"phd", "md", "mba", "jr", "sr", "ii", "iii", "msc", "ms", "jd", "esq"})
FURNITURE = ("linkedin", "visit", "follow", "profile", "team", "leadership")
#: How far up a card may begin, and the longest name and title.
CLIMB, NAME, TITLE = 4, 60, 80

_PROFILE = re.compile(r"(?i)(?:https?:)?//(?:[a-z0-9-]+[.])*linkedin[.]com(?::\d+)?/in/([\w%.~-]+)(?:[/?#]|$)")


def _visible(text: str) -> str:
    """One line without invisible characters."""
    return " ".join("".join(c for c in text if unicodedata.category(c) != "Cf").split())


def _name(text: str) -> str | None:
    """A text that looks like a person's name, without endings like ``, PhD``; else None."""
    parts = [p.strip() for p in _visible(text).split(",")]
    while len(parts) > 1 and re.sub("[. ]", "", parts[-1]).casefold() in CREDENTIALS:
        parts.pop()
    text = ", ".join(p for p in parts if p)
    words = text.split()
    plain = len(text) <= NAME and not any(c.isdigit() or c == "@" for c in text) and not any(f in text.casefold() for f in FURNITURE)
    return text if plain and 2 <= len(words) <= 5 and sum(w[0].isupper() for w in words) >= 2 else None


def _profile(href: str | None) -> str | None:
    """A profile's address in one form; the slug keeps its case."""
    found = _PROFILE.match(href or "")
    return f"https://www.linkedin.com/in/{found[1]}" if found else None


def _inside(node: _Node, fits) -> list[_Node]:
    return [n for n in node.walk() if isinstance(n, _Node) and fits(n)]


def _heading(n: _Node) -> bool:
    return n.tag in HEADINGS


def _title(heading: _Node, name: str) -> str | None:
    """What the first element with text behind the heading says, unless that is long or the name again."""
    siblings = heading.parent.parts
    at = next(k for k, p in enumerate(siblings) if p is heading)
    for p in siblings[at + 1 :]:
        if isinstance(p, _Node) and p.tag not in HIDDEN and (text := _visible(p.text())):
            return text if len(text) <= TITLE and text.casefold() != name.casefold() else None
    return None


def _card(link: _Node) -> tuple[_Node | None, bool]:
    """The heading of the card that a link is in, and whether the link is inside it.

    The first ancestor with a heading is the card; one with several, or with
    several profiles, is a section and has no name for anyone.
    """
    node = link.parent
    for _ in range(CLIMB):
        if node is None or node.tag == "":
            break
        if _heading(node):
            return node, True
        heads = _inside(node, _heading)
        if heads:
            alone = len(heads) == 1 and len(_inside(node, lambda n: n.tag == "a" and _profile(n.href) is not None)) == 1
            return (heads[0] if alone else None), False
        node = node.parent
    return None, False


def people_of(html: str) -> list[tuple[str, str | None, str]]:
    """(name, title, profile): for each profile that a page links, in order, the person whom its card names.

    A heading inside the link is the name, else the link's own text if it looks
    like one, else its card's heading.  The title is read only behind the
    heading that gave the name or that the link is in.  A name with several
    profiles is a heading of a section, and its people are dropped.
    """
    tree = _Tree()
    tree.feed(html or "")
    found: dict[str, tuple[str, str | None]] = {}
    for link in _inside(tree.root, lambda n: n.tag == "a"):
        url = _profile(link.href)
        if url is None or url in found:
            continue
        heads = _inside(link, _heading)
        name = title = None
        if len(heads) == 1:
            name = _name(heads[0].text())
            title = _title(heads[0], name) if name else None
        else:
            name, (heading, inside) = _name(link.text()), _card(link)
            given = None if name or heading is None else _name(heading.text())
            name = name or given
            if name and heading is not None and (given or inside):
                title = _title(heading, name)
        if name:
            found[url] = (name, title)
    claims = Counter(name.casefold() for name, _ in found.values())
    return [(name, title, url) for url, (name, title) in found.items() if claims[name.casefold()] == 1]


@F.pandas_udf(FOUND)
def people(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [dict(zip(("full_name", "title", "url"), p)) for p in people_of(h)])
