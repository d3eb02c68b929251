"""Functions that need Unicode tables, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks, case folded."""
    plain = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return text.map(lambda s: None if s is None else plain(s))


@F.pandas_udf(T.StringType())
def idna(host: pd.Series) -> pd.Series:
    """Hosts in ASCII, or null where they cannot be."""

    def one(h):
        if h is None:
            return None
        try:
            return h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return host.map(one)


@F.pandas_udf(T.StringType())
def resolve_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Links as absolute URLs, or null where they cannot be resolved."""
    from urllib.parse import urljoin

    def one(b, h):
        try:
            return urljoin(b or "", h or "") or None
        except ValueError:
            return None

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolve_links(base: pd.Series, links: pd.Series) -> pd.Series:
    """A page's links as absolute URLs, in order; those that cannot be resolved are left out."""
    from urllib.parse import urljoin

    def all_of(b, found):
        out = []
        for h in found if found is not None else ():
            try:
                out.append(urljoin(b or "", h or ""))
            except ValueError:
                continue
        return [u for u in out if u]

    return pd.Series([all_of(b, found) for b, found in zip(base, links)], dtype=object)
