"""URLs: one canonical spelling of an address."""

from __future__ import annotations

import re
from urllib.parse import quote_plus, unquote_plus, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import strip

# Query parameters that only track where a visitor came from.
TRACKING = {
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
    "ref", "cmp", "at_medium", "at_campaign", "ocid", "cid",
}

#: Scheme, host, path and query of any address; what follows is the fragment.
_PARTS = re.compile(r"(?s)(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")
#: Addresses of a plain host whose query needs no decoding: built-in functions suffice for them.
_PLAIN = r"^[hH][tT][tT][pP][sS]?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[!\"$-.0->@-~/]*)?(?:\?[A-Za-z0-9_.~=&-]*)?(?:#[!-~]*)?$"


def _kept(query: str) -> str:
    """The parameters with a value that don't track, in their order, encoded one way."""
    pairs = (map(unquote_plus, piece.partition("=")[::2]) for piece in query.split("&"))
    return "&".join(f"{quote_plus(name)}={quote_plus(value)}" for name, value in pairs if value and name.lower() not in TRACKING)


def canonical(url: str | None) -> str | None:
    """Scheme and host in lower case; no tracking or blank parameters, closing slash or fragment.

    NULL stays NULL; an address whose host has an open bracket is returned trimmed.
    """
    if url is None:
        return None
    url = url.strip()
    scheme, host, path, query = _PARTS.match(url.translate(dict.fromkeys(map(ord, "\t\r\n")))).groups(default="")
    if host.count("[") != host.count("]"):
        return url
    scheme, path, query = scheme.lower(), path.rstrip("/") or "/", _kept(query)
    before = f"//{host.lower()}" if host or scheme in ("http", "https") and path[0] == "/" else ""
    return (scheme and f"{scheme}:") + before + path + (query and f"?{query}")


@F.pandas_udf(T.StringType())
def _canonical(urls: pd.Series) -> pd.Series:
    return urls.map(canonical, na_action="ignore").astype(object)


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            return urljoin(b or "", x) if x else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def canonical_url(c: Column) -> Column:
    """As ``canonical``: by built-in functions for plain addresses; only others, as a rule few, go to Python."""
    c = strip(c)
    plain = F.coalesce(c.rlike(_PLAIN), F.lit(False))
    address = F.regexp_replace(c, r"[?#].*$", "")
    where = F.concat(F.lower(F.regexp_extract(address, "^[^/]*//[^/]*", 0)), F.lit("/"), F.regexp_extract(address, "^[^/]*//[^/]*/(.*?)/*$", 1))
    pairs = F.filter(
        F.split(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), "&"),
        lambda p: p.rlike("=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(*sorted(TRACKING)),
    )
    # a second equals sign belongs to the value, where it is encoded
    kept = F.transform(pairs, lambda p: F.concat(F.substring_index(p, "=", 1), F.lit("="), F.replace(F.regexp_extract(p, "^[^=]*=(.*)$", 1), F.lit("="), F.lit("%3D"))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(plain, F.concat(where, query)).otherwise(_canonical(F.when(~plain, c)))


def join_url(base: Column, link: Column) -> Column:
    return _joined(base, link)


def https_only(c: Column) -> Column:
    return F.when(c.startswith("https://"), c)
