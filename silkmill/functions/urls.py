"""URL columns: parts, validity, kind.

Patterns avoid what Java and RE2 read differently: ``\\b``, ``\\s`` and ``$``.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
EXTENSION = r"(\.[^./]*)\z"


def scheme(url: Column) -> Column:
    """Lower-case scheme, or the empty string."""
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def host(url: Column) -> Column:
    """Host with its port, without user information; empty if there is none."""
    return F.regexp_extract(url, HOST, 1)


def path(url: Column) -> Column:
    """Path of an absolute URL."""
    return F.regexp_extract(url, PATH, 1)


def extension(url: Column) -> Column:
    """From the last dot of the whole URL's last segment, query included."""
    return F.regexp_extract(url, EXTENSION, 1)


def invalid_reason(url: Column) -> Column:
    """Why a URL can't be crawled; null if it can."""
    return (
        F.when(scheme(url) == "", "missing_scheme")
        .when(~scheme(url).isin("http", "https"), "unsupported_scheme")
        .when(host(url) == "", "missing_host")
    )


def is_valid(url: Column) -> Column:
    """http or https, with a host."""
    return scheme(url).isin("http", "https") & (host(url) != "")


def normalised(url: Column) -> Column:
    """``https://`` before a URL without a scheme."""
    return F.when(F.contains(url, F.lit("://")), url).otherwise(F.concat(F.lit("https://"), url))


def is_javascript(url: Column) -> Column:
    """JavaScript by extension, or by extension before a query."""
    low = F.lower(url)
    return low.rlike(r"\.(?:js|mjs|jsx)(?:\z|\?)")


def is_resource(url: Column) -> Column:
    """A script resource, exempt from the depth limit: .js or .mjs, or a typical path."""
    low = F.lower(url)
    return low.rlike(r"\.m?js(?:\z|\?)|/js/|/javascript/|/scripts/|\.min\.js")


def resolved_raw(base: Column, ref: Column) -> Column:
    """A reference that is absolute or begins with ``/``, as is; null for other relative ones."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
        .when(F.startswith(ref, F.lit("//")), F.concat(scheme(base), F.lit(":"), ref))
        .when(F.startswith(ref, F.lit("/")), F.concat(origin, ref))
    )


def _resolve(base: str | None, ref: str | None) -> str | None:
    if base is None or ref is None:
        return None
    try:
        return quote(urljoin(base, ref), safe="%!#$&'()*+,/:;=?@[]~-._|{}^`\\\"<>")
    except ValueError:
        return None


def resolve(base: Column, ref: Column) -> Column:
    """Any reference against its base; bytes beyond ASCII and spaces are percent-encoded."""

    @F.pandas_udf("string")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bases, refs in parts:
            yield pd.Series([_resolve(b, r) for b, r in zip(bases, refs, strict=True)], dtype=object)

    return of(base, ref)
