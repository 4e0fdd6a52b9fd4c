"""Links and scripts of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silkmill.functions.urls import _resolve, is_javascript

#: Tags whose attributes are read.
PARSED = frozenset({"a", "base", *HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"})
TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
#: Shorter inline scripts are of no interest.
INLINE_BYTES = 100


class _Page(HTMLParser):
    """First href of every ``a``, src of every ``script``, code of scripts without a src, and the page's base."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[str, str]] = []
        self.inline: list[str] = []
        self.base: str | None = None
        self.code: list[str] | None = None

    def parse_starttag(self, i: int) -> int:
        """Where a tag ends; attributes are read of those tags only that matter here, or that begin what is no markup."""
        name = TAG_NAME.match(self.rawdata, i + 1)
        if name and name.group().lower() not in PARSED:
            return self.check_for_whole_start_tag(i)
        return super().parse_starttag(i)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        wanted = {"a": "href", "script": "src", "base": "href"}.get(tag)
        value = next((v for k, v in attrs if k == wanted and v is not None), None)
        if tag == "script" and all(k != "src" for k, _ in attrs):
            self.code = []
        if value is None:
            return
        if tag == "base":
            self.base = self.base or value
        else:
            self.found.append((tag, value))

    def handle_data(self, data: str) -> None:
        if self.code is not None:
            self.code.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script":
            self.end_script()

    def end_script(self) -> None:
        if self.code is not None:
            self.inline.append("".join(self.code))
            self.code = None


def _parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    if page.code is not None:  # a script that the page does not close
        page.handle_data(page.rawdata)
        page.end_script()
    return page


def inline_scripts(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, pos, code`` of scripts without a ``src`` and over ``INLINE_BYTES`` of code; ``pos`` counts all of the page."""
    kind = pages.schema[key].dataType.simpleString()

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, x) for k, h in zip(pdf["k"], pdf["h"], strict=True) for n, x in enumerate(_parsed(h).inline)]
            yield pd.DataFrame(rows, columns=["k", "pos", "code"])

    out = pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(of, f"k {kind}, pos int, code string")
    return out.where(F.octet_length("code") > INLINE_BYTES).withColumnRenamed("k", key)


def page_rows(html: str | None, url: str | None) -> list[tuple[str, int, str, str | None]]:
    """Tag, place, reference and link of a page's anchors, then of its scripts."""
    page = _parsed(html)
    base = _resolve(url, page.base) if page.base else url
    ordered = sorted(enumerate(page.found), key=lambda x: (x[1][0] != "a", x[0]))
    return [(tag, n, href, _resolve(base, href)) for n, (_, (tag, href)) in enumerate(ordered)]


def links(pages: DataFrame, key: str | tuple[str, ...] = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, tag, pos, href, link``: every anchor and script of a page, resolved; ``key`` may be several columns.

    Null pages have no links; broken HTML gives what can be read of it.
    """
    keys = (key,) if isinstance(key, str) else key
    own = [f"k{n}" for n in range(len(keys))]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for u, h, *k in zip(pdf["u"], pdf["h"], *[pdf[c] for c in own], strict=True):
                rows += [(*k, u, *x) for x in page_rows(h, u)]
            yield pd.DataFrame(rows, columns=[*own, "url", "tag", "pos", "href", "link"])

    rows = pages.select(*[F.col(c).alias(k) for c, k in zip(keys, own, strict=True)], F.col(url).alias("u"), F.col(html).alias("h"))
    kinds = ", ".join(f"{k} {pages.schema[c].dataType.simpleString()}" for c, k in zip(keys, own, strict=True))
    out = rows.mapInPandas(of, f"{kinds}, url string, tag string, pos int, href string, link string")
    return out.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Different absolute http(s) links of each page: anchors, then scripts, without fragments."""
    found = links(pages, key, url, html).withColumn("link", F.regexp_replace("link", r"#.*\z", ""))
    found = found.where(F.col("link").rlike("^https?://"))
    return found.groupBy(key, "link").agg(F.min("pos").alias("pos")).withColumn("is_script", is_javascript(F.col("link")))
