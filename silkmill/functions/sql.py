"""The operators for SQL text: a table function for links, and scalar functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from silkmill.functions import urls
from silkmill.operators.extract import page_rows

#: Scalar functions by name: arguments, result, and the expression.
SCALARS = {
    "url_scheme": ("u STRING", "STRING", f"lower(regexp_extract(u, r'{urls.SCHEME}', 1))"),
    "url_host": ("u STRING", "STRING", f"regexp_extract(u, r'{urls.HOST}', 1)"),
    "url_extension": ("u STRING", "STRING", f"regexp_extract(u, r'{urls.EXTENSION}', 1)"),
    "is_javascript_url": ("u STRING", "BOOLEAN", r"lower(u) RLIKE r'\.(?:js|mjs|jsx)(?:\z|\?)'"),
    "is_javascript_resource": ("u STRING", "BOOLEAN", r"lower(u) RLIKE r'\.m?js(?:\z|\?)|/js/|/javascript/|/scripts/|\.min\.js'"),
    "content_hash": ("body BINARY", "STRING", "sha2(body, 256)"),
}


@udtf(returnType="tag string, pos int, href string, link string")
class ExtractLinks:
    """``extract_links(html, url)``: every anchor and script of a page, resolved; null gives none."""

    def eval(self, html: str | None, url: str | None) -> Iterator[tuple]:
        yield from page_rows(html, url)


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session, as temporary ones.

    ``SELECT p.url, l.link FROM pages p, LATERAL extract_links(p.html, p.url) l WHERE is_javascript_url(l.link)``
    """
    spark.udtf.register("extract_links", ExtractLinks)
    for name, (given, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
