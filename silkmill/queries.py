"""Registered queries for the crawl operators, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silkmill.functions import cleanup, detect, headers, sql, urls
from silkmill.operators import crawl, dedupe, extract, frontier, paths, registry, similarity, stats
from silkmill.operators.graph import materialise
from silkmill.plans import assets, reports
from silkmill.session import scratch, shared_folder, stored
from silkmill.sources import archive
from silkmill.sources.config import CrawlConfig
from silkmill.sources.url_list import valid_urls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL if there is any."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Variants of every page's URL, so that scripts, other schemes and missing parts occur.
_VARIANTS_SQL = """variants AS (
  SELECT page_id, unnest([0,1,2,3,4,5,6,7]) AS v, unnest([url, url || '.js', url || '/static/App.MIN.js?v=1.0',
    regexp_replace(url, '^[a-z]+', 'ftp'), regexp_replace(url, '^[a-z]+://', ''), 'https://user:pw@' || regexp_replace(url, '^[a-z]+://', ''),
    'https:///' || page_id, regexp_replace(url, '^([a-z]+://[^/?#]*).*', '\\1:8080/a.b/c.mjs')]) AS u FROM pages)"""


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    bare = F.regexp_replace(url, "^[a-z]+://", "")
    every = [
        url, F.concat(url, F.lit(".js")), F.concat(url, F.lit("/static/App.MIN.js?v=1.0")), F.regexp_replace(url, "^[a-z]+", "ftp"),
        bare, F.concat(F.lit("https://user:pw@"), bare), F.concat(F.lit("https:///"), F.col("page_id").cast("string")),
        F.regexp_replace(url, "^([a-z]+://[^/?#]*).*", "$1:8080/a.b/c.mjs"),
    ]
    return _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*every)).alias("v", "u"))


_HOST = r"regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)"
_SCHEME = r"lower(regexp_extract({0}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


@query(f"""WITH {_VARIANTS_SQL} SELECT page_id, v, CASE WHEN {_SCHEME.format('u')} = '' THEN 'missing_scheme'
  WHEN {_SCHEME.format('u')} NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN {_HOST.format('u')} = '' THEN 'missing_host' END AS reason FROM variants""")
def url_validate(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.invalid_reason(F.col("u")).alias("reason"))


@query(f"WITH {_VARIANTS_SQL} SELECT page_id, v, {_SCHEME.format('u')} AS scheme, {_HOST.format('u')} AS host FROM variants")
def url_host(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.scheme(F.col("u")).alias("scheme"), urls.host(F.col("u")).alias("host"))


@query(rf"WITH {_VARIANTS_SQL} SELECT page_id, v, regexp_extract(u, '(\.[^./]*)$', 1) AS extension FROM variants")
def url_extension(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.extension(F.col("u")).alias("extension"))


@query(f"WITH {_VARIANTS_SQL} SELECT page_id, v, CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END AS url FROM variants")
def url_normalise(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.normalised(F.col("u")).alias("url"))


@query(f"""WITH {_VARIANTS_SQL} SELECT page_id, v, (lower(u) LIKE '%.js' OR lower(u) LIKE '%.mjs' OR lower(u) LIKE '%.jsx'
  OR contains(lower(u), '.js?') OR contains(lower(u), '.mjs?') OR contains(lower(u), '.jsx?')) AS is_js FROM variants""")
def js_url_class(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.is_javascript(F.col("u")).alias("is_js"))


@query(f"""WITH {_VARIANTS_SQL} SELECT page_id, v, (lower(u) LIKE '%.js' OR lower(u) LIKE '%.mjs' OR contains(lower(u), '.js?') OR contains(lower(u), '.mjs?')
  OR contains(lower(u), '/js/') OR contains(lower(u), '/javascript/') OR contains(lower(u), '/scripts/') OR contains(lower(u), '.min.js')) AS is_js_resource FROM variants""")
def js_resource_class(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.is_resource(F.col("u")).alias("is_js_resource"))


@query(f"""WITH {_VARIANTS_SQL}, lines AS (SELECT page_id * 8 + v AS pos, CASE WHEN v = 4 THEN '# ' || u WHEN v = 7 THEN '   ' ELSE '  ' || u || ' ' END AS line FROM variants)
  SELECT pos, trim(line) AS url FROM lines WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')
  AND {_SCHEME.format('trim(line)')} IN ('http', 'https') AND {_HOST.format('trim(line)')} <> ''""")
def url_list_scan(spark, sf_dir):
    u = F.col("u")
    line = F.when(F.col("v") == 4, F.concat(F.lit("# "), u)).when(F.col("v") == 7, "   ").otherwise(F.concat(F.lit("  "), u, F.lit(" ")))
    return valid_urls(_variants(spark, sf_dir).select((F.col("page_id") * 8 + F.col("v")).alias("pos"), line.alias("line")))


_KEYWORDS = " + ".join(
    f"(CASE WHEN regexp_matches(left(hex(encode(html)), 2048), '^(..)*' || hex(encode('{k}'))) THEN 1 ELSE 0 END)" for k in detect.KEYWORDS
)


@query(f"SELECT page_id, {_KEYWORDS} AS hits FROM pages")
def js_keyword_count(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", detect.keyword_count(F.col("html")).alias("hits"))


@query(f"""SELECT page_id, (contains(lower(CASE page_id % 3 WHEN 0 THEN 'Text/JavaScript; charset=utf-8' WHEN 1 THEN 'text/html' END), 'javascript')
  IS TRUE OR {_KEYWORDS} >= 2) AS is_js FROM pages""")
def js_content(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "Text/JavaScript; charset=utf-8").when(F.col("page_id") % 3 == 1, "text/html")
    return _t(spark, sf_dir, "pages").select("page_id", detect.is_javascript_content(kind, F.col("html")).alias("is_js"))


_FILES_SQL = """files AS (SELECT source AS target, CASE WHEN doc_id % 2 = 0 THEN 'static' ELSE 'dynamic' END AS mode, doc_id AS seq,
  'https://cdn.example.com/' || source || '/' || doc_id || '.js' AS url, sha256(text) AS hash, strlen(text) AS size FROM documents),
  marked AS (SELECT *, row_number() OVER (PARTITION BY target, hash ORDER BY CASE mode WHEN 'static' THEN 0 ELSE 1 END, seq) > 1 AS is_duplicate FROM files)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as script files: source is the target, even ids are static."""
    doc_id = F.col("doc_id")
    return _t(spark, sf_dir, "documents").select(
        F.col("source").alias("target"), F.when(doc_id % 2 == 0, "static").otherwise("dynamic").alias("mode"), doc_id.alias("seq"),
        F.concat(F.lit("https://cdn.example.com/"), "source", F.lit("/"), doc_id.cast("string"), F.lit(".js")).alias("url"),
        dedupe.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"),
    )


@query(f"WITH {_FILES_SQL} SELECT target, mode, seq, hash, size, is_duplicate FROM marked")
def hash_first_wins(spark, sf_dir):
    return dedupe.mark_duplicates(_files(spark, sf_dir)).select("target", "mode", "seq", "hash", "size", "is_duplicate")


@query(f"WITH {_FILES_SQL} SELECT hash, count(*) AS n, min(url) AS first, max(size) * (count(*) - 1) AS saved FROM files GROUP BY hash HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return dedupe.duplicate_groups(_files(spark, sf_dir))


@query(f"WITH {_FILES_SQL} SELECT seq, hash FROM files WHERE mode = 'dynamic' AND hash IN (SELECT hash FROM files WHERE mode = 'static')")
def cross_mode_overlap(spark, sf_dir):
    return dedupe.cross_mode(_files(spark, sf_dir)).select("seq", "hash")


@query("""WITH e AS (SELECT event_type AS target, CASE WHEN user_id % 2 = 0 THEN 'static' ELSE 'dynamic' END AS mode, 'u' || user_id AS url, event_id AS seq FROM events)
  SELECT target, mode, url, min(seq) AS seq FROM e GROUP BY target, mode, url""")
def url_first_wins(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(
        F.col("event_type").alias("target"), F.when(F.col("user_id") % 2 == 0, "static").otherwise("dynamic").alias("mode"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.col("event_id").alias("seq"),
    )
    return dedupe.first_by_url(e).select("target", "mode", "url", "seq")


# A text with every sign that the rules look for, made from a document.
_CODE_SQL = """code AS (SELECT doc_id, text || CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN repeat(' 0x1F;', CAST(doc_id % 20 AS INT)) WHEN 2 THEN repeat('\\x41\\u0042', CAST(doc_id % 5 AS INT))
  WHEN 3 THEN ' eval  (a)' WHEN 4 THEN ' a[''push''](b)' ELSE repeat(' xx = y;', CAST(doc_id % 9 AS INT)) END AS code FROM documents)"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")

    def many(text: str, n: int):
        return F.repeat(F.lit(text), (d % n).cast("int"))

    tail = (
        F.when(d % 6 == 0, "").when(d % 6 == 1, many(" 0x1F;", 20)).when(d % 6 == 2, many("\\x41\\u0042", 5))
        .when(d % 6 == 3, " eval  (a)").when(d % 6 == 4, " a['push'](b)").otherwise(many(" xx = y;", 9))
    )
    return _t(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("code"))


_OBF = {
    "singles": r"len(regexp_extract_all(code, '\b[a-zA-Z]\b'))",
    "hexes": "len(regexp_extract_all(code, '0x[0-9a-fA-F]+'))",
    "escs": r"len(regexp_extract_all(code, '\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}'))",
    "evals": r"regexp_matches(code, '\beval\s*\(|Function\s*\(')",
    "marks": r"regexp_matches(code, '_0x[0-9a-f]+|\[''push''\]|\[''length''\]|String\[''fromCharCode')",
}


@query(f"WITH {_CODE_SQL} SELECT doc_id, {_OBF['singles']} AS n, coalesce({_OBF['singles']} / nullif(strlen(code), 0) > 0.01, false) AS many FROM code")
def obf_single_letters(spark, sf_dir):
    c = F.col("code")
    return _code(spark, sf_dir).select("doc_id", detect.single_letters(c).alias("n"), detect.many_single_letters(c).alias("many"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, {_OBF['hexes']} AS hexes, {_OBF['escs']} AS escapes FROM code")
def obf_hex_escapes(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", detect.hex_numbers(F.col("code")).alias("hexes"), detect.escapes(F.col("code")).alias("escapes"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, {_OBF['evals']} AS builds_code, {_OBF['marks']} AS tool_marks FROM code")
def obf_eval_marks(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", detect.builds_code(F.col("code")).alias("builds_code"), detect.has_tool_marks(F.col("code")).alias("tool_marks"))


@query(f"""WITH {_CODE_SQL} SELECT doc_id, ({_OBF['marks']} OR {_OBF['evals']} OR {_OBF['escs']} > 5 OR {_OBF['hexes']} > 10
  OR coalesce({_OBF['singles']} / nullif(strlen(code), 0) > 0.01, false)) AS is_obfuscated FROM code""")
def is_obfuscated(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", detect.is_obfuscated(F.col("code")).alias("is_obfuscated"))


@query(r"SELECT doc_id, sha256(regexp_replace(replace(text, '. ', chr(10) || chr(10) || chr(10)), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents")
def newline_collapse(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(". "), F.lit("\n\n\n"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(cleanup.fewer_newlines(text), 256).alias("h"))


def _spaced_sql(code: str) -> str:
    for sign in cleanup.OPERATORS:
        code = rf"regexp_replace({code}, '\s*\{sign}\s*', ' {sign} ', 'g')"
    return code


@query(f"WITH {_CODE_SQL} SELECT doc_id, sha256({_spaced_sql('code')}) AS h FROM code")
def operator_format(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.sha2(cleanup.spaced_operators(F.col("code")), 256).alias("h"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, sha256(replace(code, '0x1F', '31')) AS h FROM code")
def hex_to_decimal(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.sha2(cleanup.hex_to_decimal(F.col("code")), 256).alias("h"))


@query(f"WITH {_CODE_SQL} SELECT doc_id, sha256(replace(replace(code, '\\x41', 'A'), '\\u0042', 'B')) AS h FROM code")
def escape_decode(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.sha2(cleanup.decode_escapes(F.col("code")), 256).alias("h"))


_CLEAN = _spaced_sql(
    r"regexp_replace(replace(replace(replace(code, '0x1F', '31'), '\x41', 'A'), '\u0042', 'B'), '\n{3,}', chr(10) || chr(10), 'g')"
)


@query(f"WITH {_CODE_SQL} SELECT doc_id, sha256({_CLEAN}) AS h FROM code")
def cleanup_all(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.sha2(cleanup.cleaned(F.col("code")), 256).alias("h"))


# Numbers and escapes that differ from document to document: names that look like numbers, 63-bit limits, escapes that make escapes, surrogates.
_VARIED_SQL = r"""v AS (SELECT doc_id, 'x=0x' || printf('%x', doc_id * 7919) || ';_0x' || printf('%x', doc_id) || ' 0x7fffffffffffffff 0x8000000000000000 0x' || repeat('0', doc_id % 30) || 'F ' ||
    '\x' || printf('%02x', 32 + doc_id % 95) || '\u' || printf('%04X', (doc_id * 37) % 65536) || ' \ud83d\ude00 \x5cu0041 \x4 \u12g' AS code FROM documents),
  n AS (SELECT doc_id, string_split_regex(code, '0x[0-9a-fA-F]+') AS g, regexp_extract_all(code, '0x[0-9a-fA-F]+') AS m FROM v),
  d AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN length(ltrim(m[i][3:], '0')) > 16 OR length(ltrim(m[i][3:], '0')) = 16 AND ltrim(m[i][3:], '0') >= '8'
    THEN m[i] ELSE CAST(CAST('0x0' || ltrim(m[i][3:], '0') AS UBIGINT) AS VARCHAR) END), '') AS code FROM n),
  b AS (SELECT doc_id, string_split_regex(code, '\\x[0-9a-fA-F]{2}') AS g, regexp_extract_all(code, '\\x[0-9a-fA-F]{2}') AS m FROM d),
  e AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' ELSE chr(CAST('0x' || m[i][3:] AS INT)) END), '') AS code FROM b),
  u AS (SELECT doc_id, string_split_regex(code, '\\u[0-9a-fA-F]{4}') AS g, regexp_extract_all(code, '\\u[0-9a-fA-F]{4}') AS m FROM e),
  f AS (SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i > len(m) THEN '' WHEN upper(m[i][3:]) BETWEEN 'D800' AND 'DFFF' THEN chr(65533)
    ELSE chr(CAST('0x' || m[i][3:] AS INT)) END), '') AS code FROM u)"""


@query(f"WITH {_VARIED_SQL} SELECT doc_id, code FROM f")
def clean_varied(spark, sf_dir):
    i = F.col("doc_id")
    code = F.concat(
        F.lit("x=0x"), F.lower(F.hex(i * 7919)), F.lit(";_0x"), F.lower(F.hex(i)), F.lit(" 0x7fffffffffffffff 0x8000000000000000 0x"), F.repeat(F.lit("0"), (i % 30).cast("int")), F.lit("F "),
        F.lit("\\x"), F.lower(F.lpad(F.hex(32 + i % 95), 2, "0")), F.lit("\\u"), F.lpad(F.hex(i * 37 % 65536), 4, "0"), F.lit(" \\ud83d\\ude00 \\x5cu0041 \\x4 \\u12g"),
    )
    return _t(spark, sf_dir, "documents").select("doc_id", cleanup.decode_escapes(cleanup.hex_to_decimal(code)).alias("code"))


# Every page with more links at its end: other attributes first, single and no quotes, entities, relative and other hosts, scripts.
_MORE = (
    """<a class="b" href="/more/{0}?a=1&amp;b=2#f">x</a><A HREF='//other.example/{0}'>x</A><a href=rel{0}.html>x</a><a name="n">x</a>"""
    """<a href="mailto:a@b.example">x</a><a href="https://other.example/{0}#g">x</a><script src="/js/s{0}.mjs"></script><script defer src='//cdn.example/x.png'></script>"""
)
_HREFS = ["/more/{0}?a=1&b=2#f", "//other.example/{0}", "rel{0}.html", "mailto:a@b.example", "https://other.example/{0}#g"]
_SCRIPTS = ["/js/s{0}.mjs", "//cdn.example/x.png"]


def _filled(parts: list[str]) -> str:
    return "[" + ", ".join("replace('" + x + "', '{0}', CAST(page_id AS VARCHAR))" for x in parts) + "]"


# The pages' own anchors have one attribute in double quotes; those added are known.
_LINKS_SQL = rf"""h AS (SELECT page_id, url, list_concat(list_transform(regexp_extract_all(html, '<a [^>]*?"([^"]*?)"', 1), lambda x: replace(x, '&amp;', '&')), {_filled(_HREFS)}) AS a,
    {_filled(_SCRIPTS)} AS s FROM pages),
  links AS (SELECT page_id, url, 'a' AS tag, unnest(a) AS href, unnest(range(len(a))) AS pos FROM h
    UNION ALL SELECT page_id, url, 'script', unnest(s), unnest(range(len(s))) + len(a) FROM h)"""


def _quoted(x: str) -> str:
    """Percent-encodes what a link may not hold."""
    out = f"url_encode({x})"
    for c in "%!#$&'()*+,/:;=?@[]|{}^`\\\"<>":
        out = f"replace({out}, '%{ord(c):02X}', '{c.replace(chr(39), chr(39) * 2)}')"
    return out


_ORIGIN = r"regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)', 1)"
_FOLDER = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"
_FULL = _quoted(rf"""CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href WHEN starts_with(href, '//') THEN {_SCHEME.format('url')} || ':' || href
  WHEN starts_with(href, '/') THEN {_ORIGIN} || href ELSE {_FOLDER} || href END""")
_RESOLVED_SQL = f"{_LINKS_SQL}, r AS (SELECT *, {_FULL} AS link FROM links)"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = F.replace(F.lit(_MORE), F.lit("{0}"), F.col("page_id").cast("string"))
    return _t(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", more).alias("html"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.links(_pages(spark, sf_dir))


@query(f"WITH {_LINKS_SQL} SELECT page_id, tag, CAST(pos AS INT) AS pos, href FROM links")
def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "tag", "pos", "href")


@query(f"WITH {_RESOLVED_SQL} SELECT page_id, CAST(pos AS INT) AS pos, link FROM r")
def link_resolve(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "link")


@query(f"""WITH {_LINKS_SQL} SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN href
  WHEN starts_with(href, '//') THEN {_SCHEME.format('url')} || ':' || href WHEN starts_with(href, '/') THEN {_ORIGIN} || href END AS link FROM links""")
def link_resolve_raw(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", urls.resolved_raw(F.col("url"), F.col("href")).alias("link"))


_IS_JS = "(" + " OR ".join(f"lower(link) LIKE '%.{x}' OR contains(lower(link), '.{x}?')" for x in ("js", "mjs", "jsx")) + ")"


@query(f"""WITH {_RESOLVED_SQL}, f AS (SELECT page_id, pos, regexp_replace(link, '#.*$', '') AS link FROM r)
  SELECT page_id, link, CAST(min(pos) AS INT) AS pos, {_IS_JS} AS is_script FROM f WHERE starts_with(link, 'http://') OR starts_with(link, 'https://') GROUP BY page_id, link""")
def page_links(spark, sf_dir):
    return extract.page_links(_pages(spark, sf_dir))


@query(f"WITH {_RESOLVED_SQL} SELECT page_id, link FROM r WHERE tag = 'script' AND {_IS_JS}")
def script_links(spark, sf_dir):
    return _links(spark, sf_dir).where("tag = 'script'").where(urls.is_javascript(F.col("link"))).select("page_id", "link")


# What is added to every page: a script with a type, one with a src, one with signs of HTML inside.
_INLINE = '<script type="module">{0}</script><SCRIPT src="a.js">{0}{0}</SCRIPT><script>if (1<2 && 3>2) {} {0}</script>'


@query(r"""WITH c AS (SELECT page_id, html, repeat('var x;', CAST(page_id % 40 AS INT)) AS c FROM pages),
  s AS (SELECT page_id, list_concat(list_transform(regexp_extract_all(html, '<script>.*?</script>'), lambda x: x[9:-10]), [c, 'if (1<2 && 3>2) {} ' || c]) AS s FROM c)
  SELECT page_id, pos, strlen(code) AS size FROM (SELECT page_id, unnest(s) AS code, unnest(range(len(s)))::INT AS pos FROM s) WHERE strlen(code) > 100""")
def inline_script(spark, sf_dir):
    code = F.repeat(F.lit("var x;"), (F.col("page_id") % 40).cast("int"))
    pages = _t(spark, sf_dir, "pages").select("page_id", F.concat("html", F.replace(F.lit(_INLINE), F.lit("{0}"), code)).alias("html"))
    return extract.inline_scripts(pages).select("page_id", "pos", F.octet_length("code").cast("long").alias("size"))


@query(f"""WITH {_RESOLVED_SQL}, seen AS (SELECT DISTINCT link FROM r WHERE page_id % 7 = 0)
  SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN {_SCHEME.format('link')} NOT IN ('http', 'https') THEN 'unsupported_scheme' WHEN link IN (SELECT link FROM seen) THEN 'visited'
  WHEN page_id % 4 + 1 > 3 THEN 'too_deep' WHEN {_HOST.format('link')} <> {_HOST.format('url')} THEN 'cross_domain' END AS reason FROM r""")
def should_follow_reason(spark, sf_dir):
    r = _links(spark, sf_dir)
    seen = r.where("page_id % 7 = 0").select("link").distinct().withColumn("seen", F.lit(True))
    r = r.join(seen, "link", "left")
    reason = frontier.follow_reason(F.col("link"), F.col("page_id") % 4, F.col("seen").isNotNull(), 3, urls.host(F.col("url")))
    return r.select("page_id", "pos", reason.alias("reason"))


@query(f"""WITH {_RESOLVED_SQL} SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN {_SCHEME.format('link')} NOT IN ('http', 'https') THEN 'unsupported_scheme'
  WHEN {_HOST.format('link')} <> {_HOST.format('url')} THEN 'cross_domain' WHEN {_HOST.format('link')} <> 'm.ththth.example.net' THEN 'cross_domain_of_target' END AS reason FROM r""")
def two_host_rule(spark, sf_dir):
    reason = frontier.follow_on_page(F.col("link"), F.col("url"), F.lit(0), F.lit(False), 3, F.lit("m.ththth.example.net"))
    return _links(spark, sf_dir).select("page_id", "pos", reason.alias("reason"))


@query(r"""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN trim(regexp_extract('x();//# sourceMappingURL=' || CASE page_id % 3 WHEN 1 THEN 'app' || page_id || '.js.map' ELSE '' END
  || chr(10) || 'y', 'sourceMappingURL=([^\n\r ]*)', 1)) END AS ref FROM pages""")
def sourcemap_ref(spark, sf_dir):
    i = F.col("page_id")
    name = F.when(i % 3 == 1, F.concat(F.lit("app"), i.cast("string"), F.lit(".js.map"))).otherwise("")
    body = F.when(i % 3 > 0, F.concat(F.lit("x();//# sourceMappingURL="), name, F.lit("\ny"))).otherwise("x();")
    return _t(spark, sf_dir, "pages").select("page_id", cleanup.source_map_reference(body).alias("ref"))


_EDGES_SQL = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey, 's' || (l_suppkey % 50) FROM lineitem WHERE l_linenumber = 1)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _t(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    back = F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string"))
    out = item.select(s.alias("src"), p.alias("dst")).union(item.where("l_linenumber = 1").select(p, back))
    return out.distinct()


@query(f"""WITH RECURSIVE {_EDGES_SQL}, r(node, depth) AS (SELECT 's1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 3)
  SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def bfs_depth(spark, sf_dir):
    seeds = spark.createDataFrame([("s1",)], "node string")
    return frontier.expand(_edges(spark, sf_dir), seeds, 3)


@query(f"""WITH {_EDGES_SQL}, a AS (SELECT dst AS node, count(*) AS visits FROM edges WHERE src = 's1' GROUP BY dst),
  b AS (SELECT e.dst AS node, CAST(sum(a.visits) AS BIGINT) AS visits FROM edges e JOIN a ON e.src = a.node GROUP BY e.dst)
  SELECT 's1' AS node, 1 AS visits, 0 AS depth UNION ALL SELECT node, visits, 1 FROM a UNION ALL SELECT node, visits, 2 FROM b""")
def bag_visits(spark, sf_dir):
    seeds = spark.createDataFrame([("s1",)], "node string")
    return frontier.visits(_edges(spark, sf_dir), seeds, 2).select("node", "visits", "depth")


@query(f"""WITH {_RESOLVED_SQL} SELECT page_id, CAST(pos AS INT) AS pos, link FROM r
  WHERE {_SCHEME.format('link')} IN ('http', 'https') AND page_id % 4 <= 2 AND link NOT IN (SELECT link FROM r WHERE page_id % 7 = 0)""")
def frontier_push(spark, sf_dir):
    r = _links(spark, sf_dir).select("page_id", "pos", (F.col("page_id") % 4).alias("depth"), "link")
    seen = r.where("page_id % 7 = 0").select("link")
    return frontier.push(r, seen, 2, F.lit(""), cross_domain=True, url="link").select("page_id", "pos", "link")


@query(f"""WITH RECURSIVE {_EDGES_SQL}, r(node, depth) AS (SELECT 's1', 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 2),
  p AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
  SELECT '/js/' || l_returnflag || l_quantity::INT || '.js' AS node, min(depth) + 1 AS depth FROM lineitem JOIN p ON p.node = 'p' || l_partkey GROUP BY 1""")
def js_depth_exempt(spark, sf_dir):
    pages = frontier.expand(_edges(spark, sf_dir), spark.createDataFrame([("s1",)], "node string"), 2)
    name = F.concat(F.lit("/js/"), "l_returnflag", F.col("l_quantity").cast("int").cast("string"), F.lit(".js"))
    scripts = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), name.alias("dst")).distinct()
    return frontier.reached_scripts(pages, scripts)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def visited_antijoin(spark, sf_dir):
    seen = _t(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return frontier.unvisited(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), seen, "o_custkey")


@query(f"WITH {_FILES_SQL} SELECT target, mode, count(*) AS files, count(*) FILTER (is_duplicate) AS duplicates, CAST(sum(size) AS BIGINT) AS total_size FROM marked GROUP BY ALL")
def mode_stats(spark, sf_dir):
    return stats.per_mode(dedupe.mark_duplicates(_files(spark, sf_dir)))


@query(f"""WITH {_FILES_SQL} SELECT target, count(*) FILTER (mode = 'static') AS static_files, count(*) FILTER (mode = 'dynamic') AS dynamic_files,
  count(DISTINCT url) FILTER (NOT is_duplicate) AS total_files, CAST(sum(size) AS BIGINT) AS total_size FROM marked GROUP BY target""")
def merged_stats(spark, sf_dir):
    return stats.merged(dedupe.mark_duplicates(_files(spark, sf_dir)))


@query(f"WITH {_FILES_SQL} SELECT coalesce(mode, 'all') AS mode, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_size FROM files GROUP BY ROLLUP (mode)")
def rollup_stats(spark, sf_dir):
    return stats.with_totals(_files(spark, sf_dir))


@query("""SELECT event_type AS target, count(*) FILTER (CASE event_id % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END >= 400 AND user_id % 2 = 0) AS fake_http_errors FROM events GROUP BY event_type""")
def fake_http_errors(spark, sf_dir):
    status = F.when(F.col("event_id") % 5 == 0, 404).when(F.col("event_id") % 5 == 1, 500).otherwise(200)
    e = _t(spark, sf_dir, "events").select(F.col("event_type").alias("target"), status.alias("status"), (F.col("user_id") % 2 == 0).alias("is_js"))
    return stats.fake_errors(e)


_RESULTS_SQL = "r AS (SELECT user_id AS batch, event_id AS pos, event_type = 'error' AS failed, 1 AS files, CAST(value * 1000000 AS BIGINT) AS size FROM events)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.round(F.col("value") * 1000000).cast("long")
    return _t(spark, sf_dir, "events").select(
        F.col("user_id").alias("batch"), F.col("event_id").alias("pos"), (F.col("event_type") == "error").alias("failed"), F.lit(1).alias("files"), size.alias("size")
    )


@query(f"""WITH {_RESULTS_SQL}, s AS (SELECT *, coalesce(sum(failed::INT) OVER (PARTITION BY batch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
  SELECT batch, pos, failed FROM s WHERE before = 0""")
def batch_stop_on_error(spark, sf_dir):
    return stats.processed(_results(spark, sf_dir), "batch", "pos", "failed").select("batch", "pos", "failed")


@query(f"""WITH {_RESULTS_SQL} SELECT batch, count(*) AS total, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed, CAST(coalesce(sum(files) FILTER (NOT failed), 0) AS BIGINT) AS files,
  CAST(coalesce(sum(size) FILTER (NOT failed), 0) AS BIGINT) AS total_size, round(coalesce(sum(size) FILTER (NOT failed), 0) / 1048576.0::DOUBLE, 2) AS total_mb FROM r GROUP BY batch""")
def batch_summary(spark, sf_dir):
    return stats.batch_summary(_results(spark, sf_dir), "batch", "failed", "files", "size")


@query("SELECT doc_id, strlen(text) BETWEEN 1 AND 52428800 AS ok FROM documents")
def size_validate(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").between(1, 52428800).alias("ok"))


@query(rf"WITH {_VARIANTS_SQL} SELECT page_id, v, regexp_extract(u, '(\.[^./]*)$', 1) IN ('.js', '.mjs', '.jsx') AS ok FROM variants")
def extension_validate(spark, sf_dir):
    return _variants(spark, sf_dir).select("page_id", "v", urls.extension(F.col("u")).isin(".js", ".mjs", ".jsx").alias("ok"))


@query(f"WITH {_CODE_SQL} SELECT count(*) FILTER ({_OBF['evals']} AND doc_id % 9 > 0) AS succeeded, count(*) FILTER (doc_id % 9 = 0) AS failed FROM code")
def cleanup_counts(spark, sf_dir):
    c = _code(spark, sf_dir).select(detect.builds_code(F.col("code")).alias("is_obfuscated"), F.when(F.col("doc_id") % 9 == 0, "failed").alias("error"))
    return stats.cleanup_counts(c)


_HEADERS_SQL = """h AS (SELECT c_custkey, unnest([0,1,2,3,4,5]) AS v, unnest(['X-Api-Key: ' || c_name, 'Authorization: Bearer ' || c_custkey, c_mktsegment || ' no colon',
  ' : ' || c_name, 'host:' || c_name || ':80', 'x_seg: ' || c_mktsegment || chr(233)]) AS line FROM customer),
  p AS (SELECT *, contains(line, ':') AS has, trim(split_part(line, ':', 1)) AS n, trim(substr(line, instr(line, ':') + 1)) AS val FROM h),
  q AS (SELECT c_custkey, v, CASE WHEN NOT has THEN 'missing_colon' WHEN n = '' THEN 'empty_name' END AS error, CASE WHEN has AND n <> '' THEN n END AS name, CASE WHEN has AND n <> '' THEN val END AS value FROM p)"""


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, name, seg = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    every = [
        F.concat(F.lit("X-Api-Key: "), name), F.concat(F.lit("Authorization: Bearer "), key), F.concat(seg, F.lit(" no colon")),
        F.concat(F.lit(" : "), name), F.concat(F.lit("host:"), name, F.lit(":80")), F.concat(F.lit("x_seg: "), seg, F.lit("\u00e9")),
    ]
    h = _t(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(*every)).alias("v", "line"))
    return h.select("c_custkey", "v", headers.parsed(F.col("line")).alias("h")).select("c_custkey", "v", "h.*")


@query(f"WITH {_HEADERS_SQL} SELECT c_custkey, v, name, value, error FROM q")
def header_parse(spark, sf_dir):
    return _headers(spark, sf_dir)


@query(f"""WITH {_HEADERS_SQL} SELECT c_custkey, v, CASE WHEN lower(name) IN ('host', 'content-length', 'transfer-encoding', 'connection') THEN 'forbidden_name'
  WHEN NOT regexp_full_match(name, '[A-Za-z0-9-]+') THEN 'bad_name' WHEN strlen(value) > 8192 THEN 'value_too_long' WHEN NOT regexp_full_match(value, '[\\x20-\\x7E\\t]*') THEN 'bad_value' END AS problem
  FROM q WHERE error IS NULL""")
def header_validate(spark, sf_dir):
    h = _headers(spark, sf_dir).where("error IS NULL")
    return h.select("c_custkey", "v", headers.problem(F.col("name"), F.col("value")).alias("problem"))


@query(f"""WITH {_HEADERS_SQL} SELECT c_custkey, v, CASE WHEN NOT regexp_matches(lower(name), 'authorization|token|key|secret|password|credential|api-key') THEN value
  WHEN starts_with(value, 'Bearer ') THEN 'Bearer ***' WHEN strlen(value) > 8 THEN left(value, 4) || '***' || right(value, 4) ELSE '***' END AS safe FROM q WHERE error IS NULL""")
def header_redact(spark, sf_dir):
    h = _headers(spark, sf_dir).where("error IS NULL")
    return h.select("c_custkey", "v", headers.redacted(F.col("name"), F.col("value")).alias("safe"))


@query("""SELECT c_custkey, unnest(['Accept', 'Accept-Encoding', 'User-Agent', 'X-Seg']) AS name, unnest([CASE WHEN c_nationkey % 2 = 0 THEN 'text/html' ELSE '*/*' END, 'gzip, deflate, br',
  CASE WHEN c_nationkey % 3 = 0 THEN 'cli' WHEN c_nationkey % 2 = 0 THEN 'conf' ELSE 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36' END, c_mktsegment]) AS value FROM customer""")
def header_merge(spark, sf_dir):
    n, none = F.col("c_nationkey"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    conf = F.when(n % 2 == 0, F.create_map(F.lit("accept"), F.lit("text/html"), F.lit("USER-AGENT"), F.lit("conf"))).otherwise(none)
    cli = F.when(n % 3 == 0, F.create_map(F.lit("user-agent"), F.lit("cli"), F.lit("x-seg"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("X-SEG"), F.col("c_mktsegment")))
    merged = headers.overlay(headers.defaults(), conf, cli)
    return _t(spark, sf_dir, "customer").select("c_custkey", F.explode(merged).alias("name", "value"))


@query("SELECT c_custkey, 'Accept: */*, X-Api-Key: ' || left(c_name, 4) || '***' || right(c_name, 4) AS text FROM customer")
def header_text(spark, sf_dir):
    m = F.create_map(F.lit("X-Api-Key"), F.col("c_name"), F.lit("Accept"), F.lit("*/*"))
    return _t(spark, sf_dir, "customer").select("c_custkey", headers.redacted_text(m).alias("text"))


# The messages, as in silkmill.functions.headers.
@query(f"""WITH {_HEADERS_SQL} SELECT c_custkey, v, CASE WHEN lower(name) = 'host' THEN '头部验证失败 [' || name || ']: 此头部由HTTP客户端自动管理,不允许自定义 (建议: 移除 ''' || name || ''' 头部配置)'
  WHEN v = 5 THEN '头部验证失败 [x_seg]: 头部名称包含非法字符 (仅允许字母、数字和连字符) (建议: 使用字母、数字和连字符 (如 ''User-Agent'', ''X-Custom-Header''))' END AS message FROM q WHERE error IS NULL""")
def header_error_text(spark, sf_dir):
    h = _headers(spark, sf_dir).where("error IS NULL")
    return h.select("c_custkey", "v", headers.problem_text(F.col("name"), F.col("value")).alias("message"))


_PATHS_SQL = """f AS (SELECT event_type AS target, event_id AS seq, 'https://h' || (user_id % 5) || '.example.com' || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/' ELSE '/js/m' || (user_id % 20) || '.js?v=' || event_id END AS url FROM events),
  n AS (SELECT *, regexp_extract(url, '^https://([^/?#]*)', 1) AS host, CASE event_id_mod WHEN 0 THEN 'index.js' WHEN 1 THEN '/' ELSE regexp_extract(url, '([^/?]*)\\?', 1) END AS name FROM (SELECT *, seq % 4 AS event_id_mod FROM f)),
  k AS (SELECT *, row_number() OVER (PARTITION BY target, host, name ORDER BY seq) - 1 AS i FROM n)"""


_PATHS_SELECT = f"""WITH {_PATHS_SQL} SELECT target, seq, 'out/' || target || '/encode/js/' || host ||
  CASE name WHEN '/' THEN {{root}} ELSE '/' || CASE WHEN i = 0 THEN name ELSE replace(name, '.js', '') || '_' || i || '.js' END END AS file_path FROM k"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    tail = F.when(i % 4 == 0, "").when(i % 4 == 1, "/").otherwise(F.concat(F.lit("/js/m"), (u % 20).cast("string"), F.lit(".js?v="), i.cast("string")))
    url = F.concat(F.lit("https://h"), (u % 5).cast("string"), F.lit(".example.com"), tail)
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("target"), i.alias("seq"), url.alias("url"))


@query(_PATHS_SELECT.format(root="''"))
def file_path_numbered(spark, sf_dir):
    return paths.numbered_paths(_urls(spark, sf_dir), "out", "encode/js").select("target", "seq", "file_path")


# Names of which some are like another one's number; the oracle hands out paths one after the other, family by family.
@query("""WITH RECURSIVE f AS (SELECT event_type AS target, event_id AS seq, 'h' || (user_id % 3) AS host, 'm' || (user_id % 4) AS family, list_value('', '', '_1', '_2', '_1_1', '_3', '_01')[event_id % 7 + 1] AS tail FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY target, host, family ORDER BY seq) AS i FROM f),
  r(target, host, family, i, seq, path, taken) AS (SELECT DISTINCT target, host, family, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, []::VARCHAR[] FROM n
    UNION ALL SELECT n.target, n.host, n.family, n.i, n.seq, p, list_append(taken, p) FROM (SELECT n.*, taken, list_filter(list_concat([n.family || tail || '.js'],
      list_transform(range(1, len(taken) + 1), lambda k: n.family || tail || '_' || k || '.js')), lambda x: NOT list_contains(taken, x))[1] AS p
    FROM r JOIN n ON n.target = r.target AND n.host = r.host AND n.family = r.family AND n.i = r.i + 1) n)
  SELECT target, seq, 'out/' || target || '/encode/js/' || host || '/' || path AS file_path FROM r WHERE i > 0""")
def file_path_greedy(spark, sf_dir):
    tails = F.array(*[F.lit(x) for x in ("", "", "_1", "_2", "_1_1", "_3", "_01")])
    i, u = F.col("event_id"), F.col("user_id")
    url = F.concat(F.lit("https://h"), (u % 3).cast("string"), F.lit("/m"), (u % 4).cast("string"), F.get(tails, (i % 7).cast("int")), F.lit(".js?"), i.cast("string"))
    files = _t(spark, sf_dir, "events").select(F.col("event_type").alias("target"), i.alias("seq"), url.alias("url"))
    return paths.greedy_paths(files, "out", "encode/js").select("target", "seq", "file_path")


@query("""SELECT doc_id, 'out/' || source || '/decode/js/h/encode/js/' || doc_id || '.js' AS path FROM documents""")
def decode_path(spark, sf_dir):
    path = F.concat(F.lit("out/"), "source", F.lit("/encode/js/h/encode/js/"), F.col("doc_id").cast("string"), F.lit(".js"))
    return _t(spark, sf_dir, "documents").select("doc_id", cleanup.decode_path(path).alias("path"))


@query(f"""WITH {_FILES_SQL} SELECT seq, url, hash, size, mode AS crawl_mode FROM marked WHERE NOT is_duplicate""")
def success_files(spark, sf_dir):
    f = dedupe.mark_duplicates(_files(spark, sf_dir)).where("NOT is_duplicate")
    return f.select("seq", "url", "hash", "size", F.col("mode").alias("crawl_mode"))


# Responses made of pages: scripts, each third one with a page's content; their maps, with and without success.
_RESPONSES_SQL = "resp AS (SELECT page_id, 'https://a.example/' || (page_id % 90) || '.js' AS url, page_id % 3 = 0 AS bad, page_id % 5 AS t FROM pages)"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    target, n = F.concat(F.lit("t"), (i % 5).cast("string")), (i % 90).cast("string")
    code = F.concat(F.lit("var a; function f() {} // "), i.cast("string"), F.lit("\n//# sourceMappingURL=m/"), (i % 30).cast("string"), F.lit(".js.map\n"))
    body = F.when(i % 3 == 0, F.lit("<p>nothing here</p>")).otherwise(code)
    p = _t(spark, sf_dir, "pages")
    js = p.select(target.alias("target_url"), F.concat(F.lit("https://a.example/"), n, F.lit(".js")).alias("url"), i.alias("seq"), F.lit(200).alias("status"), body.cast("binary").alias("body"))
    maps = p.select(
        target, F.concat(F.lit("https://a.example/m/"), (i % 30).cast("string"), F.lit(".js.map")), i + 1_000_000_000,
        F.when(i % 2 == 0, 200).otherwise(404), F.concat(F.lit("map "), i.cast("string")).cast("binary"),
    )
    more = [F.lit(0).alias("depth"), F.lit("static").alias("mode"), F.lit("text/plain").alias("content_type"), F.lit(None).cast("string").alias("content_encoding")]
    return js.union(maps).select("*", *more)


@query(f"""WITH {_RESPONSES_SQL} SELECT 't' || t AS target, url, 'download_failed' AS error_type, '下载失败' AS error_msg, 0 AS retries FROM resp WHERE bad""")
def failed_files(spark, sf_dir):
    return assets.failed_files(_responses(spark, sf_dir))


@query(f"""WITH {_RESPONSES_SQL}, js AS (SELECT DISTINCT ON (t, url) t, url, page_id % 30 AS m FROM resp WHERE NOT bad ORDER BY t, url, page_id),
  asked AS (SELECT t, 'https://a.example/m/' || m || '.js.map' AS url, min(url) AS js_file_url FROM js GROUP BY ALL),
  got AS (SELECT DISTINCT ON (t, url) page_id % 5 AS t, 'https://a.example/m/' || (page_id % 30) || '.js.map' AS url, 'map ' || page_id AS body FROM pages WHERE page_id % 2 = 0 ORDER BY t, url, page_id)
  SELECT 't' || t AS target, url, js_file_url, strlen(body) AS size, sha256(body) AS hash, 'output/t' || t || '/encode/map/a.example/' || regexp_extract(url, '[^/]*$') AS file_path FROM asked JOIN got USING (t, url)""")
def source_map_files(spark, sf_dir):
    r = _responses(spark, sf_dir)
    return assets.source_map_files(assets.script_files(r), r).select("target", "url", "js_file_url", "size", "hash", "file_path")


# Responses of both modes with equal numbers of arrival, null targets, URLs that come again and repeated rows.
_CAPTURES_SQL = f"""r AS (SELECT DISTINCT CASE WHEN doc_id % 11 > 0 THEN 't' || doc_id % 3 END AS target, CASE WHEN doc_id % 2 = 0 THEN 'static' ELSE 'dynamic' END AS mode, doc_id // 2 AS seq,
    'https://a.example/' || (doc_id % 4) || '/' || (doc_id % 25) || '.js' AS url, 'var aa = 0x1F; ' || CASE WHEN doc_id % 5 > 0 THEN 'eval (x' ELSE 'name (x' END || doc_id % 45 || ');' AS body FROM documents),
  f AS (SELECT *, sha256(body) AS hash, row_number() OVER (PARTITION BY target, mode, url ORDER BY seq) AS again FROM r),
  m AS (SELECT *, row_number() OVER (PARTITION BY target, hash ORDER BY mode DESC, seq) > 1 AS is_duplicate, strlen(body) AS size, body LIKE '%eval%' AS is_obfuscated FROM f WHERE again = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY target, regexp_extract(url, '[^/]*$') ORDER BY mode DESC, seq) - 1 AS i FROM m WHERE NOT is_duplicate),
  named AS (SELECT *, concat_ws('/', 'output', target, 'encode/js/a.example', regexp_extract(url, '([^/]*).js$', 1) || CASE WHEN i > 0 THEN '_' || i ELSE '' END || '.js') AS file_path FROM p)"""


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    url = F.concat(F.lit("https://a.example/"), (i % 4).cast("string"), F.lit("/"), (i % 25).cast("string"), F.lit(".js"))
    body = F.concat(F.lit("var aa = 0x1F; "), F.when(i % 5 > 0, "eval (x").otherwise("name (x"), (i % 45).cast("string"), F.lit(");"))
    rows = _t(spark, sf_dir, "documents").select(
        F.when(i % 11 > 0, F.concat(F.lit("t"), (i % 3).cast("string"))).alias("target_url"), url.alias("url"), F.lit(0).alias("depth"),
        F.when(i % 2 == 0, "static").otherwise("dynamic").alias("mode"), F.expr("doc_id div 2").alias("seq"), F.lit(200).alias("status"),
        F.lit("text/javascript").alias("content_type"), F.lit(None).cast("string").alias("content_encoding"), body.cast("binary").alias("body"),
    )
    return rows.unionAll(rows.where("seq % 3 = 0"))


@query(f"WITH {_CAPTURES_SQL} SELECT target, mode, url, seq, hash, size, is_duplicate, is_obfuscated FROM m")
def script_files(spark, sf_dir):
    return assets.script_files(_captures(spark, sf_dir)).select("target", "mode", "url", "seq", "hash", "size", "is_duplicate", "is_obfuscated")


@query(f"""WITH {_CAPTURES_SQL} SELECT target, mode, url, file_path, replace(file_path, '/encode/js/', '/decode/js/') AS decode_path, sha256(replace(body, '0x1F', '31')) AS h
  FROM named WHERE is_obfuscated""")
def cleaned_files(spark, sf_dir):
    out = assets.cleaned_files(materialise(assets.script_files(_captures(spark, sf_dir))))
    return out.select("target", "mode", "url", "file_path", "decode_path", F.sha2("code", 256).alias("h"))


@query(f"""WITH {_CAPTURES_SQL}, g AS (SELECT target, count(*) AS n_success, sha256(string_agg(url || ' ' || file_path, ',' ORDER BY url, mode, seq)) AS entries, count(*) FILTER (mode = 'static') AS static_files,
    count(*) FILTER (is_obfuscated) AS deobfuscated_files, CAST(sum(size) AS BIGINT) AS total_size FROM named GROUP BY target)
  SELECT target AS target_url, 0 AS part, regexp_replace(md5(coalesce(target, '')), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS task_id, CAST(n_success AS INT) AS n_success,
    0 AS n_failed, entries, n_success AS total_files, static_files, deobfuscated_files, total_size, 2 AS depth, concat_ws('/', 'out', target, 'encode') AS encode_dir FROM g""")
def crawl_reports(spark, sf_dir):
    files = materialise(assets.script_files(_captures(spark, sf_dir)).drop("body", "plain", "code"))
    failed = assets.failed_files(_captures(spark, sf_dir).where("mode = 'none'"))
    stats_ = reports.statistics(files, failed, failed)
    out = reports.crawl_reports(assets.with_paths(files), failed, stats_, CrawlConfig(), "out")
    entries = F.array_join(F.transform("success_files", lambda x: F.concat_ws(" ", x["url"], x["file_path"])), ",")
    return out.select(
        "target_url", "part", "task_id", F.size("success_files").alias("n_success"), F.size("failed_files").alias("n_failed"), F.sha2(entries, 256).alias("entries"),
        *[f"stats.{x}" for x in ("total_files", "static_files", "deobfuscated_files", "total_size")], "config.depth", "encode_dir",
    )


# Similar documents: every pair of different texts by its common runs of five words.
_SIMILAR_SQL = r"""RECURSIVE ids AS (SELECT doc_id, strlen(text) AS size, min(doc_id) OVER (PARTITION BY text) AS class FROM documents),
  w AS (SELECT doc_id AS id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IN (SELECT class FROM ids)),
  s AS (SELECT id, unnest(list_distinct(CASE len(w) WHEN 0 THEN [] ELSE list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
  n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
  j AS (SELECT a, b, c / (x.n + y.n - c)::DOUBLE AS similarity FROM (SELECT s.id AS a, t.id AS b, count(*) AS c FROM s JOIN s t ON s.s = t.s AND s.id < t.id GROUP BY ALL) JOIN n x ON x.id = a JOIN n y ON y.id = b),
  near AS (SELECT * FROM j WHERE similarity >= 0.8),
  reach(id, x) AS (SELECT class, class FROM ids UNION SELECT reach.id, CASE WHEN x = a THEN b ELSE a END FROM reach JOIN near ON x = a OR x = b),
  g AS (SELECT id, min(x) AS group_id FROM reach GROUP BY id),
  m AS (SELECT doc_id AS id, size, group_id, CASE WHEN class = group_id THEN 1.0 ELSE coalesce(similarity, 0.0) END AS similarity FROM ids JOIN g ON g.id = class LEFT JOIN j ON a = group_id AND b = class)"""


@query(f"WITH {_SIMILAR_SQL} SELECT a, b, similarity FROM near")
def near_dup_pairs(spark, sf_dir):
    return similarity.near_pairs(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"WITH {_SIMILAR_SQL} SELECT id, group_id, similarity FROM m")
def similarity_members(spark, sf_dir):
    return similarity.members(_t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {_SIMILAR_SQL} SELECT group_id, group_id AS represent_file, count(*) AS member_count, round(avg(similarity) FILTER (id <> group_id), 9) AS avg_similarity,
  min(similarity) FILTER (id <> group_id) AS min_similarity, max(similarity) FILTER (id <> group_id) AS max_similarity, CAST(sum(size) FILTER (id <> group_id) AS BIGINT) AS total_saved_size
  FROM m GROUP BY group_id HAVING count(*) > 1""")
def similarity_groups(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length("text").alias("size"))
    return similarity.groups(docs, "doc_id", "text").withColumn("avg_similarity", F.round("avg_similarity", 9))


# A site for each third page: pages name two others of their site, its entry, another site, scripts, and what they named before.
_SITE_HREFS = ["{a}.html", "/p/{b}.html#x", "/p/{t}.html", "https://site{u}.example/p/{u}.html", "#top", "mailto:a@b.example"]
_SITE_SCRIPTS = ["/js/s{s}.js", "//cdn.example/lib{t}.js", "/js/none"]
_SITE = {"a": "page_id // 3 * 6 + 3 + page_id % 3", "b": "page_id // 3 * 6 + 6 + page_id % 3", "t": "page_id % 3", "u": "(page_id + 1) % 3", "s": "page_id % 40"}


def _site_list(parts: list[str]) -> str:
    out = []
    for x in parts:
        text = "'" + x + "'"
        for k, v in _SITE.items():
            text = f"replace({text}, '{{{k}}}', CAST({v} AS VARCHAR))"
        out.append(text)
    return "[" + ", ".join(out) + "]"


def _site_sql(depth: int, start: int, follow: str, script: str) -> str:
    return rf"""RECURSIVE site AS (SELECT page_id, 't' || page_id % 3 AS target, 'https://site' || page_id % 3 || '.example/p/' || page_id || '.html' AS url, page_id % 11 <> 5 AS ok,
    list_concat({_site_list(_SITE_HREFS)}, list_transform(regexp_extract_all(html, '<a [^>]*?"([^"]*?)"', 1), lambda x: replace(x, '&amp;', '&'))) AS a, {_site_list(_SITE_SCRIPTS)} AS s FROM pages),
  links AS (SELECT target, url, ok, 'a' AS tag, unnest(a) AS href, unnest(range(len(a))) AS pos FROM site UNION ALL SELECT target, url, ok, 'script', unnest(s), unnest(range(len(s))) + len(a) FROM site),
  resolved AS (SELECT *, regexp_replace({_FULL}, '#.*$', '') AS link FROM links WHERE NOT starts_with(href, '#')),
  edges AS (SELECT *, {_IS_JS} AS js FROM resolved WHERE ok AND {_SCHEME.format('link')} IN ('http', 'https')),
  r(target, url, depth, kind, path) AS (SELECT 't' || x, 'https://site' || x || '.example/p/' || x || '.html', {start}, 'page', []::BIGINT[] FROM (SELECT unnest([0, 1, 2]) AS x)
    UNION ALL SELECT e.target, link, r.depth + 1, CASE WHEN r.depth < {depth} AND {follow} THEN 'page' ELSE 'script' END, list_append(path, pos)
    FROM r JOIN edges e ON e.target = r.target AND e.url = r.url WHERE r.depth < {depth} AND {follow} OR {script}),
  first AS (SELECT target, url, min(depth) AS depth FROM r GROUP BY ALL),
  visits AS (SELECT target, url, depth, min(kind) AS kind, min(path) AS path FROM r JOIN first USING (target, url, depth) GROUP BY ALL),
  scripts AS (SELECT 't' || page_id % 3 AS target, 'https://site' || page_id % 3 || '.example/js/s' || (page_id % 40) || '.js' AS url, min(page_id) AS seq, 'var a; function f() {{}} // ' || (page_id % 40 % 9) AS body FROM pages GROUP BY ALL)"""


def _site(spark: SparkSession, sf_dir: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """Responses and seeds."""
    p = _t(spark, sf_dir, "pages")
    head = "".join(f'<a href="{x}">x</a>' for x in _SITE_HREFS) + "".join(f'<script src="{x}"></script>' for x in _SITE_SCRIPTS)
    html, i = F.lit(head), F.col("page_id")
    for k, v in _SITE.items():
        html = F.replace(html, F.lit("{" + k + "}"), F.expr(f"cast({v.replace('//', 'div')} as string)"))
    at = F.concat(F.lit("https://site"), (i % 3).cast("string"), F.lit(".example"))
    target = F.concat(F.lit("t"), (i % 3).cast("string")).alias("target_url")
    none = F.lit(None).cast("string").alias("content_encoding")
    pages = p.select(target, F.concat(at, F.lit("/p/"), i.cast("string"), F.lit(".html")).alias("url"), F.lit(0).alias("depth"), F.lit(mode).alias("mode"), i.alias("seq"),
                     F.when(i % 11 == 5, 404).otherwise(200).alias("status"), F.lit("Text/HTML; charset=utf-8").alias("content_type"), none, F.concat(html, F.col("html")).cast("binary").alias("body"))
    body = F.concat(F.lit("var a; function f() {} // "), (i % 40 % 9).cast("string")).cast("binary").alias("body")
    scripts = p.select(target, F.concat(at, F.lit("/js/s"), (i % 40).cast("string"), F.lit(".js")).alias("url"), F.lit(0), F.lit(mode), i.alias("seq"), F.lit(200), F.lit("text/javascript"), none, body)
    seeds = p.where("page_id < 3").select(target.alias("target"), F.concat(at, F.lit("/p/"), i.cast("string"), F.lit(".html")).alias("url"))
    return pages.unionAll(scripts), seeds


_STATIC_SITE = _site_sql(4, 1, "tag = 'a'", "tag = 'script' AND js")
_DYNAMIC_SITE = _site_sql(3, 0, f"{_HOST.format('link')} = 'site' || r.target[2:] || '.example' AND {_HOST.format('link')} = {_HOST.format('r.url')}", "tag = 'script' AND js")


@query(f"WITH {_STATIC_SITE} SELECT target, url, CAST(depth AS INT) AS depth, kind, (target, url) IN (SELECT (target, url) FROM site) OR (target, url) IN (SELECT (target, url) FROM scripts) AS found FROM visits")
def crawl_replay(spark, sf_dir):
    responses, seeds = _site(spark, sf_dir, "static")
    return crawl.replay(responses, seeds, crawl.Rules(4, "static", True)).drop("place")


@query(f"WITH {_DYNAMIC_SITE} SELECT target, url, CAST(depth AS INT) AS depth, row_number() OVER (PARTITION BY target ORDER BY depth, path) - 1 AS ordinal FROM visits")
def visit_order(spark, sf_dir):
    responses, seeds = _site(spark, sf_dir, "dynamic")
    return crawl.visit_order(crawl.replay(responses, seeds, crawl.Rules(3, "dynamic", False))).select("target", "url", "depth", "ordinal")


@query(f"""WITH {_STATIC_SITE} SELECT target, url, CAST(depth AS INT) AS depth, sha256(body) AS hash, row_number() OVER (PARTITION BY target, body ORDER BY seq) > 1 AS is_duplicate
  FROM visits JOIN scripts USING (target, url)""")
def crawl_files(spark, sf_dir):
    responses, seeds = _site(spark, sf_dir, "static")
    visits = crawl.replay(responses, seeds, crawl.Rules(4, "static", True))
    return crawl.crawled_files(responses, visits).select("target", "url", "depth", "hash", "is_duplicate")


@query(f"""WITH {_FILES_SQL}, b AS (SELECT *, CASE WHEN seq % 3 = 0 THEN 1 ELSE 2 END AS run FROM files),
  o AS (SELECT *, row_number() OVER w AS k, first_value(url) OVER w AS first FROM b WINDOW w AS (PARTITION BY target, hash ORDER BY run, mode DESC, seq))
  SELECT target, mode, seq, k > 1 AS is_duplicate, CASE WHEN k > 1 THEN first END AS duplicate_of FROM o WHERE run = 2""")
def registry_marks(spark, sf_dir):
    """Two runs; the second one's files are marked against the first one's hashes."""
    files = _files(spark, sf_dir).select("target", "mode", "seq", "url", "hash")
    with scratch(spark) as folder:
        known = registry.HashRegistry(spark, folder, 8)
        known.add(known.mark(files.where("seq % 3 = 0"), "one"), "one")
        out = materialise(known.mark(files.where("seq % 3 > 0"), "two").select("target", "mode", "seq", "is_duplicate", "duplicate_of"))
        known.forget()
    return out


@query("""SELECT 't' || page_id % 3 AS target_url, url, 'static' AS mode, 200 AS status, sha256(html) AS h FROM pages WHERE page_id % 2 = 0 AND page_id % 5 > 0""")
def archive_responses(spark, sf_dir):
    """Pages in compressed archives, read by the data source, whose filters leave out half of them undecoded."""
    archive.register(spark)
    i = F.col("page_id")
    rows = _t(spark, sf_dir, "pages").select(
        F.concat(F.lit("t"), (i % 3).cast("string")).alias("target_url"), "url", F.lit(0).alias("depth"), F.when(i % 2 == 0, "static").otherwise("dynamic").alias("mode"),
        F.when(i % 5 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.base64(F.col("html").cast("binary")).alias("body_base64"),
    )
    with scratch(spark) as folder:
        rows.write.option("compression", "gzip").json(folder)
        found = spark.read.format("silkmill_archive").load(folder).where("mode = 'static' AND status = 200")
        return materialise(found.select("target_url", "url", "mode", "status", F.sha2("body", 256).alias("h")))


@query(f"""WITH {_FILES_SQL} SELECT 'out/' || target || '/encode/js/cdn.example.com/' || seq || '.js' AS file_path, hash, size FROM marked WHERE NOT is_duplicate""")
def files_on_disk(spark, sf_dir):
    """Files without duplicates under their exact paths, and what then lies there."""
    archive.register(spark)
    text = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").cast("binary").alias("body"))
    named = assets.with_paths(dedupe.mark_duplicates(_files(spark, sf_dir)), "out").join(text, "seq")
    with scratch(spark) as folder:
        named.select("file_path", "body").write.format("silkmill_files").mode("append").save(folder)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.js").load(folder)
        return materialise(files.select(F.regexp_extract("path", "(out/.*)$", 1).alias("file_path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size")))


@query(f"""WITH {_RESOLVED_SQL} SELECT page_id, CAST(pos AS INT) AS pos, link, {_HOST.format('link')} AS host, {_IS_JS} AS is_js FROM r WHERE {_SCHEME.format('link')} IN ('http', 'https')""")
def sql_links(spark, sf_dir):
    """The table function and scalar functions in SQL text."""
    sql.register(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("silkmill_pages")
    return spark.sql("""SELECT p.page_id, l.pos, l.link, url_host(l.link) AS host, is_javascript_url(l.link) AS is_js
      FROM silkmill_pages p, LATERAL extract_links(p.html, p.url) l WHERE url_scheme(l.link) IN ('http', 'https')""")


@query(f"""WITH {_FILES_SQL} SELECT seq, to_json({{'url': url, 'size': size, 'hash': hash, 'crawl_mode': mode}})::VARCHAR AS entry FROM marked WHERE NOT is_duplicate""")
def report_json(spark, sf_dir):
    f = dedupe.mark_duplicates(_files(spark, sf_dir)).where("NOT is_duplicate")
    return f.select("seq", F.to_json(F.struct("url", "size", "hash", F.col("mode").alias("crawl_mode"))).alias("entry"))


@query(f"""WITH {_FILES_SQL} SELECT target, count(*) AS files, count(*) FILTER (is_duplicate) AS duplicates, CAST(sum(size) AS BIGINT) AS total_size,
  count(*) FILTER (mode = 'static' AND NOT is_duplicate) AS static_files, count(*) FILTER (mode = 'dynamic' AND NOT is_duplicate) AS dynamic_files,
  count(*) FILTER (seq % 10 = 0) AS failed_files, CAST(0 AS BIGINT) AS map_files, count(*) AS visited_urls FROM marked GROUP BY target""")
def crawl_report(spark, sf_dir):
    f = _files(spark, sf_dir)
    return assets.report(dedupe.mark_duplicates(f), failed=f.where("seq % 10 = 0"), visited=f)


@query(r"""SELECT doc_id, regexp_replace(md5(source || chr(10) || 'static' || chr(10) || doc_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS id FROM documents""")
def file_ids(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").withColumn("mode", F.lit("static"))
    return d.select("doc_id", assets.stable_id("source", "mode", "doc_id").alias("id"))


@query("SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 4 = 3 THEN 'unsupported: br' END AS decode_error FROM documents")
def decompress_body(spark, sf_dir):
    import zlib

    @F.pandas_udf("binary")
    def packed(i, text):  # noqa: ANN001
        out = []
        for n, t in zip(i, text, strict=True):
            raw = t.encode("utf-8")
            cut = len(raw) // 2 if n % 8 == 0 else 0  # two members
            made = [zlib.compressobj(wbits={0: 31, 1: -15}.get(n % 4, 31)) for _ in range(1 + (cut > 0))]
            parts = [raw[:cut], raw[cut:]] if cut else [raw]
            out.append(b"".join(z.compress(x) + z.flush() for z, x in zip(made, parts, strict=True)) if n % 4 < 2 else raw)
        return __import__("pandas").Series(out)

    i = F.col("doc_id")
    enc = F.when(i % 4 == 0, " GZIP ").when(i % 4 == 1, "deflate").when(i % 4 == 3, "br").otherwise("")
    rows = _t(spark, sf_dir, "documents").select("doc_id", enc.alias("content_encoding"), packed(i, F.col("text")).alias("body"))
    return paths.decompressed(rows).select("doc_id", F.sha2("plain", 256).alias("h"), "decode_error")


@query("""WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'text/javascript' WHEN 1 THEN '' WHEN 2 THEN 'text/html' END AS ct, url || CASE WHEN page_id % 3 = 0 THEN '.js' ELSE '' END AS url FROM pages)
  SELECT page_id, coalesce(nullif(ct, ''), 'application/javascript') AS content_type FROM r WHERE coalesce(ct, '') IN ('application/javascript', 'text/javascript') OR url LIKE '%.js'""")
def response_capture(spark, sf_dir):
    from silkmill.sources.responses import captured

    i = F.col("page_id")
    kind = F.when(i % 4 == 0, "text/javascript").when(i % 4 == 1, "").when(i % 4 == 2, "text/html")
    url = F.concat("url", F.when(i % 3 == 0, ".js").otherwise(""))
    r = _t(spark, sf_dir, "pages").select("page_id", kind.alias("content_type"), url.alias("url"))
    return captured(r).select("page_id", "content_type")


@query(f"WITH {_FILES_SQL} SELECT target, hash, count(*) AS n FROM (SELECT DISTINCT target, hash FROM files) GROUP BY ALL")
def stream_dedupe(spark, sf_dir):
    """Runs as a stream over the table's folder until all is read; the sink is a table in the shared folder."""
    import uuid

    from silkmill.streaming.dedupe import first_contents

    at = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if not os.path.isfile(source) else f"{sf_dir}/documents.parque[t]")
    first = first_contents(stream.select(F.col("source").alias("target"), F.col("text").alias("body"))).select("target", "hash")
    run = first.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
    run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("target string, hash string").parquet(f"{at}/out").groupBy("target", "hash").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_FILES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY target, hash ORDER BY mode DESC, seq) AS k FROM files) SELECT target, hash, mode, seq, url FROM o WHERE k = 1""")
def stream_first_wins(spark, sf_dir):
    """Files in batches, dynamic ones and late numbers first: the stream's winners are those of one batch."""
    from silkmill.streaming.first_wins import first_wins

    rows = _files(spark, sf_dir).select("target", "hash", "mode", "seq", "url", F.timestamp_seconds(F.col("seq") % 1000 + 86400).alias("time"))
    end = spark.sql("SELECT '' AS target, '' AS hash, 'static' AS mode, 0L AS seq, '' AS url, timestamp_seconds(500000) AS time")
    with scratch(spark) as folder, stored(rows) as files:
        # Each part lands as a whole, then the stream goes on from where it stopped; the last row's time ends all others'.
        for part in [files.where("mode = 'dynamic'"), files.where("mode = 'static' AND seq % 3 > 0"), files.where("mode = 'static' AND seq % 3 = 0").unionByName(end)]:
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            found = first_wins(stream, "time", "1 hour", 3600)
            run = found.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            run.trigger(availableNow=True).start().awaitTermination()
        return materialise(spark.read.schema(found.schema).parquet(f"{folder}/out").where("target <> ''"))


@query(f"""WITH c AS (SELECT doc_id, source, text, {_OBF['evals'].replace('code', 'text')} OR {_OBF['marks'].replace('code', 'text')} OR {_OBF['escs'].replace('code', 'text')} > 5 OR {_OBF['hexes'].replace('code', 'text')} > 10
  OR coalesce({_OBF['singles'].replace('code', 'text')} / nullif(strlen(text), 0) > 0.01, false) AS obf FROM documents), d AS (SELECT source AS target, strlen(text) AS size, obf,
  row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id % 2, doc_id) > 1 AS dup FROM c)
  SELECT target, count(*) AS files, count(*) FILTER (dup) AS duplicates, CAST(sum(size) FILTER (NOT dup) AS BIGINT) AS unique_bytes, count(*) FILTER (obf AND NOT dup) AS obfuscated FROM d GROUP BY target""")
def asset_report(spark, sf_dir):
    """Flagship: documents as scripts, exact duplicates, obfuscation, counts per target."""
    doc_id = F.col("doc_id")
    files = _t(spark, sf_dir, "documents").select(
        F.col("source").alias("target"), F.when(doc_id % 2 == 0, "static").otherwise("dynamic").alias("mode"), doc_id.alias("seq"),
        dedupe.content_hash(F.col("text")).alias("hash"), F.octet_length("text").cast("long").alias("size"), detect.is_obfuscated(F.col("text")).alias("obf"),
    )
    f = dedupe.mark_duplicates(files)
    return f.groupBy("target").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_duplicate").alias("duplicates"),
        F.sum(F.when(~F.col("is_duplicate"), F.col("size"))).alias("unique_bytes"), F.count_if(F.col("obf") & ~F.col("is_duplicate")).alias("obfuscated"),
    )
