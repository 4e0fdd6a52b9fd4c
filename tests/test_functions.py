"""Cases for scalar rules."""

import pytest
from pyspark.sql import functions as F

from silkmill.functions import cleanup, detect, headers, urls


def one(spark, column, value):
    """A column over one row whose ``x`` is the value, which no optimiser rule folds away."""
    return spark.createDataFrame([(value,)], "x binary" if isinstance(value, (bytes, bytearray)) else "x string").select(column.alias("y")).first()["y"]


X = F.col("x")


@pytest.mark.parametrize("url,want", [
    ("https://x/app.js?v=1.0", ".0"), ("https://x/a.b/c", ""), ("https://example.com", ".com"), ("https://x/app.js", ".js"),
])
def test_extension(spark, url, want):
    assert one(spark, urls.extension(X), url) == want


@pytest.mark.parametrize("url,want", [("https://u:p@h:8080/x", "h:8080"), ("https://h_x/a", "h_x"), ("nothing", ""), ("https:///a", "")])
def test_host(spark, url, want):
    assert one(spark, urls.host(X), url) == want


@pytest.mark.parametrize("url,want", [
    ("http://example.com", True), ("https://example.com/path/to/resource", True), ("HTTPS://example.com", True),
    ("ftp://example.com", False), ("not a url", False), ("", False), ("example.com", False),
])
def test_is_valid(spark, url, want):
    assert one(spark, urls.is_valid(X), url) is want
    assert (one(spark, urls.invalid_reason(X), url) is None) is want


@pytest.mark.parametrize("url,want", [("/a/A.MJS", True), ("/a.jsx?x", True), ("/a.js#x", False), ("/a.json", False), ("/a.js\n", False)])
def test_is_javascript_url(spark, url, want):
    assert one(spark, urls.is_javascript(X), url) is want


def test_resolve(spark):
    base = F.lit("https://h/js/app.js")
    assert one(spark, urls.resolve(base, X), "app.js.map") == "https://h/js/app.js.map"
    assert one(spark, urls.resolve(base, X), "/é x") == "https://h/%C3%A9%20x"
    assert one(spark, urls.resolve(base, X), None) is None


@pytest.mark.parametrize("kind,body,want", [
    ("application/javascript; charset=utf-8", "var x = 1;", True), ("text/JAVASCRIPT", "var x = 1;", True),
    ("text/html", "function foo() { var x = 1; const y = 2; }", True), ("text/html", "<html><body>function is a keyword</body></html>", False),
    ("text/plain", "", False), ("text/plain", "class MyClass { constructor() {} }", True), ("application/json", '{"key": "value"}', False),
    ("text/plain", "function only one keyword here", False), ("text/plain", "function test() { var x = 1; } " + "\0" * 2000, True),
    ("text/plain", "x" * 1024 + "function var", False), (None, "import React from 'react'; export default App;", True),
])
def test_javascript_content(spark, kind, body, want):
    assert one(spark, detect.is_javascript_content(F.lit(kind), X), body) is want


@pytest.mark.parametrize("code,want", [
    ("", False), ("0xAB " * 11 + "word " * 100, True), ("0xAB " * 10 + "word " * 100, False), (r"\x41" * 6 + "word " * 100, True),
    (r"\x41" * 5 + "word " * 100, False), ("eval (x1)" + "word " * 100, True), ("medieval (x1)" + "word " * 100, False),
    ("aa['push'](bb)" + "word " * 100, True), ("a " * 9, True), ("éaé " + "word " * 10, True),
])
def test_is_obfuscated(spark, code, want):
    assert one(spark, detect.is_obfuscated(X), code) is want


@pytest.mark.parametrize("code,want", [
    ("a=0x1F+0x0x10;", "a=31+0x10;"), ("_0x1a", "_26"), ("0x8000000000000000", "0x8000000000000000"), ("0x7fffffffffffffff", "9223372036854775807"),
    ("0x0000000000000000001", "1"), ("none", "none"), ("", ""), ("0x0", "0"),
])
def test_hex(spark, code, want):
    assert one(spark, cleanup.hex_to_decimal(X), code) == want


@pytest.mark.parametrize("code,want", [(r"\xe9", "é"), ("\\u20AC", "\u20ac"), (r"\x5cu0041", "A"), (r"\uD83D", "�"), (r"\x4", r"\x4")])
def test_escapes(spark, code, want):
    assert one(spark, cleanup.decode_escapes(X), code) == want


@pytest.mark.parametrize("code,want", [("a==b", "a =  = b"), ("a=>b", "a  =  > b"), ("a \n+\tb", "a + b"), ("a\x0b+b", "a\x0b + b")])
def test_operators(spark, code, want):
    got = one(spark, cleanup.spaced_operators(X), code)
    assert got.replace("  ", " ") == want.replace("  ", " ")


def test_newlines(spark):
    assert one(spark, cleanup.fewer_newlines(X), "a\n\n\n\nb\n\nc") == "a\n\nb\n\nc"


def test_source_map(spark):
    assert one(spark, cleanup.source_map_reference(X), "x//# sourceMappingURL=app.js.map\ny") == "app.js.map"
    assert one(spark, cleanup.source_map_reference(X), "sourceMappingURL= x") == ""
    assert one(spark, cleanup.source_map_reference(X), "x") is None


def test_decode_path(spark):
    assert one(spark, cleanup.decode_path(X), "o/encode/js/h/encode/js/a") == "o/decode/js/h/encode/js/a"
    assert one(spark, cleanup.decode_path(X), r"o\encode\js\a") == r"o\decode\js\a"


@pytest.mark.parametrize("line,want", [("A: b:c", ("A", "b:c", None)), ("nocolon", (None, None, "missing_colon")), (": v", (None, None, "empty_name"))])
def test_header_parse(spark, line, want):
    assert tuple(one(spark, headers.parsed(X), line)) == want


@pytest.mark.parametrize("name,value,want", [
    ("Host", "x", "forbidden_name"), ("X_Y", "x", "bad_name"), ("X", "a" * 8193, "value_too_long"), ("X", "a" * 8192, None),
    ("X", "a\tb", None), ("X", "é", "bad_value"), ("X", "a\n", "bad_value"), ("", "x", "empty_name"),
])
def test_header_problem(spark, name, value, want):
    assert one(spark, headers.problem(F.lit(name), X), value) == want


@pytest.mark.parametrize("name,value,want", [
    ("Authorization", "Bearer abc", "Bearer ***"), ("X-Api-Key", "1234567890", "1234***7890"), ("X-Secret", "12345678", "***"), ("Accept", "x", "x"),
])
def test_redaction(spark, name, value, want):
    assert one(spark, headers.redacted(F.lit(name), X), value) == want
