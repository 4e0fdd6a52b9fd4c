"""Is it JavaScript, and is it obfuscated?"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords that show JavaScript, each counted once; bytes that are looked at.
KEYWORDS = ("function", "var", "const", "let", "class", "import", "export", "=>")
SAMPLE_BYTES = 1024
# Limits of the obfuscation rules.
SINGLE_SHARE, HEX_LIMIT, ESCAPE_LIMIT = 0.01, 10, 5
#: ASCII word edges and white space: the built-in classes differ between regex engines.
EDGE_LEFT, EDGE_RIGHT, SPACE = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])", r"[\t\n\f\r ]"
# The signs that the rules count or look for.
SINGLE = f"{EDGE_LEFT}[A-Za-z]{EDGE_RIGHT}"
HEX = "0x[0-9a-fA-F]+"
ESCAPE = r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"
EVAL = rf"{EDGE_LEFT}eval{SPACE}*\(|Function{SPACE}*\("
TOOL_MARKS = r"_0x[0-9a-f]+|\['push'\]|\['length'\]|String\['fromCharCode"


def keyword_count(body: Column) -> Column:
    """Different keywords in the first bytes of a body (string or binary)."""
    sample = F.substring(body.cast("binary"), 1, SAMPLE_BYTES)
    hits = [F.contains(sample, F.lit(k).cast("binary")).cast("int") for k in KEYWORDS]
    return sum(hits[1:], hits[0])


def is_javascript_content(content_type: Column, body: Column) -> Column:
    """By content type, which is cheap and comes first, else by two keywords."""
    by_type = F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("javascript"))
    return F.when(by_type, True).otherwise(keyword_count(body) >= 2)


def single_letters(code: Column) -> Column:
    return F.regexp_count(code, F.lit(SINGLE))


def many_single_letters(code: Column) -> Column:
    """Single letters per byte; an empty text has none."""
    return F.coalesce(F.try_divide(single_letters(code), F.octet_length(code)) > SINGLE_SHARE, F.lit(False))


def hex_numbers(code: Column) -> Column:
    return F.regexp_count(code, F.lit(HEX))


def escapes(code: Column) -> Column:
    return F.regexp_count(code, F.lit(ESCAPE))


def builds_code(code: Column) -> Column:
    return code.rlike(EVAL)


def has_tool_marks(code: Column) -> Column:
    return code.rlike(TOOL_MARKS)


def is_obfuscated(code: Column) -> Column:
    """Any of the five rules; the searches that can stop early come first."""
    return (
        has_tool_marks(code) | builds_code(code) | (escapes(code) > ESCAPE_LIMIT)
        | (hex_numbers(code) > HEX_LIMIT) | many_single_letters(code)
    )
