"""Cleaning up obfuscated code: numbers, escapes, newlines, operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = "=+-*/><"
REPLACEMENT = "�"


def replaced(text: Column, pattern: str, swap: Callable[[Column], Column]) -> Column:
    """Every match of ``pattern`` replaced by an expression over it, in one pass; the text is computed once."""

    def once(code: Column) -> Column:
        found = F.regexp_extract_all(code, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(F.split(code, pattern, -1), found, lambda g, m: F.concat(g, F.when(m.isNull(), "").otherwise(swap(m))))
        return F.array_join(pieces, "")

    return F.get(F.transform(F.array(text), once), F.lit(0))


def _decimal(match: Column) -> Column:
    digits = F.regexp_replace(F.substring(match, 3, 1 << 30), "^0+", "")
    fits = (F.length(digits) <= 15) | ((F.length(digits) == 16) & (F.substring(digits, 1, 1) < "8"))
    number = F.conv(F.when(fits, F.when(digits == "", "0").otherwise(digits)).otherwise("0"), 16, 10)
    return F.when(fits, number).otherwise(match)


def hex_to_decimal(code: Column) -> Column:
    """``0x…`` to decimal wherever it stands; numbers beyond 63 bits stay."""
    return replaced(code, "0x[0-9a-fA-F]+", _decimal)


def _unicode(digits: Column) -> Column:
    surrogate = F.upper(digits).between("D800", "DFFF")
    plain = F.decode(F.unhex(F.when(surrogate, "FFFD").otherwise(digits)), "UTF-16BE")
    return F.when(surrogate, REPLACEMENT).otherwise(plain)


def decode_escapes(code: Column) -> Column:
    r"""``\xHH`` to its character, then ``\uHHHH`` on the result; surrogate halves become U+FFFD."""
    bytes_ = replaced(code, r"\\x[0-9a-fA-F]{2}", lambda m: _unicode(F.concat(F.lit("00"), F.substring(m, 3, 2))))
    return replaced(bytes_, r"\\u[0-9a-fA-F]{4}", lambda m: _unicode(F.substring(m, 3, 4)))


def fewer_newlines(code: Column) -> Column:
    """Three and more newlines become two."""
    return F.regexp_replace(code, r"\n{3,}", "\n\n")


def spaced_operators(code: Column) -> Column:
    """One space around each operator sign, white space around it dropped, sign by sign."""
    for sign in OPERATORS:
        code = F.regexp_replace(code, rf"[\t\n\f\r ]*\{sign}[\t\n\f\r ]*", f" {sign} ")
    return code


def cleaned(code: Column) -> Column:
    """All four, in the order numbers, escapes, newlines, operators."""
    return spaced_operators(fewer_newlines(decode_escapes(hex_to_decimal(code))))


def source_map_reference(body: Column) -> Column:
    """Value of the first source-map mark up to white space; null without a mark, may be empty."""
    value = F.trim(F.regexp_extract(body, r"sourceMappingURL=([^\n\r ]*)", 1))
    return F.when(F.contains(body, F.lit("sourceMappingURL=")), value)


def decode_path(path: Column) -> Column:
    """Path of the cleaned file: the first ``/encode/js/`` becomes ``/decode/js/``, likewise with backslashes."""
    out = F.regexp_replace(path, r"^((?s:.)*?)/encode/js/", "$1/decode/js/")
    return F.regexp_replace(out, r"^((?s:.)*?)\\encode\\js\\", r"$1\\decode\\js\\")
