"""Word and hash rules that several operators share.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  ``bytes.split()`` without an
argument cuts at exactly these six bytes, and ``bytes.lower()`` maps exactly A-Z, so
both rules hold byte for byte on UTF-8 without a regular expression.
"""

from __future__ import annotations

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"


def utf8_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words of a text as UTF-8; none for null."""
    if not text:
        return []
    raw = text.encode("utf-8")
    return (raw.lower() if lower else raw).split()
