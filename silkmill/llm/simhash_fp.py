"""SimHash fingerprints of whole texts."""

from __future__ import annotations

import numpy as np
import xxhash

from silkmill.llm.text import utf8_words

#: Row b holds the eight bits of byte b, highest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Runs of ``width`` words joined by one space; a shorter text is one run; no word, none."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over XXH64 of the word shingles; zero when there is no word."""
    runs = shingles(utf8_words(text), width)
    if not runs:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, seed) for x in runs), np.uint64, len(runs))
    columns = hashes.byteswap().view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")
