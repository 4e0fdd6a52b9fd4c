"""Anchors: every string of ``LENGTH`` bytes has one, chosen by its content alone."""

from __future__ import annotations

import numpy as np

LENGTH = 100
#: Bytes of an anchor; each string holds LENGTH - ANCHOR + 1 of them, the least hash is its own.
ANCHOR = 32
SPAN = LENGTH - ANCHOR + 1
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


#: Bytes worked on at once; the lower bits of a key hold the place among them.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)


def anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of ANCHOR = 2^5 bytes, by doubling."""
    with np.errstate(over="ignore"):
        h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        width = 1
        for m in _MULTIPLIERS:
            h = h[:-width] * m + h[width:]
            h ^= h >> np.uint64(31)
            width *= 2
        return h * np.uint64(0xC4CEB9FE1A85EC53)


def _least(keys: np.ndarray) -> np.ndarray:
    """Minimum of every SPAN neighbours."""
    low, width = keys, 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchors(joined: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors in texts that lie end to end, ``starts`` their first bytes.

    The anchor of a string is the run of ANCHOR bytes in it with the least upper hash bits,
    the leftmost on a tie.  Strings that cross from one text to the next are left out.
    """
    raw = np.frombuffer(joined, np.uint8)
    n = len(raw)
    inside = np.ones(max(0, n - LENGTH + 1), bool)
    for back in range(1, LENGTH):
        at = starts[1:] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    places, hashes = [], []
    for begin in range(0, len(inside), BLOCK):
        end = min(begin + BLOCK, len(inside))
        h = anchor_hashes(raw[begin : end + LENGTH - 1])
        low = _least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64))
        at = (low & _PLACE).astype(np.int64)[inside[begin:end]]
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        places.append(at + begin)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]
