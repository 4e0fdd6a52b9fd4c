"""Suffix array by two-stage sorting, adjacent common prefixes, and repeats of a given length.

Stage one sorts only the suffixes that are smaller than their successors, directly, by
their first ``depth`` bytes.  Stage two walks the buckets of first bytes upward: every
placed suffix puts its predecessor into that one's bucket, if the predecessor is larger
than its successor; within a bucket these come before the sorted ones.  Suffixes that agree
in ``depth`` bytes may stand in any order, which is enough for repeats of that length.
"""

from __future__ import annotations

import numpy as np


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end counts as smallest."""
    n = len(s)
    up = np.zeros(n, bool)
    if n > 1:
        differs = np.append(s[:-1] != s[1:], True)
        at = np.where(differs, np.arange(n), n)
        decides = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
        rise = np.append(s[:-1] < s[1:], False)
        up = rise[decides]
    return up


def suffix_array(s: np.ndarray, depth: int, need: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of the byte array ``s``, ordered by their first ``depth`` bytes.

    With ``need``, only these suffixes and those that are needed to induce them.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    up = smaller_than_next(s)
    wanted = np.ones(n, bool) if need is None else need.copy()
    add = np.flatnonzero(wanted & ~up)
    while need is not None and len(add):  # a larger suffix needs its successor
        add = add[add < n - 1] + 1
        add = add[~wanted[add]]
        wanted[add] = True
        add = add[~up[add]]
    padded = np.concatenate([s, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(up & wanted)
    views = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(views).view(f"S{depth}").ravel(), kind="stable")]
    firsts = np.searchsorted(s[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[n - 1]:
        waiting[s[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def hand_on(placed: np.ndarray, byte: int) -> np.ndarray:
        """Deals the larger predecessors to their buckets; returns those of this bucket."""
        before = placed[placed > 0] - 1
        before = before[~up[before] & wanted[before]]
        bytes_ = s[before]
        for b in np.unique(bytes_[bytes_ != byte]):
            waiting[b].append(before[bytes_ == b])
        return before[bytes_ == byte]

    for byte in range(256):
        level = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        while len(level):  # runs of one byte are placed one step at a time
            out.append(level)
            level = hand_on(level, byte)
        here = direct[firsts[byte] : firsts[byte + 1]]
        if len(here):
            out.append(here)
            hand_on(here, byte)
        waiting[byte] = []
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``depth``; first 0.

    Eight bytes are compared at a time; the lengths of differing words come from their bits.
    """
    n = len(s)
    padded = np.concatenate([s, np.zeros(depth + 16, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for step in range(0, depth, 8):
        if not len(at):
            break
        a, b = order[at - 1], order[at]
        wa = np.ascontiguousarray(words[a + step]).view("<u8").ravel()
        wb = np.ascontiguousarray(words[b + step]).view("<u8").ravel()
        diff = wa ^ wb
        equal = diff == 0
        low = diff & (~diff + np.uint64(1))  # lowest differing bit
        same = np.where(equal, 8, (np.bitwise_count(low - np.uint64(1)) >> 3))
        room = n - np.maximum(a, b)  # bytes left of the shorter suffix
        out[at] = np.minimum(np.minimum(step + same, room), depth)
        at = at[equal & (room > step + 8)]
    return out


def repeats(s: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Starts of the strings of ``length`` bytes that also start at a place of smaller rank.

    ``rank``: the order of places; negative where no string may start.
    """
    order = suffix_array(s, length, rank >= 0)
    order = order[rank[order] >= 0]
    if not len(order):
        return order
    run = np.cumsum(common_prefixes(s, order, length) < length) - 1
    first = np.full(run[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, run, rank[order])
    return order[rank[order] > first[run]]
