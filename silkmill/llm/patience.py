"""Patience diff over line hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter


def _longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in the second number too; ``pairs`` rise in the first."""
    tops: list[int] = []
    top_at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        before.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_at.append(n)
        else:
            tops[pile], top_at[pile] = j, n
    out, n = [], top_at[-1] if top_at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def _numbered(lines: list[int], start: int) -> dict[tuple[int, int], int]:
    """Places by line and its how-manieth occurrence."""
    seen: Counter = Counter()
    out = {}
    for n, x in enumerate(lines, start):
        out[x, seen[x]] = n
        seen[x] += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places ``(i, j)`` with a[i] == b[j], rising in both.

    Equal heads and tails of a stretch are aligned; between them lines that are unique in both
    stretches and form the longest rising sequence; then the stretches between those.  Where no
    line is unique in both, the n-th occurrences of equal lines take their place, so no stretch
    that is left has a common line.
    """
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, i_end, j, j_end = stack.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        at_b = {x: n for n, x in enumerate(b[j:j_end], j) if in_b[x] == 1}
        common = [(n, at_b[x]) for n, x in enumerate(a[i:i_end], i) if in_a[x] == 1 and x in at_b]
        if not common:
            nth = _numbered(b[j:j_end], j)
            common = [(n, nth[key]) for key, n in _numbered(a[i:i_end], i).items() if key in nth]
        anchors = _longest_rising(common)
        if not anchors:
            continue
        at_i, at_j = i, j
        for n, m in [*anchors, (i_end, j_end)]:
            stack.append((at_i, n, at_j, m))
            at_i, at_j = n, m
            if n < i_end:
                out.append((n, m))
                at_i, at_j = n + 1, m + 1
    return sorted(out)


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned runs as ``(i, j, length)``."""
    out: list[list[int]] = []
    for i, j in align(a, b):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1][2] += 1
        else:
            out.append([i, j, 1])
    return [tuple(x) for x in out]
