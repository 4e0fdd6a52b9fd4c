"""Elias-Fano sequences, and an n-gram trie in memory-mapped levels over them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_BYTE_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Place of the r-th one of a byte.
_BYTE_SELECT = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[:8] for b in range(256)], np.uint8)
#: Values that are packed or unpacked at once; a multiple of 8.
_AT_ONCE = 1 << 20
#: Searches that are made at once.
_ASKED_AT_ONCE = 1 << 16


class EliasFano:
    """A sequence of integers that never falls: lower bits packed, upper bits in unary, ranks for every 8 bytes."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: int64, not falling, not negative."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        packed = []
        for k in range(0, n if low_bits else 0, _AT_ONCE):
            part = values[k : k + _AT_ONCE]
            bits = np.empty((len(part), low_bits), np.uint8)
            for b in range(low_bits):
                bits[:, b] = (part >> b) & 1
            packed.append(np.packbits(bits.ravel(), bitorder="little"))
        packed = np.concatenate([*packed, np.zeros(16, np.uint8)])
        places = (values >> low_bits) + np.arange(n)
        high_bits = np.zeros(int(places[-1]) + 1 if n else 1, np.uint8)
        high_bits[places] = 1
        high = np.packbits(high_bits, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % 8 + 8, np.uint8)])  # so that a zero ends the last value's bucket
        ones = _BYTE_ONES[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        return cls(n, low_bits, packed, high, np.concatenate([[0], np.cumsum(ones)]))

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ranks]

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of ones, or of zeros, of the upper bits by rank: a directory gives the word, popcounts the byte, a table the bit."""
        before = (64 * np.arange(len(self.ranks)) - self.ranks) if zeros else self.ranks
        word = np.searchsorted(before, k, "right") - 1
        left = k - before[word]
        held = self.high.reshape(-1, 8)[word]
        held = ~held if zeros else held
        up_to = np.cumsum(_BYTE_ONES[held], axis=1, dtype=np.int64)
        byte, row = (up_to <= left[:, None]).sum(axis=1), np.arange(len(k))
        left = left - np.where(byte > 0, up_to[row, byte - 1], 0)
        return word * 64 + byte * 8 + _BYTE_SELECT[held[row, byte], left]

    def _lower(self, at: np.ndarray) -> np.ndarray:
        """Lower bits of values by place."""
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.low_bits
        words = np.ndarray((len(self.low) - 8,), "<u8", self.low, strides=(1,))[bit >> 3]
        return ((words >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, at: np.ndarray) -> np.ndarray:
        """Values by place."""
        return (self._select(at, False) - at) << self.low_bits | self._lower(at)

    def successor(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of the first value that is ``x`` or more among those with the same upper bits, within bounds if given; the bucket's end if there is none.

        Zeros of the upper bits bound the bucket, and the lower bits are compared within it; no value is decoded.
        """
        upper, lower = x >> self.low_bits, x & ((1 << self.low_bits) - 1)
        top = np.int64(self.n and int(self.access(np.array([self.n - 1]))[0]) >> self.low_bits)
        inside = (upper <= top) & (self.n > 0)
        upper = np.minimum(upper, top)
        low = np.where(upper > 0, self._select(np.maximum(upper - 1, 0), True) - (upper - 1), 0)
        high = self._select(upper, True) - upper
        low = low if begin is None else np.maximum(low, begin)
        high = high if end is None else np.minimum(high, end)
        low, high = np.where(inside, low, self.n), np.where(inside, high, self.n)
        while len(active := np.flatnonzero(low < high)):
            middle = (low[active] + high[active]) >> 1
            less = self._lower(middle) < lower[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
        return low

    def place(self, x: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, or -1."""
        at = self.successor(x, begin, end)
        there = np.flatnonzero(at < (self.n if end is None else np.minimum(end, self.n)))
        out = np.full(len(x), -1, np.int64)
        same = there[self.access(at[there]) == x[there]]
        out[same] = at[same]
        return out


class Trie:
    """Contexts, the pointers to their children, the children, and a code for each child.

    A child is stored relative to its context: the context's number times ``width`` plus the
    child, so a level never falls, and the children of a context lie between two pointers.
    """

    def __init__(self, levels: list[EliasFano], codes: np.ndarray, width: int):
        self.contexts, self.pointers, self.children = levels
        self.codes, self.width = codes, width

    @classmethod
    def build(cls, contexts: np.ndarray, pointers: np.ndarray, children: np.ndarray, codes: np.ndarray, width: int) -> Trie:
        """``contexts`` rise; ``children`` rise in each context."""
        number = np.repeat(np.arange(len(contexts)), np.diff(pointers))
        return cls([EliasFano.build(x) for x in (contexts, pointers, number * width + children)], codes, width)

    def to_bytes(self) -> bytes:
        """All levels, each array at a multiple of 8 bytes, behind their sizes."""
        levels = (self.contexts, self.pointers, self.children)
        parts = [*(a for x in levels for a in x.arrays()), self.codes]
        head = [self.width, *(y for x in levels for y in (x.n, x.low_bits)), *map(len, parts)]
        return b"".join([np.array(head, np.int64).tobytes(), *(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)])

    @classmethod
    def mapped(cls, payload: bytes) -> Trie:
        """The levels of :meth:`to_bytes` in a memory-mapped file, which has no name and goes with the map."""
        with tempfile.TemporaryFile() as file:
            file.write(payload)
            file.flush()
            view = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(view, np.int64, 17).tolist()
        arrays, at = [], 17 * 8
        for kind, n in zip([np.uint8, np.uint8, np.int64] * 3 + [np.uint16], head[7:], strict=True):
            arrays.append(np.frombuffer(view, kind, n, at))
            at += n * np.dtype(kind).itemsize
            at += -at % 8
        levels = [EliasFano(head[1 + 2 * k], head[2 + 2 * k], *arrays[3 * k : 3 * k + 3]) for k in range(3)]
        return cls(levels, arrays[9], head[0])

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Places of children in the trie, or -1.

        The context is found in its level; its two pointers bound its children, among which the successor of
        the context-relative child is searched.  Levels stay compressed: see :meth:`EliasFano.successor`.
        """
        out = np.full(len(context), -1, np.int64)
        for start in range(0, len(context), _ASKED_AT_ONCE):
            number = self.contexts.place(context[start : start + _ASKED_AT_ONCE])
            hit = np.flatnonzero((number >= 0) & (child[start : start + _ASKED_AT_ONCE] < self.width))
            if len(hit):
                number = number[hit]
                begin, end = self.pointers.access(number), self.pointers.access(number + 1)
                out[start + hit] = self.children.place(number * self.width + child[start + hit], begin, end)
        return out
