"""Interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

An n-gram is known by a 64-bit polynomial hash.  A language has, for each order, a sorted array of
n-gram hashes with their log probabilities, and one of context hashes with their back-off
weights.  A probability is looked up by binary search, from the longest order down; contexts
that are known but don't continue this way pay their back-off weight.  Words are scored alone,
with a start and an end mark, so the score of a text is a sum over its words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import regex

ORDER = 5
START, END, UNKNOWN = 1, 2, 3
FIRST_LETTER = 4
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Fewer held-back texts than this give no rejection limit.
LEAST_TEXTS = 20
#: A letter and the letters and combining marks behind it; for texts of Latin-1 characters spelled out.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
LATIN_LETTERS = re.compile("[" + "".join(f"\\x{n:02x}" for n in range(256) if unicodedata.category(chr(n))[0] == "L") + "]+")


def letter_words(text: str | None) -> list[str]:
    """Lower-cased runs of letters in a whole text."""
    if not text:
        return []
    text = text.lower()
    try:  # most texts; the general classes are slower
        text.encode("latin-1")
    except UnicodeEncodeError:
        return LETTERS.findall(text)
    return LATIN_LETTERS.findall(text)


class _Words:
    """Marked words as one array of letter numbers, and the n-grams that end at each place."""

    def __init__(self, words: list[str], alphabet: dict[str, int]):
        get = alphabet.get
        codes: list[int] = []
        for w in words:
            codes.append(START)
            codes += [get(c, UNKNOWN) for c in w]
            codes.append(END)
        self.sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        begin = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.word = np.repeat(np.arange(len(words)), self.sizes)
        self.depth = np.arange(len(codes)) - begin  # letters before this one, the mark included
        self.codes = np.array(codes, np.uint64)
        self.hashes = [np.zeros(len(codes), np.uint64)]
        with np.errstate(over="ignore"):
            for _ in range(ORDER):
                back = np.concatenate([np.zeros(1, np.uint64), self.hashes[-1][:-1]])
                self.hashes.append(back * PRIME + self.codes + np.uint64(1))

    def different(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the different hashes, and which one ends at each place; they are looked up once for each language."""
        return [np.unique(h, return_inverse=True) for h in self.hashes]

    def at(self, order: int) -> np.ndarray:
        """Places where an n-gram of this order ends inside its word; never at the start mark."""
        return np.flatnonzero((self.depth >= order - 1) & (self.depth >= 1))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    uniq, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return uniq, first, np.bincount(inverse, weights, len(uniq))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in a sorted array, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class _Language:
    """One language's arrays by order; order 0 is the same for all letters."""

    def __init__(self, counts: Counter, alphabet: dict[str, int]):
        self.base_log = float(-np.log(len(alphabet) + FIRST_LETTER))
        self.grams, self.logs = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        self.contexts, self.backoffs = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        words = _Words(list(counts), alphabet)
        orders = self._counts(words, np.fromiter(counts.values(), np.float64, len(counts)))
        below = np.zeros(0)
        for k, x in enumerate(orders, 1):
            context, _, total = _sums(x["context"], x["count"])
            of = np.searchsorted(context, x["context"])
            back = x["discount"] * np.bincount(of, minlength=len(context)) / total
            lower = np.exp(self.base_log) if k == 1 else below[np.searchsorted(self.grams[k - 1], x["lower"])]
            below = np.maximum(x["count"] - x["discount"], 0) / total[of] + back[of] * lower
            self.grams.append(x["gram"])
            self.logs.append(np.log(below).astype(np.float32))
            self.contexts.append(context)
            self.backoffs.append(np.log(back).astype(np.float32))

    @staticmethod
    def _counts(words: _Words, weight: np.ndarray) -> list[dict]:
        """Per order: n-grams, their contexts, their suffixes, adjusted counts and the discount."""
        out: list[dict] = []
        for k in range(1, ORDER + 1):
            at = words.at(k)
            gram, first, raw = _sums(words.hashes[k][at], weight[words.word[at]])
            place = at[first]
            context = words.hashes[k - 1][place - 1] if k > 1 else np.zeros(len(gram), np.uint64)
            out.append({"gram": gram, "context": context, "lower": words.hashes[k - 1][place], "raw": raw, "at_start": words.depth[place] == k - 1})
        for k, x in enumerate(out, 1):
            count = x["raw"]
            if k < ORDER:  # how many different letters stand before it; at a word's start, how often
                uniq, kinds = np.unique(out[k]["lower"], return_counts=True)
                at = _find(uniq, x["gram"])
                count = np.where((at >= 0) & ~x["at_start"], kinds[at] if len(kinds) else 0, count)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            x["count"], x["discount"] = count, float(ones / (ones + 2 * twos)) if ones and twos else 0.5
        return out

    def score(self, x: _Words, different: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Natural log probability of each word; ``different``: see :meth:`_Words.different`."""
        total = np.full(len(x.codes), self.base_log, np.float32)
        for k in range(1, ORDER + 1):
            hashes, number = different[k]
            found = _find(self.grams[k], hashes)
            log = np.where(found >= 0, self.logs[k][found], np.float32(np.nan))[number]
            hashes, number = different[k - 1]
            known = _find(self.contexts[k], hashes)
            back = np.roll(np.where(known >= 0, self.backoffs[k][known], np.float32(0))[number], 1)
            total = np.where(x.depth < k - 1, total, np.where(np.isnan(log), back + total, log))
        total[x.depth == 0] = 0
        return np.add.reduceat(total, np.cumsum(x.sizes) - x.sizes, dtype=np.float64)


class LanguageModels:
    """Models of all languages over one alphabet, fitted on word counts per language."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        letters = sorted({c for words in counts.values() for w in words for c in w})
        self.alphabet = {c: n for n, c in enumerate(letters, FIRST_LETTER)}
        self.models = [_Language(counts[x], self.alphabet) for x in self.langs]
        self.means, self.scales, self.limit = np.zeros(len(self.langs)), np.ones(len(self.langs)), np.inf

    def score_words(self, words: list[str]) -> np.ndarray:
        """Natural log probability of each word under each language."""
        if not words:
            return np.zeros((0, len(self.langs)))
        x = _Words(words, self.alphabet)
        different = x.different()
        return np.stack([m.score(x, different) for m in self.models], axis=1)

    def excess(self, n: int, entropy: float, letters: int) -> float:
        """How far a text's cross-entropy lies over its language's mean, in that language's deviations.

        The cross-entropy of a text of m letters spreads like 1 / sqrt(m).
        """
        return (entropy - self.means[n]) * np.sqrt(letters) / self.scales[n]

    def calibrate(self, texts: dict[str, list[tuple[np.ndarray, int]]], rate: float) -> None:
        """The rejection limit from held-back texts: (log probabilities, letters) per language.

        Means and deviations are those of a language, or of all languages together for one with fewer than
        ``LEAST_TEXTS`` texts (of the two means the larger one).  The limit is one for all: of n texts at most
        ``rate`` (n + 1) lie beyond it, so a further text of the same kind is rejected with a probability of at
        most ``rate``, or of 1 / (n + 1) where n is under 1 / rate.  Fewer than ``LEAST_TEXTS`` in all give none.
        """
        own = [[(-p[n] / m, m) for p, m in texts.get(lang, [])] for n, lang in enumerate(self.langs)]
        pool = [x for rows in own for x in rows]
        if len(pool) < LEAST_TEXTS:
            return
        for n, mine in enumerate(own):
            entropy, size = np.array(mine if len(mine) >= LEAST_TEXTS else pool, float).T
            self.means[n] = np.average(entropy, weights=size)
            if mine and len(mine) < LEAST_TEXTS:
                self.means[n] = max(self.means[n], np.average([e for e, _ in mine], weights=[m for _, m in mine]))
            self.scales[n] = max(1e-9, np.sqrt(np.mean((entropy - self.means[n]) ** 2 * size)))
        beyond = np.sort([self.excess(n, e, m) for n, mine in enumerate(own) for e, m in mine])
        self.limit = float(beyond[-max(1, int(rate * (len(beyond) + 1)))])
