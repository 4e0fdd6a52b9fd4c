"""A bigram model of words with hierarchical Dirichlet smoothing, in Elias-Fano tries.

``P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))`` and ``P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU)``: the
count of a word as a context is its own count, so a context may be spread over shards.  A
context that never occurs leaves ``P(w)``.  Logarithms are stored in steps of ``1 / STEPS``.
"""

from __future__ import annotations

import numpy as np

from silkmill.llm.elias_fano import Trie

SMOOTH = 0.1
#: Weight of the lower order, in words.
MU = 200.0
#: Steps of a quantised log10, and the largest code.
STEPS, LAST_CODE = 2048, 65535


def log_unigram(count: np.ndarray, tokens: int, types: int) -> np.ndarray:
    """log10 P(w) by the word's count in ``tokens`` training tokens of ``types`` kinds."""
    return np.log10((count + SMOOTH) / (tokens + SMOOTH * (types + 1)))


def log_bigram(count: np.ndarray, context_count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 P(w | v); ``lower``: log10 P(w)."""
    return np.log10((count + MU * 10.0**lower) / (context_count + MU))


def coded(log: np.ndarray) -> np.ndarray:
    """Codes of log10 probabilities, at most half a step off."""
    return np.clip(np.rint(log * -STEPS), 0, LAST_CODE).astype(np.uint16)


def decoded(codes: np.ndarray) -> np.ndarray:
    return codes / -float(STEPS)


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(values[1:] != values[:-1]) + 1])


def learned(context: np.ndarray, child: np.ndarray, count: np.ndarray, context_count: np.ndarray, lower: np.ndarray) -> Trie:
    """The trie of all bigrams with a count.

    Each row is one bigram in one part of the corpus: its training count there, the whole count
    of its context, and log10 P(w); the rows of a bigram are all here.
    """
    seen = np.flatnonzero(count)
    width = int(child[seen].max(initial=0)) + 1
    _, number = np.unique(context[seen], return_inverse=True)
    key = number * width + child[seen]
    order = np.argsort(key, kind="stable")  # parts come sorted, so this merges them
    first = runs(key[order])
    total = np.add.reduceat(count[seen[order]], first) if len(first) else np.zeros(0, np.int64)
    at = seen[order[first]]
    begin = runs(context[at])
    code = coded(log_bigram(total, context_count[at], lower[at]))
    return Trie.build(context[at][begin], np.concatenate([begin, [len(at)]]).astype(np.int64), child[at], code, width)


def answered(trie: Trie, context: np.ndarray, child: np.ndarray, context_count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Codes of bigrams: what the trie has, and for others what their context leaves."""
    place = trie.find(context, child)
    code = coded(log_bigram(np.zeros(len(place)), context_count, lower))
    hit = place >= 0
    code[hit] = trie.codes[place[hit]]
    return code
