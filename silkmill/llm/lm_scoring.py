"""Language-model scores of whole texts, learned from all training texts.

Texts are cut into words once, in blocks of some megabytes; a block names its words by local
numbers.  Blocks ask, shards answer, twice:

1. A block sends the hashes of its words with their counts to the shards of these hashes.  The
   shards add up the counts of all blocks, number the words, and answer both.
2. A block sends its bigrams, each with its counts and the counts of its two words, to the
   shards of their contexts; the bigrams of a frequent context are dealt to shards one by one.  A
   shard learns from all counts and hands out its trie as bytes.  In later tasks the trie's levels are mapped into
   memory, every bigram is searched in them as they are, and the codes of the probabilities go back.

A word or a bigram travels once for each block, however often it occurs there, so no shard
depends on one of them.  A block sends only runs that hold something: at most one row for each
word or bigram of its own, however many shards there are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import stored
from silkmill.llm.elias_fano import Trie
from silkmill.llm.lm_model import answered, decoded, learned, log_unigram, runs
from silkmill.llm.text import utf8_words

#: Text bytes per shard and per block.
SHARD_BYTES, BLOCK_BYTES = 12 << 20, 12 << 20
#: Words that occur more often in all texts have their bigrams dealt to shards one by one.
SPLIT_FROM = 200_000
# Row kinds.
TEXTS, ASKED, TOTALS, ANSWERED, LEVELS = range(5)
ROW = "kind int, shard int, block long, payload binary"
COLUMNS = ["kind", "shard", "block", "payload"]


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the doc_id as text is divisible by 10; null ids train."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed row: for each its type and length, and its bytes by significance."""
    parts = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([ord(a.dtype.char), len(a)], np.int64).tobytes())
        parts.append(a.view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")
    return zstandard.compress(b"".join(parts), 1)


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(payload)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        char, n = np.frombuffer(raw, np.int64, 2, at).tolist()
        kind, at = np.dtype(chr(char)), at + 16
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel() if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=COLUMNS)


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x.astype(np.int64)


def _by_shard(shard: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places of each shard that occurs, in rising order of shards; places keep their order."""
    narrow = shard.astype(np.uint16) if not len(shard) or shard.max() < 1 << 16 else shard
    order = np.argsort(narrow, kind="stable")
    first = runs(shard[order])
    return [(int(shard[x[0]]), x) for x in np.split(order, first[1:])] if len(order) else []


class _Block:
    """Texts that are cut into words together."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, text: str | None, held: bool) -> None:
        words = utf8_words(text)
        self.ids.append(np.fromiter(map(self.words.__getitem__, words), np.uint32, len(words)))
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, held, len(words)))
        self.size += len(text or "") + 100

    def rows(self, shards: int) -> pd.DataFrame:
        ids = np.concatenate(self.ids)
        doc_id, null, held, sizes = (np.array(x, t) for x, t in zip(zip(*self.docs, strict=True), (np.int64, bool, bool, np.uint32), strict=True))
        n = len(self.words)
        every = np.bincount(ids, minlength=n)
        train = np.bincount(ids[np.repeat(~held, sizes)], minlength=n)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        out = [(TEXTS, -1, self.number, _pack(doc_id, null, held, sizes, ids))]
        order = np.argsort(hashes)
        for shard, at in _by_shard((hashes[order] % np.uint64(shards)).astype(np.int64)):
            at = order[at]
            out.append((ASKED, shard, self.number, _pack(np.diff(hashes[at], prepend=np.uint64(0)), at.astype(np.uint32), _narrow(train[at]), _narrow(every[at]))))
        return _frame(out)


def _cut(shards: int) -> Callable:
    """Texts to blocks, and what they ask about their words."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for pdf in batches:
            ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"].tolist()]
            for i, text, held in zip(ids, pdf["text"].tolist(), pdf["held_out"].tolist(), strict=True):
                block.add(i, text, held)
                if block.size >= BLOCK_BYTES:
                    yield block.rows(shards)
                    number += 1
                    block = _Block(number)
        if block.docs:
            yield block.rows(shards)

    return of


def _answer_words(shards: int) -> Callable:
    """A shard's words: numbers and counts for each block that asks, and the totals."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        asked = [_unpack(x) for x in pdf["payload"]]
        words, number = np.unique(np.concatenate([np.cumsum(x[0]) for x in asked]), return_inverse=True)
        train, every = (np.bincount(number, np.concatenate([x[k] for x in asked]), len(words)).astype(np.int64) for k in (2, 3))
        rows = [(TOTALS, shard, -1, _pack(np.array([train.sum(), (train > 0).sum()])))]
        at = 0
        for block, (_, local, _, _) in zip(pdf["block"], asked, strict=True):
            mine = number[at : at + len(local)]
            at += len(local)
            rows.append((ANSWERED, shard, block, _pack(local, _narrow(mine * shards + shard + 1), _narrow(train[mine]), _narrow(every[mine]))))
        return _frame(rows)

    return of


def _mixed(*numbers: np.ndarray) -> np.ndarray:
    """A 64-bit hash of numbers, never negative."""
    out = np.zeros(len(numbers[0]), np.uint64)
    with np.errstate(over="ignore"):
        for x in numbers:
            out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).astype(np.int64)


class _Bigrams:
    """A block's different bigrams whose context is known, in the order of asking; the mark of start and end is word 0."""

    def __init__(self, pdf: pd.DataFrame, ends: int, shards: int):
        self.doc_id, self.null, self.held, sizes, ids = _unpack(pdf.loc[pdf["kind"] == TEXTS, "payload"].iloc[0])
        answers = [_unpack(x) for x in pdf.loc[pdf["kind"] == ANSWERED, "payload"]]
        local = np.concatenate([np.zeros(0, np.int64), *(x[0].astype(np.int64) for x in answers)])
        n = len(local)
        number, train, every = (np.zeros(n + 1, np.int64) for _ in range(3))
        for k, to in ((1, number), (2, train), (3, every)):
            to[local] = np.concatenate([np.zeros(0, np.int64), *(x[k].astype(np.int64) for x in answers)])
        train[n] = every[n] = ends  # the mark
        rank = np.argsort(number)  # rank 0 is the mark
        place = np.empty(n + 1, np.int64)
        place[rank] = np.arange(n + 1)
        self.number, self.train, self.every = number[rank], train[rank], every[rank]
        self.sizes = sizes.astype(np.int64) + 1
        end = np.cumsum(self.sizes)
        words = place[ids.astype(np.int64)]
        self.next = np.zeros(int(end[-1]), np.int64)
        inside = np.ones(len(self.next), bool)
        inside[end - 1] = False
        self.next[inside] = words
        before = np.zeros(len(self.next), np.int64)
        before[1:] = self.next[:-1]  # after an end, which is the mark, comes the start, which is the mark
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.known = self.train[before] > 0
        key = before[self.known] * (n + 1) + self.next[self.known]
        different, self.inverse = np.unique(key, return_inverse=True)
        self.context, self.child = different // (n + 1), different % (n + 1)
        context, child = self.number[self.context], self.number[self.child]
        split = self.every[self.context] > SPLIT_FROM
        shard = np.where(split, _mixed(context, child), _mixed(context)) % shards
        self.dealt = _by_shard(shard)

    def counts(self) -> np.ndarray:
        """Training counts of the bigrams in this block."""
        train = ~self.held[self.doc[self.known]]
        return np.bincount(self.inverse[train], minlength=len(self.context))


def _ask_bigrams(ends: int, shards: int) -> Callable:
    """A block's words and their answers to what it asks about its bigrams."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        block, b = int(pdf["block"].iloc[0]), _Bigrams(pdf, ends, shards)
        count, out = b.counts(), []
        for shard, at in b.dealt:
            first = runs(b.context[at])
            context = b.context[at[first]]
            child = b.number[b.child[at]]
            step = np.diff(child, prepend=0)
            step[first] = child[first]
            out.append((ASKED, shard, block, _pack(
                _narrow(np.diff(b.number[context], prepend=0)), _narrow(b.train[context]), _narrow(np.diff(np.append(first, len(at)))),
                _narrow(step), _narrow(b.train[b.child[at]]), _narrow(count[at]),
            )))
        return _frame(out)

    return of


def _asked_bigrams(pdf: pd.DataFrame, tokens: int, types: int) -> tuple[list[int], list[np.ndarray]]:
    """How many bigrams each block asks about, and for all: context, child, training count there, context's count, log10 P(w)."""
    parts: list[list[np.ndarray]] = []
    for payload in pdf["payload"]:
        context, context_count, n, step, word_count, count = _unpack(payload)
        n = n.astype(np.int64)
        child = np.cumsum(step.astype(np.int64))
        first = np.cumsum(n) - n
        child -= np.repeat(child[first] - step[first], n)
        parts.append([np.repeat(np.cumsum(context.astype(np.int64)), n), child, count, np.repeat(context_count, n), word_count])
    context, child, count, context_count, word_count = (np.concatenate([x[k] for x in parts]) for k in range(5))
    return [len(x[0]) for x in parts], [context, child, count.astype(np.int64), context_count, log_unigram(word_count, tokens, types)]


def _learn_bigrams(tokens: int, types: int) -> Callable:
    """A shard's trie: its levels as bytes."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        _, asked = _asked_bigrams(pdf, tokens, types)
        return _frame([(LEVELS, int(pdf["shard"].iloc[0]), -1, learned(*asked).to_bytes())])

    return of


def _answer_bigrams(tokens: int, types: int) -> Callable:
    """A shard's bigrams and its trie to the codes of their probabilities, for each block in the order asked."""

    def of(pdf: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        sizes, (context, child, _, context_count, lower) = _asked_bigrams(pdf, tokens, types)
        codes = answered(Trie.mapped(levels["payload"].iloc[0]), context, child, context_count, lower)
        at = np.cumsum(sizes) - sizes
        return _frame([
            (ANSWERED, shard, block, _pack(codes[a : a + n])) for shard, block, a, n in zip(pdf["shard"], pdf["block"], at, sizes, strict=True)
        ])

    return of


def _finish(tokens: int, types: int, ends: int, shards: int) -> Callable:
    """A block's words and the answers about its bigrams to one row for each text."""

    def of(pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        b = _Bigrams(pdf, ends, shards)
        codes = np.zeros(len(b.context), np.uint16)
        answer = dict(zip(answers["shard"].tolist(), answers["payload"], strict=True))
        for shard, at in b.dealt:
            codes[at] = _unpack(answer[shard])[0]
        base = log_unigram(b.train, tokens, types)[b.next]
        score = base.copy()
        score[b.known] = decoded(codes)[b.inverse]
        n = len(b.sizes)
        return pd.DataFrame({
            "doc_id": pd.Series(b.doc_id, dtype="Int64").mask(b.null), "held_out": b.held, "n_tokens": b.sizes,
            "n_known": np.bincount(b.doc, b.train[b.next] > 0, n).astype(np.int64), "train_tokens": tokens,
            "base_score": np.bincount(b.doc, base, n), "score": np.bincount(b.doc, score, n),
        })

    return of


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Null texts are empty: their only token is the end.  Equal rows have equal results.  Without
    training texts counts are 0, and both scores are those of the base.  An empty table gives an
    empty result; other columns are not read.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id)).alias("held_out"))
    size, ends = d.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    shards = math.ceil((size or 0) / SHARD_BYTES) or 1
    blocks = stored(d.mapInPandas(_cut(shards), ROW))
    asked = blocks.where(F.col("kind") == ASKED)
    words = stored(asked.groupBy("shard").applyInPandas(_answer_words(shards), ROW))
    totals = words.where(F.col("kind") == TOTALS).select("payload")
    sums = [_unpack(bytes(r["payload"]))[0] for r in totals.toLocalIterator()]
    tokens, types = (int(sum(x[k] for x in sums)) for k in (0, 1))
    tokens, types = tokens + ends, types + (ends > 0)
    known = blocks.where(F.col("kind") == TEXTS).union(words.where(F.col("kind") == ANSWERED))
    bigrams = known.groupBy("block").applyInPandas(_ask_bigrams(ends, shards), ROW)
    tries = bigrams.groupBy("shard").applyInPandas(_learn_bigrams(tokens, types), ROW)
    answers = bigrams.groupBy("shard").cogroup(tries.groupBy("shard")).applyInPandas(_answer_bigrams(tokens, types), ROW)
    # The same exchange of ``known`` serves both of its steps, and that of ``bigrams`` learning and answering.
    return known.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _finish(tokens, types, ends, shards),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
