"""Mixing sources to target weights, in blocks of words, with DataFrame functions only.

Packing: the documents of a source are dealt to chunks by a hash, lie end to end in each
chunk, and every chunk is cut into blocks of ``BLOCK_WORDS`` words (its last one shorter).
Blocks of a source are numbered through its chunks.  Drawing: source s gets as many slots
of the mix as its target asks for, the last one for a part of its block.  A keyed pseudorandom
permutation (a Feistel network) deals the slots of all sources to output shards, so a shard's source
counts are a multinomial draw under the condition that the totals are the quotas: a multivariate
hypergeometric one.  The r-th slot of a source takes block ``perm_s(r mod n_s)`` in round
``r div n_s``; slots and blocks meet in a join by index.

A hot source is spread over its chunks and blocks; the only tables that one task may order
are the sources and, per source, the chunk totals (one row for ``CHUNK_DOCS`` documents).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, materialise
from silkmill.llm.text import WORD_PATTERN

BLOCK_WORDS = 64
SHARD_SLOTS = 1024
CHUNK_DOCS = 2048
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Ranges of slots that the quotas are cut into to find a slot's source by an equi-join.
RANGES = 1024
#: Rounds of the Feistel network.
FEISTEL_ROUNDS = 6


def words_in(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, seed: Column) -> Column:
    """A pseudorandom bijection of 0..n-1, keyed by the seed, for n up to 2^62.

    The network permutes the pairs of digits to the base a = floor(sqrt(n)) + 1; a number of n or more,
    of which there are at most 2a, is permuted again.  Up to n = 1000 64 times are always enough; beyond,
    a number is still outside after 16 times with a probability under 10^-19, and that is an error.
    """
    side = F.floor(F.sqrt(n.cast("double"))) + 1

    def step(v: Column, k: Column) -> Column:
        right = F.pmod(v, side)
        left = F.call_function("div", v, side)
        return right * side + F.pmod(left + F.pmod(F.xxhash64(seed, k, right), side), side)

    def network(x: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(FEISTEL_ROUNDS)), x.cast("long"), step)

    times = F.when(n <= 1000, F.lit(64)).otherwise(F.lit(16))
    out = F.aggregate(F.sequence(F.lit(1), times), network(index), lambda v, _: F.when(v >= n, network(v)).otherwise(v))
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("a number stayed outside of the permutation")).cast("long"))


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_no, source_size, target`` from ``source, source_size``.

    Sources in code-point order, null last, weigh 5, 2, 1, repeating, and share the sum of
    sizes by weight; no target exceeds three times its source's size, the excess is shared
    by weight among the others (water-filling, here in closed form: sources are capped in
    the order of cap over weight).
    """
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.asc_nulls_last("source"))
    out = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    out = out.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), F.pmod("source_no", F.lit(len(WEIGHTS))) + 1))
    out = out.withColumn("cap", F.col("source_size") * float(MAX_REPEATS)).withColumn("full_at", F.col("cap") / F.col("weight"))
    by_cap = everything.orderBy("full_at", "source_no")
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    out = out.withColumn("level", left / weight)
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "source_no", "level"))).over(everything)
    target = F.least("cap", F.col("weight") * F.coalesce(level["level"], F.lit(0.0)))
    return out.withColumn("target", target).select("source", "source_no", "source_size", "target")


def _placed(docs: DataFrame) -> DataFrame:
    """Adds the chunk, the row's number and its first word's place in the chunk; needs ``source_no``, ``chunks``, ``size``, ``h``."""
    spot = F.xxhash64(F.lit("mix"), "doc_id", "size", "h")
    in_chunk = W.partitionBy("source_no", "chunk").orderBy(spot, "doc_id", "size", "h")
    return (
        docs.withColumn("chunk", F.pmod(spot, "chunks"))
        .withColumn("row_no", F.row_number().over(in_chunk))
        .withColumn("begin", F.sum("size").over(in_chunk.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    )


class Mix:
    """A drawn mix over ``docs``; only numbers are kept, texts are read again where asked for.

    ``sources``: see :func:`targets`, with ``blocks`` and ``slots``.
    """

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source"):
        self.whole = docs
        self.names = (doc_id, text, source)
        self.docs = materialise(docs.select(*self._numbers()))
        sums = materialise(self.docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
        chunks = sums.select(F.col("source").alias("s"), F.ceil(F.col("n") / CHUNK_DOCS).alias("chunks"))
        goals = targets(sums.select("source", "source_size"))
        self.goals = materialise(goals.join(chunks, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
        self.placed = _placed(self._numbered(self.docs))
        per_chunk = self.placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
        per_chunk = per_chunk.withColumn("n", F.ceil(F.col("words") / BLOCK_WORDS))
        ahead = W.partitionBy("source_no").orderBy("chunk")
        self.per_chunk = materialise(
            per_chunk.withColumn("first_block", F.sum("n").over(ahead.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        )
        blocks = self.per_chunk.groupBy("source_no").agg(F.sum("n").alias("blocks"))
        made = self.goals.join(blocks, "source_no")
        wanted = F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))
        part = F.round((wanted - F.floor(wanted)) * BLOCK_WORDS).cast("int")
        full = F.floor(wanted) + F.when(part == BLOCK_WORDS, 1).otherwise(0)
        made = made.withColumn("full", F.least(full, F.col("blocks") * MAX_REPEATS))
        made = made.withColumn("part", F.when((part < BLOCK_WORDS) & (F.col("full") < F.col("blocks") * MAX_REPEATS), part).otherwise(0))
        made = made.withColumn("slots", F.col("full") + F.when(F.col("part") > 0, 1).otherwise(0))
        ahead = W.partitionBy(F.lit(0)).orderBy("source_no")
        self.sources = materialise(made.withColumn("until", F.sum("slots").over(ahead)))
        self.n_slots = self.sources.agg(F.sum("slots")).first()[0] or 0

    def _numbers(self) -> list[Column]:
        doc_id, text, source = (F.col(c) for c in self.names)
        return [doc_id.alias("doc_id"), source.alias("source"), words_in(text).alias("size"), F.xxhash64(text).alias("h")]

    def _numbered(self, docs: DataFrame) -> DataFrame:
        numbers = self.goals.select(F.col("source").alias("s"), "source_no", "chunks")
        return docs.join(numbers, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def slots(self) -> DataFrame:
        """The mix as ``shard, slot, source_no, round, block, words``: one row per slot, which takes the block's first words."""
        n = self.n_slots
        width = max(1, math.ceil(n / RANGES))
        first = F.col("until") - F.col("slots")
        ranges = self.sources.where("slots > 0").select(
            "source_no", "blocks", "until", "full", "part", first.alias("first"),
            F.explode(F.sequence(F.floor(first / width), F.floor((F.col("until") - 1) / width))).alias("range"),
        )
        at = self.goals.sparkSession.range(n).withColumn("range", F.floor(F.col("id") / width))
        at = at.join(ranges, "range").where((F.col("id") >= F.col("first")) & (F.col("id") < F.col("until")))
        place = permuted(F.col("id"), F.lit(max(n, 1)), F.lit("place"))
        r = F.col("id") - F.col("first")
        return at.select(
            F.floor(place / SHARD_SLOTS).alias("shard"), F.pmod(place, F.lit(SHARD_SLOTS)).alias("slot"), "source_no",
            F.floor(r / F.col("blocks")).alias("round"),
            permuted(F.pmod(r, F.col("blocks")), F.col("blocks"), F.col("source_no")).alias("block"),
            F.when(r < F.col("full"), F.lit(BLOCK_WORDS)).otherwise(F.col("part")).alias("words"),
        )

    def shard_counts(self) -> DataFrame:
        """The draw: ``shard, source_no, n``."""
        return self.slots().groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n"))

    def pieces(self) -> DataFrame:
        """``source_no, block, in_block, chunk, row_no, from_word, n_words``: what each block holds, and from which of its words on."""
        at = self.placed.where("size > 0").join(self.per_chunk.select("source_no", "chunk", "first_block"), ["source_no", "chunk"])
        last = F.floor((F.col("begin") + F.col("size") - 1) / BLOCK_WORDS)
        at = at.withColumn("b", F.explode(F.sequence(F.floor(F.col("begin") / BLOCK_WORDS), last)))
        low = F.greatest("begin", F.col("b") * BLOCK_WORDS)
        high = F.least(F.col("begin") + F.col("size"), (F.col("b") + 1) * BLOCK_WORDS)
        return at.select(
            "source_no", (F.col("first_block") + F.col("b")).alias("block"), (low - F.col("b") * BLOCK_WORDS).alias("in_block"), "chunk", "row_no",
            (low - F.col("begin")).alias("from_word"), (high - low).alias("n_words"),
        )

    def drawn(self) -> DataFrame:
        """Slots joined with the pieces of their blocks, by index."""
        met = self.slots().join(self.pieces(), ["source_no", "block"])
        left = F.col("words") - F.col("in_block")
        return met.where(left > 0).withColumn("n_words", F.least("n_words", left))

    def taken(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` for every row of the documents."""
        sums = self.drawn().groupBy("source_no", "chunk", "row_no").agg(F.sum("n_words").alias("taken"))
        out = self.placed.join(sums, ["source_no", "chunk", "row_no"], "left")
        out = out.join(self.goals.select("source_no", "source_size", "target"), "source_no")
        return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self) -> DataFrame:
        """The mix as documents: one row per document and round, with the input's columns.

        A document that a round takes whole keeps its text; else its text is the taken words,
        joined by one space.  ``n_chars``, if there, follows the text.  Documents without a
        word are in no block and so not in the mix.
        """
        text = self.names[1]
        columns = self.whole.columns
        rows = _placed(self._numbered(self.whole.select(as_doc(self.whole), *self._numbers())))
        cuts = self.drawn().groupBy("source_no", "chunk", "row_no", "round").agg(
            F.sum("n_words").alias("n"), F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("cuts")
        )
        got = rows.join(cuts, ["source_no", "chunk", "row_no"])
        old = F.col("doc").getField(text)
        words = F.regexp_extract_all(old, F.lit(WORD_PATTERN), F.lit(0))
        cut = F.flatten(F.transform("cuts", lambda c: F.slice(words, (c["from_word"] + 1).cast("int"), c["n_words"].cast("int"))))
        new = F.when(F.col("n") == F.col("size"), old).otherwise(F.array_join(cut, " "))
        got = got.withColumn("new", new)
        return got.select(
            *[
                F.col("new").alias(c) if c == text
                else F.char_length("new").cast("long").alias(c) if c == "n_chars"
                else F.col("doc").getField(c).alias(c)
                for c in columns
            ]
        )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Draws the mix of ``docs``.

    Null and word-less texts have size 0 and are never taken; null sources are a source of
    their own, the last.  Equal rows are packed one after the other, so each has its own share.
    An empty table gives empty results.  The draw depends on the rows alone: reruns agree.
    """
    return Mix(docs, doc_id, text, source)
