"""How five filters of a corpus act together, in every order: a relational pipeline over words.

Texts are dealt out once, by document; their words are exploded, counted for each document and
word, and these counts summed for each document, which gives its words and distinct words without a
second shuffle.  The other three failures are outer-joined.  Five failures make a mask, so a
part of the corpus is told by 32 conditional counts (and as many of its good and toxic documents);
what any order of the filters keeps or removes are sums of these.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.text import GAP_PATTERN

# The filters' limits, signs and names; a failure's bit is its filter's place.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
MASKS = 1 << len(FILTERS)
#: Not a word, as it is white space: one for each row of a document, so that repeated rows are told.
ROW = "\n"
COUNTED = ("n", "good", "toxic")


def word_totals(keyed: DataFrame) -> DataFrame:
    """``key, n_words, n_distinct`` of ``key, text``, by words exploded and counted twice.

    Rows with one key have one text; their words count once.  A key's rows meet in one task, so both
    aggregations find what they need in place.
    """
    words = F.concat(F.array(F.lit(ROW)), F.split("text", GAP_PATTERN))
    each = keyed.repartition("key").select("key", F.explode(words).alias("word")).groupBy("key", "word").agg(F.count(F.lit(1)).alias("c"))
    real = ~F.col("word").isin("", ROW)
    sums = each.groupBy("key").agg(
        F.max(F.when(F.col("word") == ROW, F.col("c"))).alias("rows"), F.sum(F.when(real, F.col("c"))).alias("c"), F.count_if(real).alias("n_distinct")
    )
    return sums.select("key", F.expr("coalesce(c, 0) div rows").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, part, mask`` for every row: bit k of ``mask`` is set if filter k fails."""
    body = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit(""))
    key = F.unhex(F.sha2(F.concat(name, F.lit("\n"), body), 256)).alias("key")
    words = word_totals(docs.select(key, body.alias("text")))
    own = docs.select(
        key, F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"),
        (100 * F.regexp_count(body, F.lit("[A-Z]")).cast("long") > UPPER_PERCENT * F.length(body).cast("long")).alias("c"), body.rlike(SIGNS).alias("d"),
    )
    # A text's first document is known by text and id together, so that copies of one text do not meet in a task.
    first = docs.select(F.col(doc_id).alias("first"), F.unhex(F.sha2(body, 256)).alias("same")).groupBy("same").agg(F.min("first").alias("first"), F.lit(True).alias("is_first"))
    told = own.join(first, (F.col("digest") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("first")), "left")
    told = told.select("key", "doc_id", "part", "c", "d", F.col("is_first").isNull().alias("e"))
    n, distinct = F.coalesce(F.col("n_words"), F.lit(0)), F.coalesce(F.col("n_distinct"), F.lit(0))
    flags = [n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, F.col("c"), F.col("d"), F.col("e")]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(flags[1:], 1)), flags[0].cast("int"))
    return told.join(words, "key", "left").select("doc_id", "part", mask.alias("mask"))


def part_counts(flagged: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``part`` and, for all, good and toxic documents, an array of 32 conditional counts by mask."""
    marks = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    rows = flagged.join(marks, F.col("doc_id") == F.col("_id"), "left").select(
        "part", "mask", F.lit(True).alias("n"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    counts = [F.count_if((F.col("mask") == m) & F.col(x)).alias(f"{x}{m}") for x in COUNTED for m in range(MASKS)]
    return rows.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{x}{m}" for m in range(MASKS)]).alias(x) for x in COUNTED])


def _total(counts: str, holds) -> Column:
    """Sum of the counts of those masks for which a condition holds."""
    kept = F.transform(F.col(counts), lambda c, m: F.when(holds(m), c).otherwise(F.lit(0).cast("long")))
    return F.aggregate(kept, F.lit(0).cast("long"), lambda a, c: a + c)


def filter_audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Null texts are empty, null languages make the part of the empty string.  E compares with smaller ids
    only: rows of one id do not remove each other, and a null id comes after all others.  Repeated rows count each.  A document is good
    or toxic if any of its labels says so; labels without an id, and null labels, say nothing.  An empty
    table has no parts.  Ids may be of any type that orders; other columns are not read.
    """
    counts = part_counts(failures(docs, doc_id, text, lang), labels, doc_id)
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")
    rows = counts.select("*", F.explode(orders).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = "shiftleft(1L, ascii(substring(filter_order, {}, 1)) - ascii('A'))"
    earlier = f"aggregate(sequence(1, step), 0L, (a, k) -> if(k < step, a | {bit.format('k')}, a))"
    rows = rows.select("*", F.expr(bit.format("step")).alias("own"), F.expr(earlier).alias("earlier"))
    own, before = F.col("own"), F.col("earlier")

    def fails(m: Column) -> Column:
        return m.bitwiseAND(own) > 0

    def gone(m: Column) -> Column:
        return m.bitwiseAND(before) > 0

    # In 120 / k of all orders a filter comes before the k - 1 others that fail.
    share = F.expr("aggregate(transform(n, (c, m) -> if(m & own > 0, c * (120 div bit_count(m)), 0L)), 0L, (a, c) -> a + c)")
    return rows.select(
        "part", "filter_order", "step", _total("n", lambda m: (m.bitwiseAND(own.bitwiseOR(before))) == 0).alias("kept"),
        _total("n", lambda m: fails(m) & ~gone(m)).alias("removed"), _total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        _total("n", lambda m: m == own).alias("unique_fails"), _total("good", lambda m: fails(m) & ~gone(m)).alias("good_lost"),
        _total("toxic", lambda m: fails(m) & ~gone(m)).alias("toxic_lost"),
        share.alias("shapley"),
    )
