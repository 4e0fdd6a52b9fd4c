"""Quality rules with risk-controlled cutoffs, DataFrame functions only.

Every rule rejects a document whose feature lies beyond a cutoff.  The cutoffs of all rules are
tightened step by step in one fixed order: the mildest of each rule, then the second of each, and
so on.  A document thus has one number, the first step that rejects it.  Labelled good documents
decide, per stratum, how far to go: step by step an exact binomial test asks whether all rules
together falsely reject less than ``MAX_FALSE_REJECTION``, and the first step that fails it ends the
sequence.  As the order is fixed beforehand, a stratum's tests need no correction among
themselves; the level is divided among the strata (Bonferroni).  A stratum with too few labels gets
no cutoff (436 good ones can pass the first step with four strata), so nothing is rejected there by
these rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from silkmill.llm.common import materialise
from silkmill.llm.text import WORD_PATTERN

#: Share of good documents of a stratum that all rules together may reject.
MAX_FALSE_REJECTION = 0.01
#: Probability that the rules of any stratum break that share.
ERROR_LEVEL = 0.05
WINDOW = 8
MIN_WORDS = 20
#: Feature over the base columns and its cutoffs, mildest first; a feature above is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols_per_word": ("n_symbols / n_words", tuple(round(4 * 0.85**k, 4) for k in range(30))),
    "dup_lines_per_word": ("n_dup_lines / n_words", tuple(round(0.5 * 0.85**k, 5) for k in range(30))),
    "repeat_words_share": ("n_repeat_words / n_words", tuple(round(0.3 * 0.85**k, 5) for k in range(25))),
    "long_words": ("word_chars / n_words", tuple(round(40 * 0.93**k, 3) for k in range(30))),
    "short_words": ("-word_chars / n_words", tuple(round(-1.2 * 1.05**k, 4) for k in range(30))),
    "upper_share": ("n_upper / word_chars", tuple(round(0.95 * 0.9**k, 4) for k in range(25))),
}


def _repeat_words(hashes: Column, windows: Column) -> Column:
    """Words in windows that occur twice or more; ``windows``: hashes of all windows, in order."""
    tagged = F.array_sort(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # The sorted array is bound once; neighbours with equal hashes are windows that repeat.
    return F.element_at(
        F.transform(
            F.array(tagged),
            lambda s: F.aggregate(
                F.array_sort(
                    F.transform(
                        F.filter(
                            s,
                            lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"]))
                            | ((j < F.size(s) - 1) & (F.get(s, j + 1)["h"] == x["h"])),
                        ),
                        lambda x: x["i"],
                    )
                ),
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                lambda a, p: F.struct(
                    (p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")
                ),
                lambda a: a["n"],
            ),
        ),
        1,
    )


def base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, base_failed.

    Null texts have no words.  Windows are compared by 64-bit hashes of their words' hashes.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(t, F.lit(WORD_PATTERN), F.lit(0)))
    out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))

    def doubled(name: str, step: int, to: str, frame: DataFrame) -> DataFrame:
        later = F.slice(name, step + 1, F.greatest(F.size(name) - step, F.lit(0)))
        n = F.greatest(F.size(name) - step, F.lit(0))
        return frame.withColumn(to, F.zip_with(F.slice(name, 1, n), later, lambda a, b: F.xxhash64(a, b)))

    out = doubled("_h", 1, "_h2", out)
    out = doubled("_h2", 2, "_h4", out)
    out = doubled("_h4", 4, "_h8", out)
    repeated = F.size(F.array_distinct("_h8")) < F.size("_h8")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeated, _repeat_words(F.col("_h"), F.col("_h8"))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.regexp_count(t, F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 1: Stirling's series at x + 10."""
    z = x + 10.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    product = F.lit(0.0)
    for k in range(10):
        product = product + F.log(x + float(k))
    return series - product


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), to double precision for k below the mean and 1 from there on.

    Terms are added from k down to 12 deviations below; what is left is under e^-72 of the sum.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    terms = F.least(k, F.ceil(12 * F.sqrt(n * p) + 100).cast("double")).cast("int")
    added = F.aggregate(
        F.transform(F.sequence(F.lit(0), terms), lambda i: k - i.cast("double")),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["term"] * i / (n - i + 1) * odds).alias("term"), (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k >= n * p, 1.0).otherwise(F.least(F.lit(1.0), first * added))


def step_of(rule: str) -> Column:
    """The first step at which a rule rejects a document; null if none does."""
    number, cuts = list(RULES).index(rule), RULES[rule][1]
    held = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col(f"f_{rule}")))
    return F.when(held < len(cuts), held * len(RULES) + number)


def cutoffs(good: DataFrame) -> DataFrame:
    """``stratum, last``: the last step whose test passed; strata without one are left out.

    ``good``: ``stratum, step`` of labelled good documents, one row each.
    """
    counts = good.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.groupBy("stratum").agg(
        F.sum("m").alias("n"), F.collect_list(F.when(F.col("step").isNotNull(), F.struct("step", "m"))).alias("at")
    )
    counts = counts.withColumn("strata", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))))
    last = len(RULES) * max(len(cuts) for _, cuts in RULES.values()) - 1
    steps = counts.select("stratum", "n", "strata", "at", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("step"))
    k = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + F.when(x["step"] <= F.col("step"), x["m"]).otherwise(0))
    passed = binomial_tail(F.col("k"), F.col("n"), MAX_FALSE_REJECTION) <= ERROR_LEVEL / F.col("strata")
    # k rises with the step, so the tests pass up to some step and fail from there on.
    steps = steps.select("stratum", "n", "strata", "step", k.alias("k")).where(passed)
    return steps.groupBy("stratum").agg(F.max("step").alias("last"))


def quality(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", label: str = "quality"
) -> DataFrame:
    """``doc_id``, the base columns, ``kept`` and ``failed_rules`` for every row.

    ``labels``: doc_id and a 0/1 column; a document is a labelled good one if all its labels
    are 1.  Null strata are one stratum.  Null or word-less texts fail the base rule; they
    have no features and meet no cutoff.  Repeated rows are judged alike, each on its own;
    among the labelled ones they count once each.  Empty labels reject nothing.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(stratum).alias("stratum"), F.col(text).alias("text"))
    stats = materialise(base(d).drop("text"))
    for r, (feature, _) in RULES.items():
        top, _, below = feature.partition(" / ")
        value = F.expr(f"try_divide({top}, {below})")
        stats = stats.withColumn(f"f_{r}", F.coalesce(value, F.lit(0.0)))
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("q")).where("doc_id IS NOT NULL AND q IS NOT NULL")
    marks = marks.groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id")
    good = stats.where("NOT base_failed").join(marks, "doc_id", "left_semi")
    limits = materialise(cutoffs(good.select("stratum", F.least(*[step_of(r) for r in RULES]).alias("step")))).withColumnRenamed("stratum", "s")
    out = stats.join(limits, F.col("stratum").eqNullSafe(F.col("s")), "left")
    failed = F.array_compact(F.array(*[F.when(step_of(r) <= F.col("last"), F.lit(r)) for r in RULES]))
    out = out.withColumn("failed_rules", failed)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
