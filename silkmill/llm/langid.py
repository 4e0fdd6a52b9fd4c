"""Language identification with Kneser-Ney character models and calibrated rejection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkmill.llm.common import as_doc, from_doc, pack, share, small_batches, unpack
from silkmill.llm.langid_model import LanguageModels, letter_words

#: Bound of the training sample: labelled documents per language (expected; a hash decides).
SAMPLE_PER_LANGUAGE = 700
#: One of so many sampled documents (a hash decides) is held back for the rejection limits.
HELD_BACK = 3
#: Share of texts in a learned language that may be rejected.
FALSE_REJECTION = 0.002
#: Letters that count at most towards the certainty of a prediction.
EVIDENCE = 60
#: Scores that a worker keeps, words times languages; a full table starts anew.
MEMO_SCORES = 800_000
#: Different words, and words in all, of texts that are scored together.
WORDS_AT_ONCE, ALL_AT_ONCE = 20_000, 200_000
UNDETERMINED = "und"


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """True where crc32 of the doc_id as text leaves no remainder; null ids count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == 0, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModels | None:
    """The models of :func:`fit_packed`, unpacked."""
    packed = fit_packed(docs, doc_id, text, lang)
    return packed and unpack(packed)


def fit_packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> bytes | None:
    """Models from a bounded sample of labelled documents outside the held-out part.

    The first scan counts labels (two narrow columns), the second takes documents whose
    hashed id falls under the language's share, ``SAMPLE_PER_LANGUAGE`` in expectation, and
    reads their whole texts.  Every label is learned; of a language whose texts would all be held
    back, none is.  The sample is learned in one task, so neither it nor the models unpacked
    are in the driver.  None if nothing is labelled.
    """
    known = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        F.col("l").isNotNull() & ~held_out(F.col("i"))
    )
    counts = known.groupBy("l").count().collect()
    if not counts:
        return None
    part = F.create_map(*chain(*[(F.lit(r["l"]), F.lit(SAMPLE_PER_LANGUAGE / r["count"])) for r in counts]))
    spot = F.pmod(F.xxhash64(F.lit("langid"), "i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(spot < F.coalesce(F.try_element_at(part, F.col("l")), F.lit(0.0)))
    turn = F.pmod(F.xxhash64(F.lit("back"), "i"), F.lit(HELD_BACK)).alias("turn")
    langs = [r["l"] for r in counts]

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _learn(langs, ((row.l, row.t, row.turn) for pdf in batches for row in pdf.itertuples()))
        if models:
            yield pd.DataFrame({"models": [pack(models)]})

    small_batches(docs.sparkSession)
    rows = sample.select("i", "l", "t", turn).repartition(1).sortWithinPartitions("i", F.xxhash64("t"), "l")
    found = rows.mapInPandas(learned, "models binary").collect()
    return bytes(found[0]["models"]) if found else None


def _learn(langs: list[str], sample: Iterable[tuple[str, str | None, int]]) -> LanguageModels | None:
    """Models of a sample's languages, texts and turns; texts of turn 0 are held back."""
    words: dict[str, Counter] = {x: Counter() for x in langs}
    back: dict[str, list[Counter]] = {x: [] for x in langs}
    for lang, text, turn in sample:
        of = Counter(letter_words(text))
        if not of:
            continue
        if turn == 0:
            back[lang].append(of)
        else:
            words[lang].update(of)
    for k, v in words.items():
        if not v and back[k]:
            for x in back.pop(k):
                v.update(x)
    words = {k: v for k, v in words.items() if v}
    if not words:
        return None
    models = LanguageModels(words)
    models.calibrate(
        {k: [(_dot(models, x), sum(map(len, x.elements()))) for x in v] for k, v in back.items() if k in words}, FALSE_REJECTION
    )
    return models


def _dot(models: LanguageModels, words: Counter) -> np.ndarray:
    return np.fromiter(words.values(), float, len(words)) @ models.score_words(list(words))


class Predictor:
    """Scores batches of texts; keeps the scores of words it has met."""

    def __init__(self, models: LanguageModels | None):
        self.models = models
        self.memo: dict[str, int] = {}
        self.memo_words = MEMO_SCORES // len(models.langs) if models else 0
        self.table = np.zeros((0, len(models.langs) if models else 0), np.float32)

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) + len(words) > self.memo_words:
            self.memo.clear()
            self.table = self.table[:0]
        new = list(words)
        at = len(self.table)
        self.memo.update(zip(new, range(at, at + len(new)), strict=True))
        self.table = np.concatenate([self.table, self.models.score_words(new).astype(np.float32)])

    def predict_all(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float, float | None, bool]]:
        """Predictions in order; the new words of some texts are scored together."""
        waiting: list[list[str]] = []
        new: set[str] = set()
        n = 0
        for text in texts:
            words = letter_words(text)
            waiting.append(words)
            new.update(words)
            n += len(words)
            if len(new) >= WORDS_AT_ONCE or n >= ALL_AT_ONCE:
                yield from self._together(waiting, new)
                waiting, new, n = [], set(), 0
        yield from self._together(waiting, new)

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, certainty, cross-entropy in nats per letter, rejected."""
        return next(self.predict_all([text]))

    def _together(self, texts: list[list[str]], words: set[str]) -> Iterator[tuple[str, float, float | None, bool]]:
        if self.models is not None:
            unknown = words.difference(self.memo)
            if len(self.memo) + len(unknown) > self.memo_words:
                unknown = words  # the table starts anew
            self._learn(unknown)
        yield from map(self._predict, texts)

    def _predict(self, words: list[str]) -> tuple[str, float, float | None, bool]:
        if not words or self.models is None:
            return UNDETERMINED, 0.0, None, True
        places = list(map(self.memo.get, words))
        logs = self.table[np.array(places)].sum(axis=0, dtype=np.float64)
        letters = sum(map(len, words))
        entropy = -logs / letters
        best = int(np.argmin(entropy))
        odds = np.exp(-(entropy - entropy[best]) * min(letters, EVIDENCE))
        too_odd = self.models.excess(best, entropy[best], letters) > self.models.limit
        return self.models.langs[best], float(1 / odds.sum()), float(entropy[best]), bool(too_odd)


def identify(docs: DataFrame, models: LanguageModels | bytes | None, text: str = "text") -> DataFrame:
    """Adds ``lang_pred``, ``score`` (0 to 1), ``cross_entropy`` and ``rejected`` to ``docs``; ``models``: packed ones or not.

    The language with the least cross-entropy per letter wins, the first in order on a tie.
    Null texts, texts without a letter and empty models give ``und``, 0, null and rejected.
    Only the text decides, so repeated rows get the same prediction.  Other columns stay;
    columns with the names of the new ones are replaced.
    """
    small_batches(docs.sparkSession)
    shared = share(docs.sparkSession, models)

    @F.pandas_udf("lang_pred string, score double, cross_entropy double, rejected boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predictor = Predictor(shared.load())
        for batch in texts:
            yield pd.DataFrame(list(predictor.predict_all(batch)), columns=["lang_pred", "score", "cross_entropy", "rejected"])

    names = ["lang_pred", "score", "cross_entropy", "rejected"]
    out = docs.select(as_doc(docs), of(F.col(text)).alias("found"))
    return out.select(*from_doc(docs, *names), *[F.col("found").getField(n).alias(n) for n in names])
