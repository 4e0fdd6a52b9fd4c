"""What models cost the driver."""

import public_tokenizers
from pyspark.sql import DataFrame

from silkmill.llm import bpe, langid
from tests.llm.conftest import table

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_models_are_not_built_in_the_driver(spark, nasty, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("in the driver")

    monkeypatch.setattr(bpe, "load", refuse)
    monkeypatch.setattr(DataFrame, "toLocalIterator", refuse)
    docs = table(spark, nasty)
    assert bpe.encode_decode(docs, PATH).count() == len(nasty)
    packed = langid.fit_packed(docs)
    assert isinstance(packed, bytes) and langid.fit(docs).langs == ["en", "fr"]
    assert {r.lang_pred for r in langid.identify(docs, packed).collect()} == {"en", "fr", "und"}
