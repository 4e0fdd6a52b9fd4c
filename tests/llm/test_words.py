"""What words cost the tokenizer."""

import random

import public_tokenizers
import pytest

from silkmill.llm import bpe
from silkmill.llm.bpe_automaton import SHORT

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(PATH)


def test_frequent_words_outlive_a_full_memo(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    ours, asked = bpe.WordBpe(*tokenizer), []
    encode = ours.automaton.encode_word
    monkeypatch.setattr(ours.automaton, "encode_word", lambda x: asked.append(x) or encode(x))
    text = " ".join(f"often {chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(10))
    assert ours.decode(ours.encode(text)).count("often") == 100
    assert asked.count("often") == 1


def test_short_words_take_the_long_words_path(tokenizer):
    r = random.Random(1)
    automaton = tokenizer[0]
    for _ in range(3000):
        word = "".join(r.choice("aaeehinrstolzqx0Ã©!") for _ in range(r.randint(1, SHORT)))
        assert automaton.encode_word(word) == automaton._encode_long(word)


def test_short_words_ask_for_few_of_their_beginnings(tokenizer):
    automaton = tokenizer[0]
    automaton.places.clear()
    automaton.encode_word("internationalisation")
    assert len(automaton.places) < len("internationalisation") // 2
