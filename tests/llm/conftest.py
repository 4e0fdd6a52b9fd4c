import random

import pytest

#: Columns whose names operators use inside.
CLASH = (
    "fp long, label string, score double, size long, h long, h1 long, o long, _h long, _o long, n_words long, base string, terms string, "
    "stratum string, rejected string, lang_pred string, n_tokens string, chunk int, taken string, target string, kept string, `a.b` int"
)


def table(spark, rows, clash=True):
    """Documents from (doc_id, text, lang, source) with columns of clashing names."""
    extra = CLASH if clash else ""
    n = extra.count(",") + 1 if extra else 0
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {extra}" if extra else "")
    return spark.createDataFrame([(i, t, la, s, len(t or ""), *[None] * n) for i, t, la, s in rows], schema)


@pytest.fixture(scope="session")
def words():
    r = random.Random(7)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def nasty(words):
    """Nulls, empty and long texts, ties, copies, near copies, repeated rows."""
    r = random.Random(3)
    def prose(n):
        return " ".join(r.choice(words) for _ in range(n))
    base = prose(300)
    near = base.split()
    near[150] = "changed"
    long_ = prose(30_000)
    lines = "\n".join(prose(12) for _ in range(8))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, " ".join(near), "en", None), (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n\x0b ", "fr", "b"),
        (7, long_, "fr", "c"), (8, "Zürich <|endoftext|> été 😀 a@b.co +1 (650) 555-1234 1.2.3.4", "fr", "c"), (None, base, None, None), (None, None, None, None),
        (9, lines, "en", "c"), (10, prose(20) + "\n" + lines + "\n" + prose(15), "en", "c"), (11, "x " * 400, "en", "a"), (11, "x " * 400, "en", "a"),
        (12, "4111 1111 1111 1111 " * 30, "en", "a"), (13, "\x00\x01 odd \u0085 white space", "en", "\U0001F600"), (14, "12345 !!! 678", "en", "\uffff"),
    ]
    return rows + [(20 + k, prose(r.randint(1, 200)), r.choice(["en", "fr"]), r.choice(["a", "b", "c"])) for k in range(30)]
