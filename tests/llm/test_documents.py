"""Language models, mixing, quality, personal data, tokens, lines, pipeline: against brute force."""

import hashlib
import math
import os
import pathlib
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from silkmill.llm import langid_model, lm_model, lm_scoring, queries, stages
from silkmill.llm.bpe_automaton import MergeAutomaton
from silkmill.llm.langid import Predictor, fit, held_out, identify
from silkmill.llm.langid_model import LanguageModels, letter_words
from silkmill.llm.line_dedup import dedup_lines
from silkmill.llm.lm_scoring import score_texts
from silkmill.llm.mixing import mix, permuted
from silkmill.llm.patience import align, common_blocks
from silkmill.llm.pii import KINDS, personal_data
from silkmill.llm.quality import RULES, binomial_tail, quality
from tests.llm.conftest import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def counts(*texts):
    return Counter(w for t in texts for w in t.split())


def plain_kneser_ney(words, alphabet_size):
    """log P of a word, by recursion over plain counters; ``words``: counts."""
    order, raw, starts = langid_model.ORDER, [Counter() for _ in range(langid_model.ORDER + 1)], set()
    for w, n in words.items():
        m = "^" + w + "$"
        for k in range(1, order + 1):
            for end in range(max(k - 1, 1), len(m)):
                raw[k][m[end - k + 1 : end + 1]] += n
                if end == k - 1:
                    starts.add(m[: end + 1])
    counts, discounts = [None] * (order + 1), [0.5] * (order + 1)
    for k in range(1, order + 1):
        before = Counter(g[1:] for g in raw[k + 1]) if k < order else {}
        counts[k] = {g: n if k == order or g in starts or g not in before else before[g] for g, n in raw[k].items()}
        ones, twos = (sum(c == x for c in counts[k].values()) for x in (1, 2))
        if ones and twos:
            discounts[k] = ones / (ones + 2 * twos)

    def p(context, c, k):
        if k == 0:
            return 1 / (alphabet_size + 4)
        of = {g: n for g, n in counts[k].items() if g[:-1] == context[len(context) - k + 1 :]}
        lower = p(context, c, k - 1)
        if not of:
            return lower
        total, d = sum(of.values()), discounts[k]
        return max(of.get(context[len(context) - k + 1 :] + c, 0) - d, 0) / total + d * len(of) / total * lower

    def score(w):
        m = "^" + w + "$"
        return sum(math.log(p(m[:n], m[n], min(order, n + 1))) for n in range(1, len(m)))

    return score


def test_language_models_are_plain_kneser_ney():
    r = random.Random(22)
    texts = {x: counts(" ".join("".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(60))) for x, letters in (("x", "aab"), ("y", "abc"))}
    m = LanguageModels(texts)
    asked = [*list(texts["x"])[:20], "abcabc", "zzz", "a", "cabz"]
    got = m.score_words(asked)
    for n, lang in enumerate(("x", "y")):
        plain = plain_kneser_ney(texts[lang], len(m.alphabet))
        assert np.allclose(got[:, n], [plain(w) for w in asked], atol=1e-4)


def test_letters_are_letters():
    assert letter_words("²½ Ⅷ 12_3") == [] and letter_words("Straße, ÉTÉ ªº µ²x") == ["straße", "été", "ªº", "µ", "x"]
    assert letter_words("हिन्दी में x²") == ["हिन्दी", "में", "x"] and letter_words(None) == []


def test_false_rejections_are_rare(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    models = fit(docs)
    out = identify(docs.where(held_out(F.col("doc_id"))).select("doc_id", "text"), models).where("lang_pred <> 'und'")
    n, bad = out.agg(F.count("*"), F.count_if("rejected")).first()
    assert n > 1500 and bad <= 0.006 * n  # 0.002 asked for; clean texts and junk together
    assert Predictor(models).predict("xqzv kwjq zzxx vvkq " * 30)[3]


def test_identify(spark, nasty):
    docs = table(spark, nasty)
    out = identify(docs, fit(docs))
    assert len(out.columns) == len(set(docs.columns) | {"lang_pred", "score", "cross_entropy", "rejected"})
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und")
    empty = table(spark, [])
    assert fit(empty) is None and identify(empty, None).count() == 0
    assert {r.lang_pred for r in identify(docs, None).collect()} == {"und"}
    assert [r.h for r in spark.range(20).select(held_out(F.col("id")).alias("h")).collect()] == [zlib.crc32(str(n).encode()) % 5 == 0 for n in range(20)]


def test_identify_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = identify(docs.where(held_out(F.col("doc_id"))), fit(docs)).collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out) and sum(r.rejected for r in out) <= 0.05 * len(out)


def test_every_language_is_learned(spark):
    r = random.Random(20)
    rows, of = [], {}
    ids = (i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5)
    for k in range(210):
        own = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(12)]
        for _ in range(3 if k < 205 else 1):
            i = next(ids)
            of[i] = f"l{k}"
            rows.append((i, " ".join(own * 2), of[i], None))
    docs = table(spark, rows, clash=False)
    models = fit(docs)
    assert len(models.langs) == 210 and np.isfinite(models.limit)
    assert {x.doc_id: x.lang_pred for x in identify(docs, models).collect()} == of
    odd = Predictor(models).predict("\u4e00\u4e8c\u4e09\u56db\u4e94\u516d " * 3000)
    assert odd[3]  # whatever language is predicted, such a text is rejected


def test_rejection():
    m = LanguageModels({"x": counts("abab ab ba aab " * 50)})
    p = Predictor(m)
    assert not p.predict("zzzz qqqq")[3]  # not calibrated
    r = random.Random(23)
    texts = [[r.choice(["abab", "ab", "ba", "aab"]) for _ in range(r.randint(2, 9))] for _ in range(60)]
    m.calibrate({"x": [(m.score_words(t).sum(axis=0), sum(map(len, t))) for t in texts]}, 0.01)
    assert p.predict("ab ab ba")[0] == "x" and not p.predict("ab abab ab abab")[3]
    assert p.predict("zzzz qqqq wwww " * 5)[3] and p.predict(None) == ("und", 0.0, None, True)


def water(sizes, weights):
    total, target, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        left = total - sum(3 * sizes[k] for k in range(len(sizes)) if k not in free)
        for k in free:
            target[k] = left * weights[k] / sum(weights[j] for j in free)
        over = {k for k in free if target[k] > 3 * sizes[k] + 1e-9}
        if not over:
            break
        for k in over:
            target[k] = 3.0 * sizes[k]
        free -= over
    return target


def test_mix(spark, nasty):
    docs = table(spark, nasty)
    got = mix(docs).taken().collect()
    assert len(got) == len(nasty)
    sizes = Counter()
    for _, t, _, s in nasty:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip([sizes[s] for s in order], water([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken, target = Counter(), {}
    for r in got:
        assert r.taken <= 3 * r.size and (r.size > 0 or r.taken == 0)
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for size, t in want.items():
        assert abs(target[size] - t) < 1e-6 * max(t, 1)
        assert abs(taken[size] - t) <= 64
    again = mix(docs.repartition(3)).taken().collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    texts = mix(docs).texts()
    assert texts.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in texts.collect()) == sum(r.taken for r in got)
    assert mix(table(spark, [])).taken().count() == 0 and mix(table(spark, [])).texts().count() == 0
    assert [r.taken for r in mix(table(spark, [(1, None, None, None)])).taken().collect()] == [0]


def test_permutation(spark):
    for n in (1, 2, 3, 5, 64, 999, 1000, 1001, 4096):
        got = [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit("key")).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or [r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit("other")).alias("p")).collect()] != got
    n = 10**11
    rows = spark.range(n - 20_000, n).select(permuted(F.col("id"), F.lit(n), F.lit("key")).alias("p")).collect()
    assert len({r.p for r in rows}) == 20_000 and all(0 <= r.p < n for r in rows)
    assert abs(sum(r.p for r in rows) / 20_000 / n - 0.5) < 0.01


def test_shard_counts_are_a_draw(spark):
    """Source counts of whole shards vary as a draw without replacement does, neither more nor less."""
    rows = [(k, "w " * 256, None, "abc"[k % 3]) for k in range(30_000)]
    m = mix(table(spark, rows, clash=False))
    quota = {r.source_no: r.slots for r in m.sources.collect()}
    total = sum(quota.values())
    counts = {(r.shard, r.source_no): r.n for r in m.shard_counts().collect()}
    full = total // 1024
    assert full > 100
    for s, q in quota.items():
        p = q / total
        of = np.array([counts.get((k, s), 0) for k in range(full)])
        variance = 1024 * p * (1 - p) * (total - 1024) / (total - 1)
        statistic = ((of - 1024 * p) ** 2).sum() / variance  # chi-square, about full degrees of freedom
        assert abs(statistic - full) < 5 * math.sqrt(2 * full)


def test_mix_against_brute_force(spark, nasty):
    """Blocks tile each source's words, slots take blocks round by round, and what a document loses is what the slots leave."""
    docs = table(spark, nasty, clash=False)
    m = mix(docs)
    pieces, slots, sources = (x.collect() for x in (m.pieces(), m.slots(), m.sources))
    at = {}
    for r in sorted(pieces, key=lambda r: (r.source_no, r.block, r.in_block)):
        block = at.setdefault((r.source_no, r.block), [])
        assert r.in_block == len(block) and r.n_words > 0
        block += [(r.chunk, r.row_no, r.from_word + k) for k in range(r.n_words)]
    size = {r.source_no: r.source_size for r in sources}
    for s, n in size.items():
        words = [w for (t, _), b in at.items() if t == s for w in b]
        assert len(words) == len(set(words)) == n and all(len(b) <= 64 for (t, _), b in at.items() if t == s)
    taken = Counter()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots) == sum(r.slots for r in sources)
    for s, group in ((r, [x for x in slots if x.source_no == r.source_no]) for r in sources):
        per = Counter((x.round, x.block) for x in group)
        assert set(per.values()) <= {1} and len(group) == s.slots
        for k in range(max((x.round for x in group), default=0)):
            assert sum(x.round == k for x in group) == s.blocks
        for x in group:
            taken.update((s.source_no, c, row) for c, row, _ in at[s.source_no, x.block][: x.words])
    got = Counter((r.size, r.source_size, r.taken) for r in m.taken().collect())
    key = {(r.source_no, r.chunk, r.row_no): (r.size, size[r.source_no]) for r in m.placed.collect()}
    assert got == Counter((*v, taken[k]) for k, v in key.items())


def test_binomial_tail(spark):
    cases = [(k, n, p) for n in (1, 10, 200, 5000) for p in (0.002, 0.1) for k in (0, 1, 5, n // 50) if k <= n]
    for p in (0.002, 0.1):
        mine = [(k, n) for k, n, q in cases if q == p]
        rows = spark.createDataFrame(mine, "k long, n long").select("k", "n", binomial_tail(F.col("k"), F.col("n"), p).alias("t")).collect()
        for r in rows:
            exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
            assert r.t == 1.0 if r.k >= r.n * p else abs(r.t - exact) < 1e-8 * max(exact, 1e-12) + 1e-12


def base_rule(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, nasty):
    docs = table(spark, nasty)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in nasty if i] + [(1, 0, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality(docs, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *[r[n] for n in names]) for r in got) == Counter((i, *base_rule(t)) for i, t, *_ in nasty)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and (not r.kept if failed else r.kept)  # too few labels: no cutoff
    assert quality(table(spark, []), labels).count() == 0
    assert quality(docs, labels.where("doc_id < 0")).where("kept = base_failed").count() == 0


def test_quality_cutoffs_hold(spark, words):
    r = random.Random(12)
    rows, marks = [], []
    for n in range(6000):
        bad = n % 5 == 0
        text = " ".join(r.choice(words) + ("###" if bad else "") for _ in range(25))
        rows.append((n, text, "en", "a"))
        marks.append((n, int(not bad), 0))
    got = {x.doc_id: x for x in quality(table(spark, rows, clash=False), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    good = [got[n] for n, q, _ in marks if q]
    bad = [got[n] for n, q, _ in marks if not q]
    assert sum(not x.kept for x in good) <= 0.01 * len(good)
    assert sum(not x.kept for x in bad) > 0.9 * len(bad) and all(set(x.failed_rules.split(",")) <= set(RULES) for x in bad if x.failed_rules)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        v = int(c) * (1 + n % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(t):
    out = []
    for n, p in enumerate(PATTERNS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (True, n == 1 and all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[n]:
                out.append((m.start(), n, m.end()))
    return ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in sorted(out))


def test_personal_data(spark, nasty):
    r = random.Random(13)
    signs = [*"a1@.+- ()_%", "4111 1111 1111 1111", "é", "255", "a@b.co", "+1 (650) 555-1234", "1.2.3.4", "\n", "😀", "001.02.3.255"]
    rows = [*nasty, *[(1000 + n, "".join(r.choice(signs) for _ in range(r.randint(0, 50))), "en", "a") for n in range(600)]]
    got = personal_data(table(spark, rows)).collect()
    assert Counter((x.doc_id, x.base_sha256) for x in got) == Counter((i, hashlib.sha256(base_spans(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert personal_data(table(spark, [])).count() == 0


def test_long_runs_are_quick(spark):
    rows = [(1, "1 " * 100_000, None, None), (2, "a" * 300_000, None, None), (3, "9" * 300_000, None, None), (4, "a." * 100_000 + "@", None, None), (5, "+1" + " 2" * 100_000, None, None)]
    assert {r.spans for r in personal_data(table(spark, rows)).collect()} == {""}


def test_many_matches_in_one_text(spark):
    """Work grows as the matches, not as their square: one text holds 10^5 of them, with what lies between and beside."""
    n = 50_000
    emails, mixed = "é a@b.co " * n, "+1 650 555 1234;4111 1111 1111 1111 a1b2c3d4e5f60718293a4b5c x@1.2.3.4 " * (n // 5)
    begun = time.monotonic()
    got = {r.doc_id: r for r in personal_data(table(spark, [(1, emails, None, None), (2, mixed * 2, None, None)]), real=True).collect()}
    assert time.monotonic() - begun < 90
    assert got[1].n_email == n and got[1].sanitised == "é [EMAIL] " * n and got[1].spans.endswith(f",email:{9 * n - 7}:{9 * n - 1}")
    two = got[2]
    assert (two.n_email, two.n_ip, two.n_card, two.n_phone, two.n_secret) == (n // 5 * 2,) * 5
    assert two.sanitised == "[PHONE];[CARD] [SECRET] [EMAIL] " * (n // 5 * 2)


def test_disclosing_terms(spark, words):
    r = random.Random(14)
    def some(n):
        return " ".join(r.choice(words) for _ in range(n))
    rows = [(n, some(30), None, None) for n in range(100)] + [(100 + n, f"{some(20)} Zorblax wrote zor@lax.com {some(20)}", None, None) for n in range(5)]
    rows += [(200, "then ZORBLAX, again", None, None)] + [(300 + n, "same text Quux quux@quux.org here", None, None) for n in range(9)]
    got = {x.doc_id: x for x in personal_data(table(spark, rows), real=True).collect()}
    assert got[200].spans == "term:5:12" and got[200].sanitised == "then [TERM], again"
    assert "[TERM]" in got[100].sanitised and "zor@" not in got[100].sanitised and "[EMAIL]" in got[100].sanitised
    assert got[300].n_term == 0  # one context, however often it is copied
    key = "a1b2c3d4e5f60718293a4b5c"
    rows = [(n, f"{some(9)} Bo wrote zz@lax.com {some(n % 5)}", None, None) for n in range(8)] + [(50, f"token = \"{key}\" " + "a" * 30, None, None)]
    rows += [(100 + n, some(30), None, None) for n in range(60)]
    got = {x.doc_id: x for x in personal_data(table(spark, rows), real=True).collect()}
    assert got[50].n_secret == 1 and got[50].spans == "secret:9:33" and "[SECRET]" in got[50].sanitised and key not in got[50].sanitised
    assert "[TERM] wrote [EMAIL]" in got[0].sanitised  # two letters can be a name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_duckdb(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), duck.execute(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs) > 0
    assert sorted(map(str, ours[sorted(ours)].values.tolist())) == sorted(map(str, theirs[sorted(ours)].values.tolist()))


def test_tokens(spark, nasty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from silkmill.llm.bpe import WordBpe, encode_decode, load

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = encode_decode(table(spark, nasty), path, token_ids=True, decoded=True).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (str(len(ids)) if isinstance(r.n_tokens, str) else len(ids), sha(" ".join(map(str, ids))), sha(out))
        assert list(r.token_ids) == ids and r.decoded == out
    assert encode_decode(table(spark, []), path).count() == 0
    ours = WordBpe(*load(path))
    rand = random.Random(15)
    signs = ["a", "aa", "A", "é", "É", "Σ", "İ", "ß", "ſ", " ", "\t", "\x1c", "\u0085", "​", " ", " ", "'s", "'RE", "1", "²", "½", "中", "한", "😀", "́", "<|endoftext|>", "<|", "th", "ing", "!!", "\x00", "x" * 30]
    for _ in range(3000):
        text = "".join(rand.choice(signs) for _ in range(rand.randint(0, 25)))
        assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids
    for _ in range(3000):
        text = "".join(rand.choice("aehinrst") for _ in range(rand.randint(1, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids and ours.decode(ids) == library.decode(ids, skip_special_tokens=False)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}b"
            assert ours.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_automaton_against_applied_merges():
    """Random merge lists, also of equal parts and of parts that never meet, against merging in order."""
    r = random.Random(21)
    for _ in range(150):
        tokens, merges = ["a", "b", "c"], []
        vocab = {x: n for n, x in enumerate(["a", "b", "c", "a$", "b$", "c$"])}
        tokens = list(vocab)
        for _ in range(r.randint(1, 25)):
            u, v = r.choice([x for x in tokens if "$" not in x]), r.choice(tokens)
            if u + v not in vocab:
                vocab[u + v] = len(vocab)
                merges.append((u, v))
                tokens.append(u + v)
        automaton = MergeAutomaton(vocab, merges, "$")
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 14)))
            parts = [*word[:-1], word[-1] + "$"]
            for u, v in merges:
                k = 0
                while k < len(parts) - 1:
                    if (parts[k], parts[k + 1]) == (u, v):
                        parts[k : k + 2] = [u + v]
                    k += 1
            assert [*map(vocab.get, parts)] == automaton.encode_word(word), (merges, word)


def test_alignment():
    r = random.Random(16)
    for _ in range(2000):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in range(2))
        m = align(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
        assert align(a, a) == [(i, i) for i in range(len(a))]
        assert sum(n for *_, n in common_blocks(a, b)) == len(m)


def test_alignment_without_unique_lines():
    assert align([7, 1, 1, 2, 2, 8], [1, 1, 2, 2]) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert common_blocks([7, 1, 8], [9, 1, 5, 1, 6]) == [(1, 1, 1)]
    r = random.Random(17)
    for _ in range(2000):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 12))] for _ in range(2))
        m = align(a, b)
        for (i, j), (k, n) in zip([(-1, -1), *m], [*m, (len(a), len(b))], strict=True):
            assert not set(a[i + 1 : k]) & set(b[j + 1 : n])  # nothing common is given up


def slow_blocks(a, b):
    """Aligned runs of two lists by plain recursion and quadratic search, apart from the operator's own code."""
    found = set()

    def part(i, n, j, m):
        if i < n and j < m and a[i] == b[j]:
            found.add((i, j))
            return part(i + 1, n, j + 1, m)
        if i < n and j < m and a[n - 1] == b[m - 1]:
            found.add((n - 1, m - 1))
            return part(i, n - 1, j, m - 1)
        ours, theirs = a[i:n], b[j:m]
        pairs = [(i + x, j + theirs.index(v)) for x, v in enumerate(ours) if ours.count(v) == 1 == theirs.count(v)]
        if not pairs:  # the n-th of each line with the n-th there
            pairs = [(i + x, j + y) for x, v in enumerate(ours) for y, w in enumerate(theirs) if v == w and ours[:x].count(v) == theirs[:y].count(v)]
        rank = []
        for x, (_, y) in enumerate(pairs):
            rank.append(1 + max((rank[z] for z in range(x) if pairs[z][1] < y), default=0))
        chain = []
        for r in range(max(rank, default=0), 0, -1):  # the latest end, and before each the latest that leads to it
            chain.append(max(x for x, y in enumerate(rank) if y == r and (not chain or x < chain[-1] and pairs[x][1] < pairs[chain[-1]][1])))
        ends = [pairs[x] for x in reversed(chain)]
        for (p, q), (r, s) in zip([(i - 1, j - 1), *ends], [*ends, (n, m)], strict=True):
            if ends:
                part(p + 1, r, q + 1, s)
        found.update(ends)
        return None

    part(0, len(a), 0, len(b))
    out = []
    for i, j in sorted(found):
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (i, j):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def test_alignment_against_plain_recursion():
    r = random.Random(21)
    for kinds, most in ((4, 9), (9, 12), (30, 30)):
        for _ in range(700):
            a, b = ([r.randint(0, kinds) for _ in range(r.randint(0, most))] for _ in range(2))
            assert common_blocks(a, b) == slow_blocks(a, b)


def test_lines(spark, nasty):
    rows = [x for x in nasty if x[0] is not None]
    got = dedup_lines(table(spark, rows)).collect()
    first = {}
    for i, t, *_ in sorted(rows, key=lambda x: x[0]):
        for line in (t or "").split("\n"):
            if len(WORD.findall(line)) >= 5:
                first.setdefault(line, i)
    texts = {i: (t or "").split("\n") for i, t, *_ in rows}
    for r in got:
        mine, gone = texts[r.doc_id], set()
        for other in {first[x] for x in mine if first.get(x, r.doc_id) < r.doc_id}:
            for _, j, n in slow_blocks(texts[other], mine):
                if any(len(WORD.findall(x)) >= 5 for x in mine[j : j + n]):
                    gone |= set(range(j, j + n))
        assert r._n_removed == len(gone)
        assert (r.text or "") == "\n".join(x for k, x in enumerate(mine) if k not in gone)
    assert next(r for r in got if r.doc_id == 10)._n_removed == 8
    assert dedup_lines(table(spark, [])).count() == 0
    assert len(dedup_lines(table(spark, nasty)).collect()) == len(nasty)


def test_lines_against_all_earlier_documents(spark):
    r = random.Random(18)
    stock = [f"line {k} of five words" for k in range(6)] + ["short", "", "two words"]
    rows = [(1, "one two three four a\none two three four b", None, None), (2, "one two three four b\none two three four a\nx", None, None)]
    rows += [(3, "y\none two three four a\none two three four b", None, None)]  # the earliest holder is not enough for 2's copy
    rows += [(4, "z\none two three four b\none two three four a\nq", None, None)]
    for k in range(10, 250):
        lines = [r.choice(stock) if r.random() < 0.7 else f"{k} {r.random()}" for _ in range(r.randint(1, 9))]
        rows.append((k // 2 * 2 if r.random() < 0.1 else k, "\n".join(lines), None, None))
    got = {(x.doc_id, x.kept): x._n_removed for x in dedup_lines(table(spark, rows, clash=False)).withColumnRenamed("text", "kept").collect()}
    long_ = lambda x: len(WORD.findall(x)) >= 5
    want = {}
    for i, t, *_ in rows:
        mine, gone = t.split("\n"), set()
        for e, u, *_ in rows:
            if e < i and any(map(long_, set(u.split("\n")) & set(mine))):
                for _, j, n in slow_blocks(u.split("\n"), mine):
                    if any(map(long_, mine[j : j + n])):
                        gone |= set(range(j, j + n))
        want[i, "\n".join(x for k, x in enumerate(mine) if k not in gone)] = len(gone)
    assert got == want
    assert got[4, "z\nq"] == 2


def test_lines_without_spaces(spark):
    line = "这一行没有空格但是足够长"
    rows = [(1, f"甲\n{line}\n乙", None, None), (2, f"{line}\n短", None, None), (3, "短\n短", None, None)]
    got = {r.doc_id: r.text for r in dedup_lines(table(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "短", 3: "短\n短"}


def test_scores(spark, nasty):
    got = score_texts(table(spark, nasty)).collect()
    assert len(got) == len(nasty)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count, ends = Counter(), 0
    for i, t, *_ in nasty:
        if not held(i):
            count.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    want = Counter()
    for i, t, *_ in nasty:
        c = [count[w] for w in (t or "").encode().lower().split()] + [ends]
        want[i, held(i), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c), 4)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert score_texts(table(spark, [])).count() == 0


def plain_scores(rows):
    """log10 of each text by a smoothed bigram model over plain dictionaries."""
    def marked(t):
        return [b"^", *(t or "").encode().lower().split(), b"$"]

    one, two = Counter(), Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            one.update(marked(t))
            two.update(zip(marked(t), marked(t)[1:], strict=False))
    n, v = sum(one.values()) - one[b"^"], len(one) - (one[b"^"] > 0)
    p = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))
    return [
        (len(marked(t)) - 1, sum(math.log10((two[x, y] + lm_model.MU * p(y)) / (one[x] + lm_model.MU)) for x, y in zip(marked(t), marked(t)[1:], strict=False)))
        for _, t in rows
    ]


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_those_of_a_plain_model(spark, nasty, monkeypatch, small):
    if small:  # many blocks and shards, frequent contexts dealt to all shards
        for name in ("SHARD_BYTES", "BLOCK_BYTES"):
            monkeypatch.setattr(lm_scoring, name, 5000)
        monkeypatch.setattr(lm_scoring, "SPLIT_FROM", 20)
    rows = [(i, t) for i, t, *_ in nasty] + [(10_000 + k, "the cat sat on the mat " * (k % 3 + 1)) for k in range(40)]
    got = score_texts(table(spark, [(i, t, None, None) for i, t in rows], clash=False)).collect()
    ours = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    plain = sorted((str(i), n, x) for (i, _), (n, x) in zip(rows, plain_scores(rows), strict=True))
    assert len(ours) == len(plain)
    for a, b in zip(ours, plain, strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) <= a[1] * 0.5 / lm_model.STEPS + 1e-6


def test_scores_of_held_out_texts_beat_the_base(spark):
    out = score_texts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.95 * out[1]


def test_order_of_words_counts(spark):
    words = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join(words), None, None) for k in range(1, 30)] + [(100, " ".join(reversed(words)), None, None)]
    got = {r.doc_id: r for r in score_texts(table(spark, rows, clash=False)).collect()}
    assert got[1].score > got[100].score and got[1].base_score == pytest.approx(got[100].base_score)


REMOTE = """
import sys
sys.path.insert(0, sys.argv[1])
from silkmill.session import session
spark = session("remote", "local[2]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"})
from silkmill.llm import queries
for name in ("op1_langid", "op5_lm_scoring", "op8_bpe"):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() == 200, name
print("all ran")
"""


def test_executors_need_no_installed_package(tmp_path):
    """The package is on the driver's path alone; workers start without it."""
    root = str(pathlib.Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", REMOTE, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in got.stdout, got.stderr[-2000:]


def kept_lines_by_hand(rows):
    """Texts less what aligns with any earlier document, all of them compared; documents that lose every word go. Ids are not null."""
    long_ = lambda x: len(WORD.findall(x)) >= 5
    out = []
    for i, t in rows:
        mine, gone = (t or "").split("\n"), set()
        for e, u in rows:
            if e < i and any(map(long_, set((u or "").split("\n")) & set(mine))):
                for _, j, n in slow_blocks((u or "").split("\n"), mine):
                    if any(map(long_, mine[j : j + n])):
                        gone |= set(range(j, j + n))
        left = "\n".join(x for k, x in enumerate(mine) if k not in gone)
        if not gone or WORD.search(left):
            out.append((i, left if gone else t))
    return out


def test_pipeline(spark, nasty):
    """Every stage against its rule, over what the stages before it kept; columns with the names that stages use, and others, stay."""
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tests.llm.test_search import grouped, slow_fingerprint

    docs = table(spark, [x for x in nasty if x[0] is not None]).withColumn("token_ids", F.lit("own")).withColumn("_n_removed", F.lit(1))
    names, key = docs.columns, lambda f: sorted((r.doc_id, r.text) for r in f)
    kept = [docs.collect()]
    for name, stage in stages.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(kept[-1], docs.schema), SF)
        assert out.columns == names, name
        kept.append(out.collect())
    given, known, lines, near, mixed = kept
    told = {(r.doc_id, r.text): r.rejected for r in identify(docs.select("doc_id", "text"), fit(docs)).collect()}
    assert key(known) == sorted((r.doc_id, r.text) for r in given if not told[r.doc_id, r.text]) and 10 < len(known) < len(given)
    assert key(lines) == sorted(kept_lines_by_hand([(r.doc_id, r.text) for r in known])) and lines != known
    prints = {r.doc_id: slow_fingerprint(r.text) for r in lines}
    every = sorted(set(prints.values()))
    label = grouped([(x, y) for n, x in enumerate(every) for y in every[:n] if (x ^ y).bit_count() <= 4], every)
    heads = {}
    for i, x in prints.items():
        heads[label[x]] = min(heads.get(label[x], i), i)
    assert sorted(r.doc_id for r in near) == sorted(heads.values()) and len(near) < len(lines)
    counts_ = lambda t: len(WORD.findall(t or ""))
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += counts_(r.text)
    want = {r.doc_id: r.taken for r in mix(spark.createDataFrame(near, docs.schema)).taken().collect()}
    assert {k: v for k, v in want.items() if v} == dict(taken) and all(taken[r.doc_id] <= 3 * counts_(r.text) for r in near)
    last = stages.STAGES[-1][1](spark, spark.createDataFrame(mixed, docs.schema), SF)
    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    tokenizer.no_truncation()
    ids = [tokenizer.encode(r.text or "", add_special_tokens=False).ids for r in mixed]
    assert sorted((r.doc_id, list(r.token_ids)) for r in last.collect()) == sorted((r.doc_id, x) for r, x in zip(mixed, ids, strict=True))
    assert set(names) - {"text"} <= set(last.columns) and "text" not in last.columns


def test_pipeline_of_an_empty_table(spark):
    docs = table(spark, [])
    for _, stage in stages.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_subpackage_is_apart():
    """Nothing else in the library imports it."""
    root = pathlib.Path(__file__).resolve().parents[2] / "silkmill"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "silkmill.llm" not in p.read_text(encoding="utf-8"), p


def test_arrow_batches_are_bounded_by_bytes_and_a_session_setting_is_kept(spark):
    from silkmill.llm.common import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        small_batches(spark)
        assert spark.conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "12345")
        small_batches(spark)
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
