"""Top-k, fingerprints, suffix arrays, automaton, trie: against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from silkmill.llm import anchors as anchor_module
from silkmill.llm.bit_sliced import SlicedBlock, top_k
from silkmill.llm.common import components
from silkmill.llm.elias_fano import EliasFano, Trie
from silkmill.llm.lm_model import answered, decoded, learned, log_unigram
from silkmill.llm.simhash import drop_near_duplicates, key_masks, links, near_duplicates
from silkmill.llm.simhash_fp import fingerprint
from silkmill.llm.suffix_array import common_prefixes, repeats, suffix_array
from silkmill.llm.suffix_dedup import remove_repeats
from tests.llm.conftest import table


def grouped(links_, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links_:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_near_duplicates_build_no_table_in_the_driver(spark):
    """Joins of fingerprints are shuffled, whatever the session lets the driver broadcast."""
    out = near_duplicates(spark.createDataFrame([(i, f"a b c d e {i % 5}") for i in range(40)], "doc_id long, text string"))
    assert len(out.collect()) == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_components(spark):
    r = random.Random(1)
    edges = [(n, n + 1) for n in range(1000, 1040)] + [(0, n) for n in range(1, 30)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)]
    got = {x.node: x.label for x in components(spark.createDataFrame([*edges, (5, 5), (None, 3)], "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    # A node whose only link is to itself is in no component.
    assert got == {n: c for n, c in grouped(edges, nodes).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keys_find_every_close_pair():
    r = random.Random(2)
    masks = key_masks()
    for _ in range(3000):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_links_of_a_dense_group(spark):
    r = random.Random(4)
    center = r.getrandbits(63)
    prints = {center}
    for _ in range(400):
        x = center
        for bit in r.sample(range(63), r.randint(0, 5)):
            x ^= 1 << bit
        prints.add(x)
    prints |= {r.getrandbits(63) for _ in range(300)}
    got = {x.fp: x.label for x in links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    every = sorted(prints)
    want = grouped([(a, b) for n, a in enumerate(every) for b in every[:n] if (a ^ b).bit_count() <= 4], every)
    size = Counter(want.values())
    classes = {}
    for p in every:
        if size[want[p]] > 1:
            assert classes.setdefault(want[p], got[p]) == got[p]
    assert len(set(classes.values())) == len(classes)


def slow_fingerprint(text):
    ws = (text or "").encode().lower().split()
    runs = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))] if ws else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(x, 42) >> bit & 1 for x in runs) > len(runs):
            out |= 1 << bit
    return out


def test_near_duplicates(spark, nasty):
    got = near_duplicates(table(spark, nasty)).collect()
    assert len(got) == len(nasty)
    prints = {(i, t): slow_fingerprint(t) for i, t, *_ in nasty}
    assert Counter((x.doc_id, x.fingerprint) for x in got) == Counter((i, f"{prints[i, t]:016x}") for i, t, *_ in nasty)
    every = sorted(set(prints.values()))
    label = grouped([(a, b) for n, a in enumerate(every) for b in every[:n] if (a ^ b).bit_count() <= 4], every)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    for x in got:
        assert x.component_id == least[label[int(x.fingerprint, 16)]]
    kept = drop_near_duplicates(table(spark, nasty))
    assert kept.columns == table(spark, nasty).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert near_duplicates(table(spark, [])).count() == 0 and drop_near_duplicates(table(spark, [])).count() == 0
    assert fingerprint(" \n") == 0 == fingerprint(None)


@pytest.mark.parametrize("low,high", [(-600, 600), (0, 3), (-5, 0), (7, 8)])
def test_sliced_block(low, high):
    r = np.random.default_rng(5)
    rows = r.integers(low, high, (500, 16))
    ids = r.permutation(500)
    block = SlicedBlock.from_bytes(SlicedBlock.build(rows).to_bytes())
    for n in range(0, 500, 25):
        score = rows @ rows[n]
        want = [x for x in np.lexsort((ids, -score)) if x != n][:10]
        at, got = block.top(rows[n], ids, np.arange(500) == n, 10)
        assert list(ids[at]) == list(ids[want]) and list(got) == list(score[want])


def test_top_k(spark):
    r = random.Random(6)
    rows = [(n, [r.gauss(0, 0.2) for _ in range(8)]) for n in range(300)]
    rows += [(300, rows[100][1]), (100, rows[100][1]), (301, None), (302, [None] * 8), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [0.1] * 8), (305, [0.5] * 3), (306, [])]
    v = spark.createDataFrame([(i, e, 1) for i, e in rows], "vec_id long, embedding array<float>, dims int")
    got = top_k(v, F.col("vec_id") % 100 == 0).collect()
    ok = [(i, np.floor(1024 * np.array(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e and len(e) == 8 and None not in e and np.isfinite(e).all()]
    want = []
    for n, (i, q) in enumerate(ok):
        if i % 100 == 0:
            every = sorted((-int(q @ x), j) for m, (j, x) in enumerate(ok) if m != n)[:10]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(every)]
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)
    assert top_k(v.where("vec_id < 0"), F.col("vec_id") % 100 == 0).count() == 0


def test_suffix_array():
    r = random.Random(8)
    for _ in range(300):
        b = bytes(r.choice(r.choice([b"ab", b"abc", b"a", bytes(range(256))])) for _ in range(r.randint(0, 200)))
        s, depth = np.frombuffer(b, np.uint8), r.choice([3, 8, 20])
        order = suffix_array(s, depth)
        assert sorted(order) == list(range(len(b)))
        heads = [b[i : i + depth] for i in order]
        assert heads == sorted(heads)
        lcp = common_prefixes(s, order, depth)
        for k in range(1, len(order)):
            x, y = heads[k - 1], heads[k]
            same = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert lcp[k] == same
        rank = np.arange(len(b))
        rank[max(0, len(b) - depth + 1) :] = -1
        seen, want = set(), set()
        for i in range(len(b) - depth + 1):
            if b[i : i + depth] in seen:
                want.add(i)
            seen.add(b[i : i + depth])
        assert set(repeats(s, rank, depth).tolist()) == want


def test_anchors(monkeypatch):
    r = random.Random(9)
    for _ in range(150):
        docs = [bytes(r.choice(r.choice([b"ab", b"abcd", b"a", bytes(range(256))])) for _ in range(r.randint(0, 400))) for _ in range(r.randint(1, 4))]
        monkeypatch.setattr(anchor_module, "BLOCK", r.choice([64, 100, 1 << 20]))
        starts = np.cumsum([0, *map(len, docs[:-1])])
        got, _ = anchor_module.anchors(b"".join(docs), starts)
        want = set()
        for start, d in zip(starts, docs, strict=True):
            if len(d) >= 100:
                h = anchor_module.anchor_hashes(np.frombuffer(d, np.uint8)) >> np.uint64(21)
                want |= {int(start) + i + int(np.argmin(h[i : i + anchor_module.SPAN])) for i in range(len(d) - 99)}
        assert set(got.tolist()) == want


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), n, hashlib.sha256(kept).hexdigest())
    return out


def test_remove_repeats(spark, nasty):
    rows = {i: (i, t) for i, t, *_ in nasty if i is not None}
    passage = "The very same passage stands here, é and all, and goes on for well over one hundred bytes, twice. "
    rows |= {100 + k: (100 + k, f"{k} " * k + passage * (1 + k % 3) + f" end {k}") for k in range(12)}
    want = brute_repeats(rows.values())
    got = remove_repeats(table(spark, [(i, t, None, None) for i, t in rows.values()])).collect()
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want
    real = remove_repeats(table(spark, [(i, t, None, None) for i, t in rows.values()]), real=True).collect()
    assert {x.doc_id: hashlib.sha256(bytes(x.kept)).hexdigest() for x in real} == {i: w[3] for i, w in want.items()}


def test_remove_repeats_of_equal_rows(spark, nasty):
    got = remove_repeats(table(spark, nasty)).collect()
    assert len(got) == len(nasty)
    twice = sorted((x.n_removed for x in got if x.doc_id == 11))
    assert twice[1] == 800 and twice[0] < 800
    assert [x.n_removed for x in got if x.doc_id is None and x.n_bytes] == [len(nasty[0][1])]
    assert remove_repeats(table(spark, [])).count() == 0


def test_elias_fano():
    r = np.random.default_rng(10)
    for n, top in ((0, 1), (1, 5), (300, 40), (300, 10**9), (2000, 2000), (5000, 1 << 60)):
        values = np.sort(r.integers(0, top, n))
        ef = EliasFano.build(values)
        assert ef.access(np.arange(n)).tolist() == values.tolist()
        asked = np.unique(np.concatenate([values, values + 1, np.maximum(values - 1, 0), r.integers(0, 2 * top, 500), [0, top, 1 << 61]]))
        held = set(values.tolist())
        at = ef.place(asked)
        assert [(x, values[k] if k >= 0 else None) for x, k in zip(asked.tolist(), at.tolist(), strict=True)] == [(x, x if x in held else None) for x in asked.tolist()]
        first = np.searchsorted(values, asked)
        assert (at[at >= 0] == first[at >= 0]).all()  # of equal values the first
        if n > 10:
            begin, end = np.full(len(asked), 3), np.full(len(asked), n - 3)
            within = ef.place(asked, begin, end)
            assert [x >= 0 for x in within.tolist()] == [x in set(values[3 : n - 3].tolist()) for x in asked.tolist()] and within.max() < n - 3


def test_trie_finds_what_it_holds():
    r = np.random.default_rng(11)
    for n, contexts, width in ((0, 5, 5), (1, 3, 3), (4000, 50, 3000), (3000, 100_000, 10), (2000, 10**9, 10**9)):
        pairs = np.unique(np.stack([r.integers(0, contexts, n), r.integers(0, width, n)], 1), axis=0)
        held = pairs[r.random(len(pairs)) < 0.6]
        codes = r.integers(0, 65536, len(held)).astype(np.uint16)
        contexts_, begin = np.unique(held[:, 0], return_index=True)
        trie = Trie.build(contexts_, np.append(begin, len(held)), held[:, 1], codes, int(held[:, 1].max(initial=0)) + 1)
        trie = Trie.mapped(trie.to_bytes())
        where = {tuple(x): k for k, x in enumerate(held.tolist())}
        near = np.unique(np.concatenate([pairs, pairs + [0, 1], pairs + [1, 0]]), axis=0)
        assert trie.find(near[:, 0], near[:, 1]).tolist() == [where.get(tuple(x), -1) for x in near.tolist()]
        assert trie.codes.tolist() == codes.tolist()


def test_bigrams_are_a_distribution():
    r = random.Random(12)
    vocabulary = 30
    text = [r.randrange(1, vocabulary) for _ in range(2000)]
    unigrams, bigrams = Counter(text), Counter(zip(text, text[1:], strict=False))
    log1 = {w: log_unigram(np.array([unigrams[w]]), len(text), len(unigrams))[0] for w in range(vocabulary)}  # 0: all unknown words
    for v in (1, 7):
        of = {w: bigrams[v, w] for w in range(vocabulary)}
        n = vocabulary
        asked = (np.full(n, v), np.arange(n), np.array([of[w] for w in range(n)]), np.full(n, sum(of.values())), np.array([log1[w] for w in range(n)]))
        trie = learned(*asked)
        assert len(trie.codes) == sum(x > 0 for x in of.values())
        codes = answered(trie, asked[0], asked[1], *asked[3:])
        assert abs((10 ** decoded(codes)).sum() - 1) < 1e-3
        none = learned(*(x[:0] for x in asked))
        assert (10 ** decoded(answered(none, asked[0], asked[1], *asked[3:]))).sum() < 0.9  # all is in the trie: without it the bigrams are missing


def test_levels_are_compact():
    r = np.random.default_rng(3)
    n = 200_000
    context = r.integers(0, 1 << 20, n // 4)
    pairs = np.unique(np.stack([context[r.integers(0, n // 4, n)], r.integers(0, 1 << 20, n)], 1), axis=0)
    trie = learned(pairs[:, 0], pairs[:, 1], np.ones(len(pairs), np.int64), np.full(len(pairs), 9), np.full(len(pairs), -4.0))
    plain = pairs.nbytes + 2 * len(pairs)
    assert len(trie.to_bytes()) < 0.5 * plain


def test_crc_is_the_same_everywhere(spark):
    got = [r.c for r in spark.range(50).select(F.crc32(F.col("id").cast("string")).alias("c")).collect()]
    assert got == [zlib.crc32(str(n).encode()) for n in range(50)]
