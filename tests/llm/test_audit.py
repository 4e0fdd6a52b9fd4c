"""Filter audit, near-duplicate vectors and fill-in-the-middle against brute force."""

import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silkmill.llm import embedding_dedup
from silkmill.llm.embedding_dedup import Block, Forest, near_vectors
from silkmill.llm.fill_middle import BitVector, fill_middle, restored
from silkmill.llm.filter_audit import filter_audit
from tests.llm.conftest import table


# Fill in the middle


@pytest.mark.parametrize("n", [1, 63, 64, 65, 511, 512, 513, 5000])
@pytest.mark.parametrize("density", [0.0, 0.02, 0.5, 1.0])
def test_rank_and_select(n, density):
    flags = np.random.default_rng(n).random(n) < density
    bits, ones = BitVector(flags), np.flatnonzero(flags)
    at = np.arange(n + 1)
    assert bits.rank(at).tolist() == [int(flags[:k].sum()) for k in at]
    assert bits.select(np.arange(len(ones))).tolist() == ones.tolist()


def cut_by_hand(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < spm:
        return len(lines), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(lines), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (30, 0), (0, 100)])
def test_fill_middle(spark, nasty, rate, spm):
    more = [
        (101, "\n", None, None), (102, "\n\n\n", None, None), (103, "a\nb\r\nc", None, None), (104, "é\n😀\n\nz", None, None), (105, "x<P>\ny", None, None),
        (106, "$1 \\ <S\n> <P\n<\n<S\n<M\n", None, None), (107, "line\n" * 40_000, None, None), (108, "no end " * 100_000, None, None),
    ]
    docs = table(spark, nasty + more)
    docs = docs.withColumn("form", F.lit("own")).withColumn("output", F.lit(1))
    out = fill_middle(docs, rate=rate, spm=spm)
    assert {"lang", "n_words", "a.b", "n", "form", "output"} <= set(out.columns)
    out = out.withColumn("again", restored(F.col("output"), F.col("form")))
    got = sorted(repr((r.doc_id, r.text, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in out.collect())
    assert got == sorted(repr((i, t, cut_by_hand(i, t, rate, spm))) for i, t, *_ in nasty + more)
    assert out.where("again IS DISTINCT FROM coalesce(text, '')").count() == 0
    assert fill_middle(table(spark, [])).count() == 0


# Filters


def audited_by_hand(docs, labels):
    """(part, order, step) to the figures, one document after the other."""
    rows = []
    for i, text, lang, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        earlier = any((t or "") == text and j is not None and (i is None or j < i) for j, t, *_ in docs)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": earlier,
        }
        own = [(q, t) for j, q, t in labels if j is not None and j == i]
        rows.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    out, shapley = {}, {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
                out[part, order, step] = (
                    sum(not r[1] & (before | {f}) for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own), sum(r[1] == {f} for r in own),
                    sum(r[2] for r in here), sum(r[3] for r in here),
                )
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark, nasty, words):
    long_ = " ".join(words[:250])
    more = [(200, long_, "en", "a"), (201, long_, "fr", "a"), (201, long_, "fr", "a"), (199, long_ + " #", None, "a"), (None, long_, "", "a"), (202, long_.upper(), "en", "a"), (203, " \n" + long_ + "\n ", "en", "a")]
    labels = [(200, 1, 0), (200, 0, None), (201, None, 1), (1, 1, 1), (None, 1, 1), (7, 1, 0), (9999, 1, 1), (203, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit(table(spark, nasty + more), marks)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    want = audited_by_hand(nasty + more, labels)
    assert got == want and out.count() == len(want)
    assert filter_audit(table(spark, []), marks).count() == 0
    assert filter_audit(table(spark, nasty), marks.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


# Vectors


def near_by_hand(rows, threshold):
    def fit(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def cosine(a, b):
        x, y = (np.array(v, np.float64) / max(map(abs, v)) for v in (a, b))
        return float(x @ y / np.sqrt((x @ x) * (y @ y)))

    near = [[i != j and fit(a) and fit(b) and len(a) == len(b) and cosine(a, b) >= threshold for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    out = []
    for i, (own, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((own, sum(near[i]), least, own == least))
    return sorted(map(repr, out))


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("threshold", [0.9, 0.3])
def test_near_vectors(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(embedding_dedup, "MIN_ROWS", 16)  # several blocks
    r = np.random.default_rng(5)
    centres = r.normal(size=(12, 24))
    made = [c + r.normal(size=24) * s for c in centres for s in (0.0, 0.2, 0.3, 0.35, 0.4, 0.45)] + list(r.normal(size=(60, 24)))
    rows = [(1000 - k, np.float32(v).astype(float).tolist()) for k, v in enumerate(made)]
    rows += [(2000 + k, rows[3][1]) for k in range(9)] + [(7, rows[4][1]), (7, rows[4][1]), (7, rows[40][1]), (None, rows[5][1]), (None, rows[70][1])]
    rows += [
        (1, None), (2, []), (3, [0.0] * 24), (4, [None] + [1.0] * 23), (5, [float("nan")] * 24), (6, [float("inf")] + [1.0] * 23), (8, [1.0, 0.0]), (9, [2.0, 0.0]),
        (10, [-1.0, -0.0]), (11, [-1.0, 0.0]), (None, None), (None, None), (12, [1e-30, 0.0]), (13, [3.0e38, 1e30]), (14, [1.0]), (15, [-1.0]),
    ]
    vectors = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, key string, o int, label int")
    if kind == "float":
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = near_vectors(vectors, threshold)
    assert sorted(repr((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got.collect()) == near_by_hand(rows, threshold)
    assert near_vectors(vectors.limit(0)).count() == 0


def test_overflow_and_bad_threshold(spark):
    vectors = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1e-300]), (3, [1e300, -1e300])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(vectors).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    with pytest.raises(ValueError, match="threshold"):
        near_vectors(vectors, 0.0)


@pytest.mark.parametrize("dims", [2, 64, 2500])
def test_bounds_hold_and_no_pair_is_lost(dims):
    r = np.random.default_rng(dims)
    base = r.normal(size=(1, dims))
    rows = (base + r.normal(size=(700, dims)) * r.uniform(0.05, 0.7, size=(700, 1))).astype(np.float32)
    one, two = Block(rows[:400]), Block(rows[400:])
    full = rows.astype(np.float64)
    unit = full / np.linalg.norm(full, axis=1)[:, None]
    exact = unit[:400] @ unit[400:].T
    near = (one.codes.astype(float) * one.scale[:, None]) @ (two.codes.astype(float) * two.scale[:, None]).T
    assert (abs(exact - near) <= one.error[:, None] + two.error + one.error[:, None] * two.error).all()
    for threshold in (0.6, 0.9, 0.99):
        got = {(i, j) for a, b in one.linked(two, threshold, False) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        sure = np.abs(exact - threshold) > 1e-12
        assert got >= set(zip(*(x.tolist() for x in np.nonzero((exact >= threshold) & sure)), strict=True))
        assert not got & set(zip(*(x.tolist() for x in np.nonzero((exact < threshold) & sure)), strict=True))


def test_forest():
    forest, r = Forest(200), np.random.default_rng(1)
    links = r.integers(0, 200, size=(120, 2))
    for part in np.array_split(links, 5):
        forest.join(part[:, 0], part[:, 1])
    label = np.arange(200)
    for _ in range(200):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert forest.label.tolist() == label.tolist()
