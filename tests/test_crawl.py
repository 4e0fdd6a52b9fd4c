"""Crawl replay, order of visits, resumption, exact paths, similarity."""

import random
import re

import pytest
from pyspark.sql import functions as F

from silkmill.operators import crawl, dedupe, paths, similarity
from silkmill.operators.ordinal import running
from silkmill.plans import assets
from silkmill.schemas import RESPONSES

PAGE = "text/html"


def page(url, *hrefs, scripts=(), target="t", seq=0, status=200, mode="static"):
    html = "".join(f'<a href="{x}">x</a>' for x in hrefs) + "".join(f'<script src="{x}"></script>' for x in scripts)
    return (target, url, 0, mode, seq, status, PAGE, None, bytearray(html.encode()))


def code(url, body="var a; function f() {}", target="t", seq=0, mode="static"):
    return (target, url, 0, mode, seq, 200, "text/javascript", None, bytearray(body.encode()))


SITE = [
    page("https://a/", "/1", "/2#x", "https://b/1", "#here", "mailto:x", scripts=["/m.js", "//c/n.js"]), page("https://a/1", "/3", "/"), page("https://a/2", "/3", "/4", "/1", scripts=["deep.js"]),
    page("https://a/3", "/5", scripts=["/last.js"]), page("https://a/4", "/6", status=404), page("https://a/5", "/7"), page("https://b/1", "https://b/2"), code("https://a/m.js"), code("https://a/deep.js"),
    code("https://a/last.js", "other x"), code("https://c/n.js"), page("https://a/1", "/never", seq=5),
]


def visited(frame):
    return {r.url.removeprefix("https://"): (r.depth, r.kind, r.found) for r in frame.collect()}


@pytest.fixture(scope="module")
def site(spark):
    return spark.createDataFrame(SITE, RESPONSES), spark.createDataFrame([("t", "https://a/"), ("t", "https://a/#again")], "target string, url string")


def test_static_rules(spark, site):
    got = visited(crawl.replay(*site, crawl.Rules(3, "static", True)))
    p, s = "page", "script"
    assert got == {
        "a/": (1, p, True), "a/1": (2, p, True), "a/2": (2, p, True), "b/1": (2, p, True), "a/m.js": (2, s, True), "c/n.js": (2, s, True),
        "a/3": (3, p, True), "a/4": (3, p, True), "b/2": (3, p, False), "a/deep.js": (3, s, True), "a/last.js": (4, s, True),
    }
    own = visited(crawl.replay(*site, crawl.Rules(3, "static", False)))
    assert set(own) == {k for k in got if k.startswith("a/")}


def test_dynamic_rules(spark, site):
    responses, seeds = site
    got = visited(crawl.replay(responses.withColumn("mode", F.lit("dynamic")), seeds, crawl.Rules(2, "dynamic", False)))
    assert {k: v[0] for k, v in got.items()} == {"a/": 0, "a/1": 1, "a/2": 1, "a/m.js": 1, "c/n.js": 1, "a/3": 2, "a/4": 2, "a/deep.js": 2, "a/last.js": 3}
    assert got["a/last.js"][1] == "script" and got["a/m.js"][1] == "page"
    assert crawl.replay(responses, seeds, crawl.Rules(2, "dynamic", False)).where("found").count() == 0  # no response of that mode


def test_files_of_a_crawl(spark, site):
    responses, seeds = site
    visits = crawl.replay(responses, seeds, crawl.Rules(2, "static", False))
    got = {r.url: (r.depth, r.is_duplicate) for r in crawl.crawled_files(responses, visits).collect()}
    assert {k: v[0] for k, v in got.items()} == {"https://a/m.js": 2, "https://a/deep.js": 3} and sorted(v[1] for v in got.values()) == [False, True]


def test_order_of_a_queue(spark):
    """Against a queue, on a graph with many ways to each page; ties of one page by its links' places."""
    r = random.Random(4)
    rows, graph = [], {}
    for t in ("t", "u"):
        for k in range(40):
            out = [r.randrange(40) for _ in range(r.randrange(6))]
            graph[t, f"https://a/{k}"] = [f"https://a/{x}" for x in out]
            rows.append(page(f"https://a/{k}", *[f"/{x}" for x in out], target=t))
    want = {}
    for t in ("t", "u"):
        queue, seen = [("https://a/0", 0)], {"https://a/0"}
        for url, depth in queue:
            want[t, url] = (depth, len([x for x in want if x[0] == t]))
            for x in graph[t, url] if depth < 4 else []:
                if x not in seen:
                    seen.add(x)
                    queue.append((x, depth + 1))
    seeds = spark.createDataFrame([("t", "https://a/0"), ("u", "https://a/0")], "target string, url string")
    responses = spark.createDataFrame(rows, RESPONSES).withColumn("mode", F.lit("dynamic"))
    visits = crawl.visit_order(crawl.replay(responses, seeds, crawl.Rules(4, "dynamic", True)))
    assert {(v.target, v.url): (v.depth, v.ordinal) for v in visits.collect()} == want
    assert "SinglePartition" not in visits._jdf.queryExecution().toString()


@pytest.mark.parametrize("after", [2])
def test_resume(spark, site, tmp_path, after):
    responses, seeds = site
    rules, folder = crawl.Rules(3, "static", True), str(tmp_path / "state")
    whole = sorted(map(tuple, crawl.replay(responses, seeds, rules).collect()))
    part = crawl.replay(responses, seeds, rules, folder, stop_after=after)
    assert part.count() < len(whole)
    # A level that was being written when the run stopped has no mark, and is written anew.
    part.limit(2).write.parquet(f"{folder}/level={after:04d}")
    assert crawl.State(spark, folder, rules).whole() == after
    assert sorted(map(tuple, crawl.replay(responses, seeds, rules, folder, resume=True).collect())) == whole
    assert sorted(map(tuple, crawl.replay(responses.limit(0), seeds, rules, folder, resume=True).collect())) == whole  # ended: nothing is asked again
    with pytest.raises(ValueError, match="other rules"):
        crawl.replay(responses, seeds, crawl.Rules(2, "static", True), folder, resume=True)
    with pytest.raises(FileExistsError):
        crawl.State(spark, folder, rules).write(0, part)
    assert crawl.replay(responses, seeds, crawl.Rules(1, "static", True), folder).where("kind = 'page'").count() == 1  # without resume the state goes


def test_empty_crawls(spark, site):
    responses, seeds = site
    assert crawl.replay(responses, seeds.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "https://a/")], "target string, url string")
    got = crawl.replay(responses.withColumn("target_url", F.lit(None).cast("string")), null, crawl.Rules(3, "static", False))
    assert got.count() == 8 and got.where("target IS NOT NULL").count() == 0


def test_running_sums(spark):
    r = random.Random(2)
    rows = [(r.choice(["x", "y", None]), k, r.randrange(3)) for k in range(500)]
    r.shuffle(rows)
    f = spark.createDataFrame(rows, "k string, o int, w int")
    want = {(k, o): (sum(a == k and b < o for a, b, _ in rows), sum(w for a, b, w in rows if a == k and b < o)) for k, o, _ in rows}
    sums = running(running(f, ["k"], ["o"]), ["k"], ["o"], "s", F.col("w"))
    assert {(x.k, x.o): (x.ordinal, x.s) for x in sums.collect()} == want
    assert sorted(x.n for x in running(f, [], ["o"], "n").collect()) == list(range(500))
    assert running(f.limit(0), ["k"], ["o"]).count() == 0


def paths_by_hand(rows):
    """(key, host, name) in order of arrival to paths, each the first free one."""
    taken, want = set(), {}
    for key, at, name in rows:
        base, dot, ext = name.rpartition(".")
        base, ext = (base, dot + ext) if dot else (name, "")
        k, path = 0, name
        while (at, path) in taken:
            k += 1
            path = f"{base}_{k}{ext}"
        taken.add((at, path))
        want[key] = "/".join(x for x in (*at, path) if x)
    return want


@pytest.mark.parametrize("seed", [1, 3])
def test_exact_paths(spark, seed):
    r = random.Random(seed)
    stems = ["a", "a_1", "a_1_1", "a_2", "a_3", "a_12", "a_01", "b", "b_1", "index", "_1", ""]
    rows = []
    for k in range(500):
        stem = r.choice(stems[: 4 + 3 * seed])
        name = stem + r.choice([".js", ".js", "", ".min.js"])
        rows.append((r.choice([None, "t", "u"]), r.choice(["static", "dynamic"]), k // 2, f"https://h{r.randrange(2)}/{r.randrange(9)}/{name}"))
    rows = sorted(set(rows), key=lambda x: (x[1] == "dynamic", x[2], x[3]))
    rows = [x for x in rows if not x[3].endswith("/")]
    f = spark.createDataFrame(rows, "target string, mode string, seq long, url string")
    want = paths_by_hand([(x, ("o", x[0] or "", "e", x[3].split("/")[2]), x[3].rsplit("/", 1)[1]) for x in rows])
    got = paths.greedy_paths(f.unionAll(f.limit(30)), "o", "e")  # repeated rows share a path
    assert got.count() == len(rows) + 30
    assert {(x.target, x.mode, x.seq, x.url): x.file_path for x in got.collect()} == {k: re.sub("^o//", "o/", v) for k, v in want.items()}


def test_many_files_of_one_name(spark):
    """10^5 files of one name and host, and one that is called like the fifth: no group holds them."""
    many = spark.range(100_000).select(F.lit("t").alias("target"), "id", F.concat(F.lit("https://h/"), F.col("id").cast("string"), F.lit("/index.js")).alias("url")).withColumnRenamed("id", "seq")
    own = spark.createDataFrame([("t", 3, "https://h/z/index_5.js"), ("t", 70_000, "https://h/z/index_9.js")], "target string, seq long, url string")
    got = paths.greedy_paths(many.unionAll(own), "o", "e").where("seq IN (0, 1, 3, 4, 5, 6, 70000, 99999)")
    assert sorted((x.seq, x.file_path.rsplit("/", 1)[1]) for x in got.collect()) == [
        (0, "index.js"), (1, "index_1.js"), (3, "index_3.js"), (3, "index_5.js"), (4, "index_4.js"), (5, "index_6.js"), (6, "index_7.js"), (70000, "index_70001.js"),
        (70000, "index_9_1.js"), (99999, "index_100000.js"),
    ]


def test_right_files(spark):
    """Equal numbers of arrival in both modes, null targets, repeated rows."""
    body = "var aa = 0x1F; eval (x12);"
    rows = [
        code("https://h/a/x.js", body, seq=1), code("https://h/b/y.js", body + "1", seq=1, mode="dynamic"), code("https://h/c/x.js", body + "2", None, 1),
        code("https://h/c/x.js", body + "2", None, 1), code("https://h/d/x.js", body + "3", seq=1), code("https://h/e/z.js", body, seq=1, mode="dynamic"),
    ]
    files = assets.script_files(spark.createDataFrame(rows, RESPONSES))
    assert files.count() == 5 and [x.url for x in files.where("is_duplicate").collect()] == ["https://h/e/z.js"]
    got = sorted((x.url, x.target, x.file_path) for x in assets.cleaned_files(files).collect())
    assert got == [
        ("https://h/a/x.js", "t", "output/t/encode/js/h/x.js"), ("https://h/b/y.js", "t", "output/t/encode/js/h/y.js"), ("https://h/c/x.js", None, "output/encode/js/h/x.js"),
        ("https://h/d/x.js", "t", "output/t/encode/js/h/x_1.js"),
    ]


def test_ties_and_repeated_rows(spark):
    rows = [("t", "static", 1, "u", "h", b"a"), ("t", "static", 1, "u", "h", b"a"), ("t", "static", 1, "u", "g", b"b"), ("t", "static", None, "v", "h", b"c"), (None, "dynamic", 2, "v", "h", b"c")]
    f = spark.createDataFrame([(*x[:5], bytearray(x[5])) for x in rows], "target string, mode string, seq long, url string, hash string, body binary")
    assert sorted((x.url, x.target or "") for x in dedupe.first_by_url(f).collect()) == [("u", "t"), ("v", ""), ("v", "t")]
    assert dedupe.first_by_url(f).count() == dedupe.first_by_url(dedupe.first_by_url(f)).count()
    assert sorted(x.is_duplicate for x in dedupe.mark_duplicates(f).where("hash = 'h' AND target = 't'").collect()) == [False, True, True]
    assert sorted((x.target or "", x.mode) for x in dedupe.first_by_url(f.where("url = 'v'"), ("url",)).collect()) == [("t", "static")]


# Similarity


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    words = [f"w{k}" for k in range(900)]

    def prose(n):
        return [r.choice(words) for _ in range(n)]

    out = []
    for n in (7, 40, 120, 400):
        base = prose(n)
        for changes in (0, 0, 1, 2, 3, 4, 6, 9, 14, 20):
            own = list(base)
            for _ in range(changes):
                own[r.randrange(n)] = r.choice(words)
            out.append(" ".join(own))
    chain = prose(200)
    for k in range(8):  # each like the next, the ends unlike
        out.append(" ".join(chain[:]))
        chain[20 * k : 20 * k + 6] = prose(6)
    return out + ["", None, " \t", "a b", "a  b", "a b c", "one", "one"] + [" ".join(prose(60)) for _ in range(20)]


@pytest.mark.parametrize("threshold", [0.8])
def test_similar_files(spark, texts, threshold):
    f = spark.createDataFrame([(k, x, len(x or "")) for k, x in enumerate(texts)] + [(3, texts[3], 1), (None, "z", 1)], "url long, code string, size long")
    first = {}
    for k, x in enumerate(texts):
        first.setdefault(x or "", k)
    ids = sorted(first.values())
    want = {(a, b): near(texts[a], texts[b]) for n, a in enumerate(ids) for b in ids[n + 1 :]}
    links = {k: v for k, v in want.items() if v >= threshold}
    assert {(x.a, x.b): x.similarity for x in similarity.near_pairs(f, threshold=threshold).collect()} == links and len(links) > 10
    group = {k: k for k in ids}
    for _ in ids:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    got = similarity.members(f, threshold=threshold)
    assert {x.id: (x.group_id, x.similarity) for x in got.collect()} == {
        k: (group[c], 1.0 if c == group[c] else want[min(c, group[c]), max(c, group[c])]) for k, x in enumerate(texts) for c in [first[x or ""]]
    }
    rows = {x.group_id: x for x in similarity.groups(f, threshold=threshold).collect()}
    for g, x in rows.items():
        of = [k for k, t in enumerate(texts) if group[first[t or ""]] == g]
        values = [1.0 if first[texts[k] or ""] == g else want[g, first[texts[k] or ""]] for k in of if k != g]
        assert x.member_count == len(of) and x.min_similarity == min(values) and x.max_similarity == max(values) and abs(x.avg_similarity - sum(values) / len(values)) < 1e-12
        assert x.total_saved_size == sum(len(texts[k] or "") for k in of if k != g)
    assert similarity.near_pairs(f.limit(0)).count() == 0


def test_sets_of_candidates_only(spark, monkeypatch):
    """Sets of shingles, as large as the texts, are kept for the classes that share a band, not for all."""
    kept, plain = {}, similarity.materialise

    def materialise(frame):
        out = plain(frame)
        if "shingles" in frame.columns and "a" not in frame.columns:
            kept["classes"] = sorted(x["class"] for x in out.collect())
        return out

    monkeypatch.setattr(similarity, "materialise", materialise)
    texts = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(30)]
    rows = [(f"u{k:02}", x) for k, x in enumerate([*texts, texts[3] + " more", texts[5]])] + [("u30", texts[9]), (None, texts[8])]
    got = {x.id: x.group_id for x in similarity.members(spark.createDataFrame(rows, "url string, code string")).where("id != 'u30'").collect()}
    assert kept["classes"] == ["u03", "u30"] and got["u31"] == "u05" and len(got) == 31


def test_families_in_blocks(spark, texts, monkeypatch):
    """Families cut into blocks, small lots and a full map of candidates give what whole families give."""
    f = spark.createDataFrame([(f"u{k:02}", x, 1) for k, x in enumerate(texts)], "url string, code string, size long")
    results = []
    for block_classes, block_shingles, lot, bits in ((4096, 1 << 20, 1 << 18, 1 << 24), (3, 1 << 20, 64, 64), (100, 500, 64, 64)):
        for name, value in (("BLOCK_CLASSES", block_classes), ("BLOCK_SHINGLES", block_shingles), ("LOT_SHINGLES", lot), ("BITS", bits)):
            monkeypatch.setattr(similarity, name, value)
        pairs = [tuple(x) for x in similarity.near_pairs(f).collect()]
        assert len(pairs) == len(set(pairs)) > 10
        results.append((sorted(pairs), sorted(tuple(x) for x in similarity.members(f).collect())))
    assert results[0] == results[1] == results[2]


def test_candidates_are_not_listed(spark, monkeypatch):
    """Of a family whose members share bands but are not similar no list of pairs is made, which would grow with its square."""
    rows, plain = [], similarity.materialise

    def materialise(frame):
        out = plain(frame)
        if "a" in frame.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(similarity, "materialise", materialise)
    r = random.Random(3)
    base, n = [f"w{k}" for k in range(400)], 60
    texts = [" ".join(f"x{k}" if i in changed else w for i, w in enumerate(base)) for k in range(n) for changed in [set(r.sample(range(400), 10))]]
    got = similarity.members(spark.createDataFrame(list(enumerate([*texts, texts[7] + " more"])), "url long, code string")).collect()
    assert {x.id: x.group_id for x in got} == {**{k: k for k in range(n)}, n: 7}
    assert rows and max(rows) <= 10 * n


def test_map_of_candidates(spark, monkeypatch):
    """No candidate is lost before the shuffle of texts, most others stay out of it."""
    rows = spark.range(4000).selectExpr("concat('u', id) AS id")
    ids = rows.where("crc32(id) % 40 = 0")
    want = {x.id for x in ids.collect()}
    got = {x.id for x in similarity.passing(rows, ids).collect()}
    assert want <= got and len(got) < len(want) + 20
    monkeypatch.setattr(similarity, "BITS", 64)  # full: all may be
    assert similarity.passing(rows, ids).count() > 2000 and similarity.passing(rows, ids.limit(0)).count() == 0


def test_recall_of_bands():
    """Pairs just above the threshold share a band nearly always."""
    r, found, n = random.Random(1), 0, 400
    for _ in range(n):
        base = [r.getrandbits(62) for _ in range(90)]
        other = base[:80] + [r.getrandbits(62) for _ in range(10)]  # 80 of 100
        a, b = (similarity.band_hashes(similarity.np.array(sorted(x), similarity.np.int64)) for x in (base, other))
        found += bool(set(a.tolist()) & set(b.tolist()))
    assert found == n


def test_report_in_parts(spark, monkeypatch):
    """No part of a report holds more entries than it may; all parts together hold all."""
    from datetime import datetime

    from silkmill import schemas
    from silkmill.plans import reports
    from silkmill.sources.config import CrawlConfig

    monkeypatch.setattr(reports, "PART_ENTRIES", 4)
    files = spark.createDataFrame([(t, "static", k, f"u{k:02}", f"p{k}", "h", 1, False, k % 2 == 0) for t, n in (("https://h/", 10), (None, 3)) for k in range(n)], "target string, mode string, seq long, url string, file_path string, hash string, size long, is_duplicate boolean, is_obfuscated boolean")
    failed = spark.createDataFrame([("https://h/", "f1", "e", "m", 0), ("z", "f2", "e", "m", 0)], "target string, url string, error_type string, error_msg string, retries int")
    stats = reports.statistics(files, failed, files.limit(0), visits=files.where("seq < 2"))
    out = reports.crawl_reports(files, failed, stats, CrawlConfig(depth=3), "o", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 1))
    rows = {(r.target_url, r.part): r for r in out.collect()}
    assert sorted(rows, key=str) == sorted([("https://h/", 0), ("https://h/", 1), ("https://h/", 2), (None, 0), ("z", 0)], key=str)
    assert [f.url for p in range(3) for f in rows["https://h/", p].success_files] == [f"u{k:02}" for k in range(10)]
    one = rows["https://h/", 1]
    assert (one.stats.total_files, one.stats.visited_urls, one.stats.failed_files, one.stats.deobfuscated_files, one.duration, one.domain, one.config.depth) == (10, 2, 1, 5, 60.0, "h", 3)
    assert [f.url for f in rows["z", 0].failed_files] == ["f2"] and rows["z", 0].success_files == [] and len(rows[None, 0].success_files) == 3
    assert ", ".join(f"{n} {k}" for n, k in out.drop("part").dtypes) == ", ".join(f"{n} {k}" for n, k in spark.createDataFrame([], schemas.REPORT).dtypes)
    assert [f.name for f in reports.map_files(files.withColumn("js_file_url", F.lit("x"))).schema] == [x.split()[0] for x in schemas.MAP_FILES.split(", ")]
