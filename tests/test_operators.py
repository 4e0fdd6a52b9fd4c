"""Operators over small tables."""

import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from silkmill.operators import dedupe, extract, frontier, paths, stats
from silkmill.plans import assets, reports
from silkmill.sources import config, responses
from silkmill.sources.url_list import read_url_list
from silkmill.streaming.dedupe import first_contents, landed


def test_url_list(spark, tmp_path):
    p = tmp_path / "urls.txt"
    p.write_text("# note\n\n https://a.example \nftp://b\nhttps://a.example\nhttp://c/d\n")
    assert [r.url for r in read_url_list(spark, str(p)).orderBy("pos").collect()] == ["https://a.example", "https://a.example", "http://c/d"]


def test_first_wins_and_idempotent(spark):
    f = spark.createDataFrame(
        [("t", "dynamic", 1, "h1"), ("t", "static", 2, "h1"), ("t", "static", 3, "h2"), ("u", "dynamic", 4, "h1"), ("t", "static", 5, "h1")],
        "target string, mode string, seq long, hash string",
    )
    got = {r.seq: r.is_duplicate for r in dedupe.mark_duplicates(f).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: True}
    kept = dedupe.mark_duplicates(f).where("NOT is_duplicate").drop("is_duplicate")
    assert dedupe.mark_duplicates(kept).where("is_duplicate").count() == 0


def test_links(spark):
    html = '<base href="/b/"><a class=x href="p?q=1#f">t</a><script src=s.js></script><a>no</a><A HREF="https://o/"></a><a href="mailto:x">'
    pages = spark.createDataFrame([(1, "https://h/a", html), (2, "https://h/a", None)], "page_id long, url string, html string")
    got = [(r.tag, r.link) for r in extract.links(pages).orderBy("pos").collect()]
    assert got == [("a", "https://h/b/p?q=1#f"), ("a", "https://o/"), ("a", "mailto:x"), ("script", "https://h/b/s.js")]
    assert {r.link for r in extract.page_links(pages).collect()} == {"https://h/b/p?q=1", "https://o/", "https://h/b/s.js"}


def test_frontier_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c"), ("c", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in frontier.expand(edges, seeds, 2).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.node: r.depth for r in frontier.expand(edges, seeds, 2, start_depth=1).collect()} == {"a": 1, "b": 2, "c": 2}
    bag = {(r.node, r.depth): r.visits for r in frontier.visits(edges, seeds, 2).collect()}
    assert bag[("c", 1)] == 1 and bag[("c", 2)] == 1 and bag[("d", 2)] == 1


def test_push_is_a_bag(spark):
    links = spark.createDataFrame([("https://h/1", 1), ("https://h/1", 1), ("https://h/2", 3), ("ftp://h/3", 1), ("https://o/4", 1), ("https://h/5", 1)], "url string, depth int")
    seen = spark.createDataFrame([("https://h/5",)], "url string")
    assert sorted(r.url for r in frontier.push(links, seen, 2, F.lit("h")).collect()) == ["https://h/1", "https://h/1"]


def test_batch(spark):
    r = spark.createDataFrame([("b", 1, False, 2, 1048576), ("b", 2, True, 0, 0), ("b", 3, False, 1, 1)], "batch string, pos int, failed boolean, files int, size long")
    kept = stats.processed(r, "batch", "pos", "failed")
    row = stats.batch_summary(kept, "batch", "failed", "files", "size").first()
    assert (row.total, row.succeeded, row.failed, row.files, row.total_mb) == (2, 1, 1, 2, 1.0)
    assert stats.processed(r, "batch", "pos", "failed", keep_going=True).count() == 3


def test_paths(spark):
    urls = ["https://h/a.js", "https://h/x/a.js?v=1", "https://h/a_1.js", "https://h/a.js", "https://h", "https://h/"]
    f = spark.createDataFrame([("t", n, u) for n, u in enumerate(urls)], "target string, seq long, url string")
    got = [r.file_path for r in paths.numbered_paths(f, "o", "encode/js").orderBy("seq").collect()]
    assert got[0] == "o/t/encode/js/h/a.js" and got[1] == "o/t/encode/js/h/a_1.js" and got[4] == "o/t/encode/js/h/index.js" and got[5] == "o/t/encode/js/h"
    exact = [r.file_path.rsplit("/", 1)[1] for r in paths.greedy_paths(f, "o", "encode/js").orderBy("seq").collect()]
    assert exact[:4] == ["a.js", "a_1.js", "a_1_1.js", "a_2.js"]
    r = random.Random(1)
    names = ["a.js", "a_1.js", "a_1_1.js", "a_2.js", "b", "b_1", "a_x.js", "a.b_1.js", "a_01.js"]
    rows = [("t", n, f"https://h{r.randint(0, 1)}/{r.choice(names)}") for n in range(300)]
    taken, want = set(), {}
    for _, n, u in rows:
        name = u[8:]
        base, dot, ext = name.rpartition(".")
        base, ext = (base, dot + ext) if dot else (name, "")
        k, at = 0, name
        while at in taken:
            k += 1
            at = f"{base}_{k}{ext}"
        taken.add(at)
        want[n] = f"o/t/encode/js/{at}"
    got = paths.greedy_paths(spark.createDataFrame(rows, "target string, seq long, url string"), "o", "encode/js")
    assert {x.seq: x.file_path for x in got.collect()} == want


def test_decompress(spark):
    raw = b"var x = 1;"
    z = zlib.compressobj(wbits=-15)
    two = gzip.compress(b"one") + gzip.compress(b"two")
    more = spark.createDataFrame([("gzip", two), ("gzip", two[:-9]), ("br", b"x")], "content_encoding string, body binary")
    got = paths.decompressed(more, decoders={"br": lambda b: b + b"!"}).collect()
    assert [(bytes(r.plain), r.decode_error is None) for r in got] == [(b"onetwo", True), (two[:-9], False), (b"x!", True)]
    rows = [(" GZIP", gzip.compress(raw)), ("deflate", z.compress(raw) + z.flush()), ("", raw), (None, raw), ("br", raw), ("gzip", raw), ("gzip", None)]
    got = paths.decompressed(spark.createDataFrame(rows, "content_encoding string, body binary")).collect()
    assert [bytes(r.plain) if r.plain is not None else None for r in got] == [raw] * 6 + [None]
    assert [r.decode_error is None for r in got] == [True, True, True, True, False, False, True]


def test_whole_dataflow(spark, tmp_path):
    js = b"var a1 = 0x1F; eval (x1); //# sourceMappingURL=m.map\n" + b"word " * 40
    rows = [
        ("t", "https://h/a.js", 0, "static", 1, 200, "text/javascript", None, bytearray(js)),
        ("t", "https://h/b.js", 0, "static", 2, 200, "text/javascript", "gzip", bytearray(gzip.compress(js))),
        ("t", "https://h/a.js", 0, "dynamic", 3, 200, "text/javascript", None, bytearray(js)),
        ("t", "https://h/p.html", 0, "static", 4, 200, "text/html", None, bytearray(b"<p>")),
        ("t", "https://h/m.map", 0, "static", 5, 200, "application/json", None, bytearray(b"{}")),
        ("t", "https://h/c.js", 0, "static", 6, 404, "text/html", None, bytearray(b"<p>")),
    ]
    from silkmill.schemas import RESPONSES

    r = spark.createDataFrame(rows, RESPONSES)
    files = assets.script_files(r).cache()
    assert {(x.mode, x.url): x.is_duplicate for x in files.collect()} == {
        ("static", "https://h/a.js"): False, ("static", "https://h/b.js"): True, ("dynamic", "https://h/a.js"): True
    }
    assert [x.map_size for x in assets.source_maps(files, r).collect()] == [2]
    out = assets.cleaned_files(files).collect()
    assert len(out) == 1 and "a1 = 31" in out[0].code and out[0].decode_path == "output/t/decode/js/h/a.js"
    failed, maps = assets.failed_files(r), assets.source_map_files(files, r)
    assert [(x.url, x.error_type) for x in failed.collect()] == [("https://h/c.js", "download_failed")]
    assert [(x.url, x.size, x.file_path, x.js_file_url) for x in maps.collect()] == [("https://h/m.map", 2, "output/t/encode/map/h/m.map", "https://h/a.js")]
    report = assets.report(files, failed, maps).first()
    assert (report.files, report.duplicates, report.failed_files, report.map_files) == (3, 2, 1, 1)
    assert [x.url for x in assets.success_files(files).collect()] == ["https://h/a.js"]
    reports.run(r, str(tmp_path / "out"))
    whole = spark.read.json(str(tmp_path / "out/reports/crawl_report")).first()
    assert (whole.stats.total_files, whole.stats.map_files, whole.stats.failed_files, whole.config.depth) == (1, 1, 1, 2) and whole.duration > 0
    assert [(x.url, x.hash[:4]) for x in whole.success_files] == [("https://h/a.js", files.first().hash[:4])] and [x.url for x in whole.failed_files] == ["https://h/c.js"]
    record = spark.read.json(str(tmp_path / "out/reports/js_files")).first()
    assert (record.url, record.has_map_file, record.map_file_url, record.is_obfuscated) == ("https://h/a.js", True, "https://h/m.map", True)
    assert spark.read.parquet(str(tmp_path / "out/encode/js")).count() == 1 and spark.read.json(str(tmp_path / "out/reports/failed_files")).count() == 1
    assert assets.cleaned_files(files, deobfuscate=lambda c: "own").first().code == "own"
    assert "a1 = 31" in assets.cleaned_files(files, deobfuscate=lambda c: 1 / 0).first().code


def test_gates(spark):
    from silkmill.schemas import RESPONSES

    code = bytearray(b"function f() { var x }")
    rows = [
        ("t", u, 0, m, n, 200, k, None, code)
        for n, (u, m, k) in enumerate([
            ("https://h/api", "static", "text/javascript"), ("https://h/a.jsx", "static", "text/plain"), ("https://h/b", "dynamic", "application/x-javascript"),
            ("https://h/c.mjs", "dynamic", "text/plain"), ("https://h/d", "dynamic", "text/javascript"), ("https://h/e.js", "dynamic", "text/plain"),
        ])
    ]
    assert {x.url for x in assets.script_files(spark.createDataFrame(rows, RESPONSES)).collect()} == {"https://h/a.jsx", "https://h/d", "https://h/e.js"}


def test_null_keys_stay(spark):
    f = spark.createDataFrame([(None, "static", 1, "h"), (None, "static", 2, "h"), ("t", "static", 3, None), ("t", "static", 4, None)], "target string, mode string, seq long, hash string")
    assert {r.seq: r.is_duplicate for r in dedupe.mark_duplicates(f).collect()} == {1: False, 2: True, 3: False, 4: False}
    u = f.withColumn("url", F.lit(None).cast("string"))
    assert {r.seq for r in dedupe.first_by_url(u).collect()} == {1, 3}


def test_inline_scripts(spark):
    loop = "for (i = 0; i<10; i++) { x('</p>') } " * 4
    html = f"<script type='module'>{loop}</script><script src='a.js'>{loop}</script><script>short</script><script>{loop}"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [(r.pos, r.code) for r in extract.inline_scripts(pages).orderBy("pos").collect()] == [(0, loop), (2, loop)]


def test_two_hosts_and_exempt_scripts(spark):
    row = spark.createDataFrame([("https://b/1", "https://b/"), ("https://a/1", "https://b/"), ("https://a/1", "https://a/")], "link string, page string")
    got = row.select(frontier.follow_on_page(F.col("link"), F.col("page"), F.lit(0), F.lit(False), 2, F.lit("a")).alias("r")).collect()
    assert [r.r for r in got] == ["cross_domain_of_target", "cross_domain", None]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    pages = frontier.expand(edges, spark.createDataFrame([("a",)], "node string"), 1)
    scripts = spark.createDataFrame([("a", "x.js"), ("b", "y.js"), ("b", "x.js"), ("c", "z.js")], "src string, dst string")
    assert {r.node: r.depth for r in frontier.reached_scripts(pages, scripts).collect()} == {"x.js": 1, "y.js": 2}


def test_command_line(spark, tmp_path, capsys):
    from silkmill.__main__ import main

    main(["r", "--validate-config", "--depth", "3", "--no-headless"])
    out = capsys.readouterr().out
    assert "depth=3" in out and "headless=False" in out
    with pytest.raises(SystemExit):
        main(["r"])


def test_captured(spark):
    rows = [("text/javascript", "u", "eA=="), ("", "u.js", "eA=="), (None, "u.JS", "eA=="), ("text/html", "u", "eA=="), ("text/javascript", "u", "?")]
    got = responses.captured(spark.createDataFrame(rows, "content_type string, url string, body_base64 string")).collect()
    assert [(r.content_type, None if r.body is None else bytes(r.body)) for r in got] == [
        ("text/javascript", b"x"), ("application/javascript", b"x"), ("text/javascript", None)
    ]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("t", "x"), ("t", "x"), ("u", "x"), ("t", "y")], "target string, body string").write.parquet(src)
    stream = landed(spark, src, "target string, body string")
    q = first_contents(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema("target string, body string").parquet(str(tmp_path / "out")).count() == 3


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("t", "https://h/a.js", bytearray(b"x"))], "target string, url string, body binary")
    responses.write_bodies(f, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).first().source_host == "h"
    state = spark.createDataFrame([("id", "https://e", ["a", "b"], 2)], "task_id string, target_url string, visited_urls array<string>, current_depth int")
    responses.save_checkpoint(state, str(tmp_path / "c"))
    row = responses.load_checkpoint(spark, str(tmp_path / "c")).first()
    assert (row.task_id, row.visited_urls, row.current_depth) == ("id", ["a", "b"], 2)
    (tmp_path / "js").mkdir()
    (tmp_path / "js" / "a.js").write_bytes(b"abc")
    assert responses.read_scripts(spark, str(tmp_path / "js")).first()["size"] == 3


@pytest.mark.parametrize("changes,ok", [({}, True), ({"depth": 0}, False), ({"depth": 11}, False), ({"similarity_threshold": 1.5}, False), ({"mode": "x"}, False)])
def test_config(changes, ok):
    if ok:
        assert config.from_mapping(changes).validate()
    else:
        with pytest.raises(config.ConfigError):
            config.from_mapping(changes).validate()


def test_config_file(tmp_path, monkeypatch):
    p = tmp_path / "c.yaml"
    p.write_text("crawl:\n  depth: 5\n  unknown: 1\nheaders:\n  X-A: b\n")
    assert config.load(str(p), {"depth": None, "tabs": 2}).depth == 5
    assert config.load(None).depth == 2 and config.load(None).allow_cross_domain and config.load(None).similarity_enabled
    p.write_text("crawl:\n  playwright_tabs: 7\nresource:\n  max_tabs_limit: 8\nlogging:\n  rotation:\n    max_age: 1\noutput:\n  base_dir: x\nheaders:\n  X-A: b\n")
    whole = config.load_all(str(p))
    assert (whole.crawl.playwright_tabs, whole.resource.max_tabs_limit, whole.logging.rotation.max_age, whole.output.base_dir) == (7, 8, 1, "x")
    monkeypatch.chdir(tmp_path)
    (tmp_path / "config.yaml").write_text("crawl: {depth: 9}\n")
    assert config.load().depth == 9
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.yaml"))
    assert config.load_headers(str(tmp_path / "new" / "h.yaml")) == {} and (tmp_path / "new" / "h.yaml").exists()
    assert config.load_headers(str(p)) == {"X-A": "b"}
    assert config.max_tabs(3000, 200, 8, 4) == 4 and config.max_tabs(0, 200, 8, 4) == 1
    with pytest.raises(config.ConfigError):
        config.ResourceConfig(cpu_load_threshold=20).validate()
