"""Hash registry, archives, files on disk, SQL functions, the stream of first files, the command line."""

import base64
import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from silkmill.functions import cleanup, sql
from silkmill.operators.crawl import failed_requests
from silkmill.operators.registry import HashRegistry
from silkmill.schemas import RESPONSES
from silkmill.sources import archive
from silkmill.streaming.first_wins import first_wins

FILE = "target string, mode string, seq long, url string, hash string"


def test_registry(spark, tmp_path):
    one = spark.createDataFrame([("t", "static", 1, "a", "h1"), ("t", "dynamic", 1, "b", "h1"), (None, "static", 2, "c", "h1"), ("t", "static", 3, "d", None)], FILE)
    two = spark.createDataFrame([("t", "static", 1, "e", "h1"), ("t", "dynamic", 1, "f", "h2"), ("t", "static", 9, "g", "h2"), (None, "static", 1, "h", "h1"), ("u", "static", 1, "i", "h1"), ("t", "static", 1, "j", None)], FILE)
    known = HashRegistry(spark, str(tmp_path / "r"), 4)

    def marks(files, run):
        return {r.url: r.duplicate_of for r in known.mark(files, run).collect()}

    first = marks(one, "1")
    assert first == {"a": None, "b": "a", "c": None, "d": None}
    known.add(known.mark(one, "1"), "1")
    second = marks(two, "2")
    assert second == {"e": "a", "f": "g", "g": None, "h": "c", "i": None, "j": None}
    known.add(known.mark(two, "2"), "2")
    known.add(known.mark(two, "2"), "2")  # again: nothing changes
    assert known.known().count() == 4 and known.runs() == ["1", "2"]
    assert marks(two, "2") == second  # a repeated run is marked as it was
    known.forget()
    again = HashRegistry(spark, str(tmp_path / "r"), 4)  # another session finds it
    # A run without its mark does not count, and is written anew.
    os.remove(tmp_path / "r" / "runs" / "2")
    assert again.known().count() == 2
    again.add(again.mark(two, "2"), "2")
    assert again.known().count() == 4
    with pytest.raises(ValueError, match="path"):
        again.add(one, "a/b")
    again.forget()


def test_registry_is_not_shuffled(spark, tmp_path):
    known = HashRegistry(spark, str(tmp_path / "r"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = spark.createDataFrame([("t", "static", k, f"u{k}", f"h{k % 50}") for k in range(200)], FILE)
    known.add(known.mark(files, "1"), "1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = files.select(F.col("hash").alias("x")).distinct()
        plan = own.join(known.known(), F.col("x") == F.col("hash"), "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        known.forget()
    scan = plan[: plan.index("silkmill_registry")].splitlines()[-3:]
    assert not any("Exchange" in line for line in scan), plan


def test_archives(spark, tmp_path):
    archive.register(spark)

    def row(k, **more):
        return json.dumps({"target_url": "t", "url": f"u{k}", "depth": 0, "mode": "static", "status": 200, "content_type": "x", "body_base64": base64.b64encode(b"%d" % k).decode()} | more)

    (tmp_path / "a.jsonl").write_text(row(0) + "\n\n" + row(1, status=404) + "\n" + row(2, body_base64=None))
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "b.jsonl.gz", "wt") as f:
        f.write(row(3, mode="dynamic", target_url=None) + "\n" + row(4, extra=1) + "\n")
    (tmp_path / "notes.txt").write_text("no archive")
    rows = spark.read.format("silkmill_archive").load(str(tmp_path))
    assert ", ".join(f"{n} {k.upper()}" for n, k in rows.dtypes) == RESPONSES
    got = {r.url: r for r in rows.collect()}
    assert sorted(got) == ["u0", "u1", "u2", "u3", "u4"] and bytes(got["u4"].body) == b"4" and got["u2"].body is None and got["u0"].seq < got["u1"].seq < got["u3"].seq
    some = rows.where("status = 200 AND mode IN ('static', 'x') AND url > 'u0'")
    assert sorted(r.url for r in some.collect()) == ["u2", "u4"] and rows.where("target_url IS NULL").count() == 1
    reader = archive.ArchiveReader(str(tmp_path))
    left = list(reader.pushFilters([archive.EqualTo(("status",), 200), archive.In(("mode",), ("static",)), archive.EqualTo(("seq",), 1)]))
    assert [f.attribute for f in left] == [("seq",)] and reader.equal == {"status": {200}, "mode": {"static"}}
    (tmp_path / "none").mkdir()
    assert spark.read.format("silkmill_archive").load(str(tmp_path / "none")).count() == 0


def test_files_on_disk(spark, tmp_path):
    archive.register(spark)
    out = tmp_path / "out"
    rows = [("t/encode/js/h/a.js", bytearray(b"one")), ("t/encode/js/h/b.js", bytearray(b"")), ("c.js", None)]
    files = spark.createDataFrame(rows, "file_path string, body binary").withColumn("more", F.lit(1))
    for _ in range(2):  # again: the same files
        files.repartition(2).write.format("silkmill_files").mode("append").save(str(out))
        assert {str(p.relative_to(out)): p.read_bytes() for p in out.rglob("*") if p.is_file() and p.suffix == ".js"} == {k: bytes(v or b"") for k, v in rows}
    assert json.loads((out / "_SUCCESS").read_text()) == {"files": 3, "bytes": 3}
    for bad in ("../x.js", "/x.js", "a//b.js", "", None):
        with pytest.raises(Exception, match="no path within"):
            spark.createDataFrame([(bad, bytearray(b"x"))], "file_path string, body binary").write.format("silkmill_files").mode("append").save(str(tmp_path / "bad"))
        assert not [p for p in (tmp_path / "bad").rglob("*") if p.is_file()]  # nothing half, no drafts
    # A task that dies in the middle leaves no file under a final path.
    writer = archive.FileWriter(str(tmp_path / "died"), ["file_path", "body"])

    def broken():
        yield ("a.js", b"whole")
        yield ("b.js", "no bytes")

    with pytest.raises(TypeError):
        writer.write(broken())
    writer.abort([None])
    assert [p.name for p in (tmp_path / "died").rglob("*")] == ["a.js"]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("""SELECT url_scheme('HTTPS://u@h:1/a.b.mjs?q') AS s, url_host('HTTPS://u@h:1/a.b.mjs?q') AS h, url_extension('https://h/a.mjs?q') AS e, is_javascript_url('https://h/a.MJS?q') AS j,
      is_javascript_resource('https://h/js/a') AS r, content_hash(CAST('' AS BINARY)) AS c""").first()
    assert (row.s, row.h, row.e, row.j, row.r, row.c[:8]) == ("https", "h:1", ".mjs?q", True, True, "e3b0c442")
    got = spark.sql("""SELECT l.* FROM VALUES ('<a href="/x">t</a><script src=s.js></script>', 'https://h/p/'), (NULL, 'https://h/'), ('<a href="y">', NULL) AS p(html, url), LATERAL extract_links(p.html, p.url) l""")
    assert sorted((r.tag, r.pos, r.href, r.link or "") for r in got.collect()) == [("a", 0, "/x", "https://h/x"), ("a", 0, "y", ""), ("script", 1, "s.js", "https://h/p/s.js")]


def test_late_static_files_win(spark, tmp_path):
    """Batches in the wrong order give what one batch gives."""
    rows = [("t", "h1", "dynamic", 1, "a", 100), ("t", "h1", "static", 5, "b", 200), ("t", "h2", "dynamic", 9, "c", 100), ("t", "h2", "dynamic", 2, "d", 300), ("u", "h1", "dynamic", 3, "e", 50), ("t", "h3", "static", 7, "f", 10), ("t", "h3", "static", 6, "g", 20)]
    later = [("z", "end", "static", 1, "z", 100_000), ("z", "end2", "static", 1, "z", 200_000)]
    schema = "target string, hash string, mode string, seq long, url string, at long"
    for n, batch in enumerate([[rows[0], rows[4]], [rows[3], rows[6]], [rows[1], rows[2]], [rows[5]], later[:1], later[1:]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = first_wins(stream.withColumn("time", F.timestamp_seconds("at")), "time", "1 hour", 3600)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
    q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("target <> 'z'")
    assert sorted((r.target, r.hash, r.mode, r.url) for r in got.collect()) == [("t", "h1", "static", "b"), ("t", "h2", "dynamic", "d"), ("t", "h3", "static", "g"), ("u", "h1", "dynamic", "e")]


def test_contents_of_one_key_wait_apart(spark, tmp_path):
    """A time that is over hands out its own contents only; a content that comes again is a first one again."""
    batches = [[("t", f"h{i}", "dynamic", i, "a", 100) for i in range(300)] + [("t", "late", "dynamic", 9, "b", 5_000)], [("t", "h7", "static", 900, "c", 2_000), ("t", "late", "static", 10, "d", 5_500)],
               [("z", "end", "static", 1, "z", 9_000)], [("t", "h7", "dynamic", 5, "e", 6_000)], [("z", "end", "static", 1, "z", 100_000)]]
    folder = str(tmp_path / "in")
    for batch in batches:
        spark.createDataFrame(batch, "target string, hash string, mode string, seq long, url string, at long").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("target string, hash string, mode string, seq long, url string, at long").parquet(folder)
        out = first_wins(stream.withColumn("time", F.timestamp_seconds("at")), "time", "1 hour", 3600, buckets=1)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        q.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(str(tmp_path / "out")).where("target <> 'z'").collect()
    assert sorted((r.hash, r.mode, r.url) for r in got if r.hash in ("h7", "late")) == [("h7", "dynamic", "e"), ("h7", "static", "c"), ("late", "static", "d")]
    assert len(got) == 302


def test_a_batch_asks_the_state_once():
    """Calls to the state don't grow with the contents of a batch."""
    import pandas as pd
    from types import SimpleNamespace

    from silkmill.streaming.first_wins import FirstWins

    kept, timers = [], []
    handle = SimpleNamespace(getListState=lambda *_: SimpleNamespace(appendList=kept.append), registerTimer=timers.append)
    first = FirstWins()
    first.init(handle)
    rows = pd.DataFrame([("t", f"h{i % 500}", 1, i, "u", "dynamic", 5000 + i // 500) for i in range(1500)], columns=["target", "hash", "rank", "seq", "url", "mode", "end_ms"])
    assert list(first.handleInputRows((0,), iter([rows[:700], rows[700:]]), None)) == []
    assert len(kept) == 1 and sorted(x[3] for x in kept[0]) == list(range(500)) and timers == [5000]


@pytest.mark.parametrize(("code", "want"), [
    ("a = 0x1F + _0x1a", "a = 31 + _26"), ("0x7FFFFFFFFFFFFFFF 0x8000000000000000 0x0 0x00", "9223372036854775807 0x8000000000000000 0 0"), (r"\x41B", "AB"), (r"\x5cu0041", "A"),
    (r"\ud83d\ude00 \u12 \xZZ", "�� \\u12 \\xZZ"), (None, None), ("", ""),
])
def test_clean_up(spark, code, want):
    row = spark.createDataFrame([(code,)], "c string").select(cleanup.decode_escapes(cleanup.hex_to_decimal(F.col("c"))).alias("c")).first()
    assert row.c == want


def test_failed_requests(spark):
    html = bytearray(b"<p>")
    responses = spark.createDataFrame([("t", "https://h/ok", 0, "static", 1, 200, "text/html", None, html), ("t", "https://h/bad", 0, "static", 2, 500, "text/html", None, html), ("t", "https://h/x.js", 0, "static", 3, 404, "text/html", None, html)], RESPONSES)
    visits = spark.createDataFrame([("t", "https://h/ok", 1, "page", True, 0), ("t", "https://h/bad", 2, "page", True, 0), ("t", "https://h/none", 2, "page", False, 1), ("t", "https://h/x.js", 2, "script", True, 2)], "target string, url string, depth int, kind string, found boolean, place long")
    assert sorted((r.url, r.error_type) for r in failed_requests(responses, visits).collect()) == [("https://h/bad", "download_failed"), ("https://h/none", "download_failed")]


def test_command_line_headers_and_replay(spark, tmp_path, capsys, monkeypatch):
    from silkmill.__main__ import main

    monkeypatch.chdir(tmp_path)  # the log folder is made here
    page = bytearray(b'<a href="/2">x</a><script src="/a.js"></script>')
    rows = [("https://h/", "https://h/", 0, "static", 1, 200, "text/html", None, page), ("https://h/", "https://h/a.js", 0, "static", 2, 200, "text/javascript", None, bytearray(b"var a")), ("https://h/", "https://h/other.js", 0, "static", 3, 200, "text/javascript", None, bytearray(b"var b"))]
    spark.createDataFrame(rows, RESPONSES).write.parquet(str(tmp_path / "r"))
    given = [str(tmp_path / "r"), "-u", "https://h/", "-o", str(tmp_path / "out"), "-m", "static"]
    with pytest.raises(SystemExit):
        main([*given, "-H", "no colon at all", "-H", "Host: x"])
    said = capsys.readouterr().err
    assert "missing_colon" in said and "Host" in said
    main([*given, "-H", "X-A: b", "--replay", "--resume"])
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out" / "encode/js")).collect()] == ["https://h/a.js"]
    assert "https://h/" in (tmp_path / "logs" / "silkmill.log").read_text()
