import gzip
import json
import os
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from cairn.functions import cdx
from cairn.sources import files, lists, logs, sinks

ROW = ["com,example)/a", "20200101000000", "http://example.com/a", "text/html", "200", "A" * 32, "12"]


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_index_lists(spark, tmp_path):
    head, long_head = list(cdx.HEADER), list(cdx.EXTENDED_HEADER)
    put(tmp_path / "a.json", json.dumps([head, ROW, ROW, [], ["next key"]]))
    put(tmp_path / "sub/b.json", json.dumps([long_head, [*ROW[:6], "-", "noindex", "-", "18446744073709551615", "f.warc"]]))
    put(tmp_path / "c.json", "[]")
    put(tmp_path / "skip.txt", "x")
    rows = lists.index_lists(spark, str(tmp_path)).collect()
    assert sorted((r.pos, r.urlkey, r.length, r.filename) for r in rows) == [(0, ROW[0], "-", "f.warc"), (0, ROW[0], "12", None), (1, ROW[0], "12", None)]
    assert [r.resume_key for r in lists.resume_keys(spark, str(tmp_path)).collect()] == ["next key"]
    typed = {r.file_name: r for r in lists.typed_items(lists.index_lists(spark, str(tmp_path))).collect()}
    assert typed["f.warc"].length is None and str(typed["f.warc"].offset) == "18446744073709551615" and typed["f.warc"].redirect is None and typed[None].status_code == 200 and len(typed[None].digest_bytes) == 20
    put(tmp_path / "bad.json", json.dumps([head, ROW[:3]]))
    put(tmp_path / "worse.json", '[["other"]]')
    put(tmp_path / "none.json", "{")
    told = {os.path.basename(r.path): r.fault for r in lists.index_lists(spark, str(tmp_path), "report").where("fault is not null").collect()}
    assert told == {"bad.json": "row_length", "worse.json": "header", "none.json": "no_json"}
    assert lists.index_lists(spark, str(tmp_path), "skip").count() == 3
    with pytest.raises(Exception, match="index list"):
        lists.index_lists(spark, str(tmp_path)).collect()


def test_index_lists_parse_once(spark, tmp_path):
    """Neither the parse nor the check of the rows is repeated in what the optimizer makes of filters."""
    put(tmp_path / "a.json.gz", gzip.compress(json.dumps([list(cdx.HEADER), ROW, [], ["next key"]]).encode()))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for policy in ("fail", "skip", "report"):
        rows = lists.index_lists(spark, str(tmp_path), policy, "*.json.gz")
        assert plan(rows).count("from_json(") == 1 == plan(rows).count("exists(") and rows.count() == 1
    keys = lists.resume_keys(spark, str(tmp_path), "*.json.gz")
    assert plan(keys).count("from_json(") == 1 and [r.resume_key for r in keys.collect()] == ["next key"]


def test_written_lists(spark, tmp_path):
    """One file a list in a fixed number of folders, and no file for a table without rows."""
    from cairn.plans import source_queries

    for name, lists_written in (("some", 100), ("none", 0)):
        ids = spark.range(lists_written * 500).select(F.col("id").alias("capture_id"), *[F.when(F.col("id") % 7 > 0, F.concat(F.lit(f'{n} "\\ü,'), F.col("id").cast("string"))).alias(n) for n in cdx.HEADER])
        ids.repartition(5).write.parquet(str(tmp_path / name / "captures.parquet"))
        path = source_queries._written_lists(spark, str(tmp_path / name)).removeprefix("file:")
        found = [(at, f) for at, _, files_there in os.walk(path) for f in files_there if f.endswith(".txt.gz")]
        assert len(found) == lists_written and len({at for at, _ in found}) <= 32
        rows = source_queries.src1_index_lists(spark, str(tmp_path / name)).select(*cdx.HEADER, "n")
        assert sorted(map(str, rows.collect())) == sorted(map(str, ids.groupBy(*cdx.HEADER).agg(F.count("*").alias("n")).collect()))
        assert source_queries.src2_resume_keys(spark, str(tmp_path / name)).count() == (lists_written + 2) // 3


def test_walk_and_lists(spark, tmp_path):
    for i, n in enumerate("ba"):
        os.utime(put(tmp_path / f"{n}.json", "[]"), (i, i))
    name = lambda df: [os.path.basename(r.path) for r in df.collect()]
    assert name(lists.walk(spark, str(tmp_path))) == ["a.json", "b.json"] == name(lists.walk(spark, str(tmp_path), newest_first=True))
    d = "B" * 32
    assert sorted(map(tuple, lists.digest_list(spark, put(tmp_path / "d.txt", f" {d} \n\nx\n")).collect())) == [(d, True), ("x", False)]
    queue = put(tmp_path / "q.csv", f'"http://a/?x=""1,2""",20200101000000,{d}\nhttp://b,2020,{d}\n')
    assert [r.url for r in lists.download_queue(spark, queue, "skip").collect()] == ['http://a/?x="1,2"']
    with pytest.raises(Exception, match="timestamp"):
        lists.download_queue(spark, queue).collect()
    assert [tuple(r) for r in lists.requests(spark, put(tmp_path / "r.csv", "http://a, prefix, TRUE, 5\nhttp://b,exact,false\n")).collect()] == [("http://a", "prefix", True, 5), ("http://b", "exact", False, None)]
    assert lists.screen_names(spark, put(tmp_path / "n.txt", "ok_1\nno no\n"), "skip").count() == 1
    assert lists.digest_urls(spark, put(tmp_path / "u.csv", f"{d},https://twitter.com/a\n{d},\n{d},http://x\n"), policy="skip").count() == 2
    texts = spark.createDataFrame([("p", " ".join(ROW) + "\n" + " ".join([*ROW[:6], "-", "-", "9"]) + "\n\nkey")], "path string, value string")
    assert [(r.pos, r.length) for r in lists.classic_rows(texts).collect()] == [(0, "12"), (1, "9")]


def test_digest_files(spark, tmp_path):
    d = "C" * 32
    put(tmp_path / "s/CC" / d, "{}")
    put(tmp_path / "s/CC/x.tmp", "{}")
    put(tmp_path / "l" / (d.lower() + ".zst"), "x")
    put(tmp_path / "l/readme", "x")
    assert [(r.name, r.digest) for r in files.store_entries(spark, str(tmp_path / "s")).collect()] == [(d, d)]
    assert files.prefix_lengths(spark, str(tmp_path / "s")) == [2]
    assert sorted((r.digest or "", r.compression or "") for r in files.legacy_files(spark, str(tmp_path / "l")).collect()) == [("", ""), (d, "zst")]
    with pytest.raises(ValueError):
        files.prefix_lengths(spark, str(tmp_path / "s/CC" / "none").replace("none", "x.tmp"))


def test_numbered_lines(spark, tmp_path):
    data = "a\r\nb\n\nc".encode() + b"\n\xff"
    paths = [put(tmp_path / "p.txt", data), put(tmp_path / "p.zst", zstandard.compress(data)), put(tmp_path / "p.gz", gzip.compress(data))]
    rows = files.numbered_lines(spark, paths).collect()
    for p in paths:
        assert [(r.line_no, r.line, r.fault) for r in rows if r.path == p] == [(1, "a", None), (2, "b", None), (3, "", None), (4, "c", None), (5, None, "not UTF-8")]
    assert files.numbered_lines(spark, []).count() == 0


def test_warc(spark, tmp_path):
    def record(kind, status, body):
        block = f"HTTP/1.1 {status} X\r\nA: b\r\n\r\n".encode() + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    parts = [record("request", 200, b"q"), record("response", 200, b"body\r\n\r\n"), record("response", 404, b"n")]
    plain = put(tmp_path / "a.warc", b"".join(parts))
    packed = put(tmp_path / "a.warc.gz", b"".join(map(gzip.compress, parts)))
    assert [(r.path, bytes(r.body)) for r in files.warc_responses(spark, [plain, packed]).collect()] == [(plain, b"body\r\n\r\n"), (packed, b"body\r\n\r\n")]


def test_snapshot_files(spark, tmp_path):
    names = ["A" * 31 + x for x in "7Z2A"]
    df = spark.createDataFrame([(n, f'{{"digest":"{n}"}}') for n in names + names[:1]], "digest string, line string")
    out = str(tmp_path / "out")
    assert sum(r["rows"] for r in sinks.write_snapshot_files(df, out, 2).collect()) == 4
    lines = [r.line[11:43] for p in sorted(os.listdir(out)) for r in files.numbered_lines(spark, [f"{out}/{p}"]).collect()]
    assert [x[-1] for x in lines] == ["A", "Z", "2", "7"]  # by bytes, not by text
    sinks.write_snapshot_files(df, out, 2).collect()  # the same again is no conflict
    with pytest.raises(Exception, match="FileExists"):
        sinks.write_snapshot_files(df.withColumn("line", F.lit("x")), out, 2).collect()


def test_export_and_summary(spark, tmp_path):
    from cairn.functions import digest

    df = spark.createDataFrame([("{}",), ("[]",)], "content string").withColumn("digest", digest.sha1_base32(F.col("content")))
    bad = df.limit(1).select(F.lit("D" * 32).alias("digest"), "content")
    export = lambda: sorted(r.outcome for r in sinks.export_bytes(df.select("digest", "content").unionByName(bad), str(tmp_path / "e")).collect())
    assert export() == ["mismatch", "ok", "ok"] and export() == ["exists", "exists", "mismatch"]
    assert sinks.summary_json(df.agg(F.count("*").alias("n"))).first().summary == '{"n":2}'


def test_logs(spark, tmp_path):
    path = str(tmp_path / "log.db")
    with sqlite3.connect(path) as db:
        db.executescript("create table invalid_digest(id integer primary key, timestamp integer, url text, archive_timestamp integer, expected_digest text, actual_digest blob); create table withheld_url(id integer primary key, timestamp integer, url text)")
        db.execute("insert into invalid_digest values (1, 5, 'http://a,b', 0, 'x', ?), (2, 9, 'http://c', 0, 'y', ?)", (bytes(20), bytes(20)))
        db.execute("insert into withheld_url values (1, 7, 'http://w')")
    bad, withheld = logs.sqlite_log(spark, path)
    assert [(r.observed, r.archive_ts, r.actual_digest) for r in bad.collect()] == [(5, "19700101000000", "A" * 32), (9, "19700101000000", "A" * 32)]
    assert logs.sqlite_log(spark, path, since=6)[0].count() == 1 and withheld.count() == 1
    logs.write_csv_log(bad, withheld, str(tmp_path / "csv"))
    again, also = logs.csv_log(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, again.select(*bad.columns).collect())) == sorted(map(tuple, bad.collect())) and also.count() == 1
    logs.write_headerless(bad, str(tmp_path / "list"), ["url", "archive_ts"])
    assert spark.read.csv(str(tmp_path / "list")).count() == 2
