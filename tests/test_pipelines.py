import base64
import gzip
import hashlib
import json

import zstandard
from pyspark.sql import functions as F

from cairn.functions import gzipformat as g
from cairn.operators import archive, pipelines
from cairn.sources import files


def name(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


LOG = "actual_digest string, expected_digest string, observed bigint"
CAPS = "digest string, ts string, url string"


def test_pack_enhance_check(spark, tmp_path):
    bodies = [b'{"id":"%d"}\n' % i for i in range(1, 6)]
    n = [name(b) for b in bodies]
    for b in bodies:
        (tmp_path / name(b)).write_bytes(b)
    (tmp_path / "stray").write_bytes(b"x")
    (tmp_path / ("Q" * 32)).write_bytes(b"x\n")
    two = b"a\nb\n"
    (tmp_path / name(two)).write_bytes(two)
    bad = b"\xff\n"
    (tmp_path / name(bad)).write_bytes(bad)
    expected = {2: "B" * 32, 5: "E" * 32}
    log = spark.createDataFrame([(n[i - 1], e, 1) for i, e in expected.items()] + [(n[1], "C" * 32, 0)], LOG)
    packed = pipelines.pack(files.digest_files(spark, str(tmp_path)), log).cache()
    assert sorted((r.reason, r.digest or "") for r in packed.where("reason is not null").collect()) == sorted([("name_is_no_digest", ""), ("digest_mismatch", "Q" * 32), ("not_a_single_line", name(two)), ("not_utf8", name(bad))])
    lines = {r.digest: r.line for r in packed.where("line is not null").collect()}
    assert lines == {n[i - 1]: '{"digest":"%s",%s"content":{"id":"%d"}}' % (n[i - 1], f'"expected_digest":"{expected[i]}",' if i in expected else "", i) for i in range(1, 6)}

    caps = spark.createDataFrame([(n[0], "20200101000000", "http://a"), (expected[2], "20200102000000", "http://b"), ("D" * 32, "20200104000000", "http://d"), (n[4], "20200105000000", "http://e"), (expected[5], "20190101000000", "http://no")], CAPS)
    later = log.unionByName(spark.createDataFrame([(n[3], "D" * 32, 9)], LOG))
    snaps = spark.createDataFrame([(i, n[i - 1], expected.get(i), None, None) for i in range(1, 6)], "snap_id int, digest string, expected_digest string, ts string, url string")
    got = {r.snap_id: (r.expected_digest, r.url, r.outcome) for r in archive.enhance(snaps, caps, later).collect()}
    assert got == {1: (None, "http://a", "enhanced"), 2: ("B" * 32, "http://b", "enhanced"), 3: (None, None, "unmatched"), 4: ("D" * 32, "http://d", "enhanced"), 5: (None, "http://e", "enhanced")}

    ordered = spark.createDataFrame([("f", i, x) for i, x in enumerate([*[lines[k] for k in sorted(lines, key=base64.b32decode)], "no line", lines[n[0]]])], "file string, n int, line string")
    report = pipelines.plain_report(ordered, "file", "n").first()
    assert (report.valid, report.invalid, report.skipped, report.misplaced, report.lines) == (6, 1, 0, 1, 7)


def test_compact_with_gzip(spark, tmp_path):
    content = b'{"data":{"id":"123","text":"hello compact"}}'
    packed = g.reproduce(g.Params("zlib", 5, 1660840129, 3), content)
    other = gzip.compress(content, 6)[:-1] + b"\x01"  # a broken length: not reproducible
    flat = b'{"created_at":1}\r\n'
    bodies = [packed, other, flat, b"[]\n"]
    for b in bodies:
        (tmp_path / name(b)).write_bytes(b)
    caps = spark.createDataFrame([(name(packed), "20200101000000", "http://a"), (name(packed), "20210101000000", "http://b")], CAPS)
    log = spark.createDataFrame([], LOG)
    got = {r.digest: r for r in pipelines.compact_files(files.digest_files(spark, str(tmp_path)), caps, log).collect()}
    line = json.loads(got[name(packed)].line)
    assert line["format"]["type"] == "gzip" and line["url"] == "http://a" and line["content"] == json.loads(content) and got[name(packed)].place == "data"
    assert g.reproduce(g.Params.of(line["format"]), content) == packed
    assert got[name(other)].reason == "not_utf8" and got[name(b"[]\n")].reason == "no_partition" and got[name(flat)].place == "flat" and json.loads(got[name(flat)].line)["format"] == {"closing_whitespace": "\r\n"}
    skipped = pipelines.compact_files(files.digest_files(spark, str(tmp_path)), caps, log, skip_unresolved=True)
    assert {r.reason for r in skipped.collect()} == {None, "not_utf8", "no_partition", "unresolved"}


def test_legacy(spark, tmp_path):
    data = b'{"a":1}\n'
    (tmp_path / name(data).lower()).write_bytes(data)
    (tmp_path / (name(data) + ".gz")).write_bytes(gzip.compress(data))
    (tmp_path / (name(data) + ".zst")).write_bytes(zstandard.compress(data))
    (tmp_path / ("Z" * 32 + ".gz")).write_bytes(b"broken")
    checked = pipelines.legacy_verify(files.legacy_files(spark, str(tmp_path)))
    assert sorted((r.digest, r.ok) for r in checked.collect()) == sorted([(name(data), True)] * 3 + [("Z" * 32, False)])
    assert tuple(pipelines.verify_all(checked).first()) == (False, 4, 1) and tuple(pipelines.verify_all(checked.limit(0)).first()) == (True, 0, 0)


def test_extract(spark, tmp_path):
    body = b"com,a)/ 20200101000000 http://a text/html 200 " + b"A" * 32 + b" 5\n\nnext\n"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    record = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record)
    assert [tuple(r) for r in pipelines.extract_rows(spark, [str(tmp_path / "a.warc")]).collect()] == [("http://a", "20200101000000", "A" * 32, "text/html", "200")]


def test_migrate(spark):
    rows = ['{"format":"gzip","digest":"A","content":{"x":1.0, "\\u00e9":[ ]},"closing_whitespace":"\\r\\n"}', '{"digest":"A","format":"utf8","content":1}', '{"digest":"A","format":{"type":"x"},"content":1}', "no", None, "[]"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, v string").orderBy("i").select(pipelines.migrated(F.col("v"))).collect()]
    assert got == ['{"digest":"A","format":{"type":"gzip","closing_whitespace":"\\r\\n"},"content":{"x":1.0, "\\u00e9":[ ]}}', '{"digest":"A","content":1}', '{"digest":"A","format":{"type":"x"},"content":1}', None, None, None]
