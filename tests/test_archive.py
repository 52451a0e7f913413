import pytest
from pyspark.sql import functions as F

from cairn.functions import digest, snapshot
from cairn.operators import archive

A, B, C, D = ("A" * 31 + x for x in "A2BC")
CAPS = "digest string, ts string, url string"
LOG = "actual_digest string, expected_digest string, observed bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resolution(spark):
    caps = spark.createDataFrame([(A, "2", "u"), (A, "1", "v"), (A, "1", "v"), (A, "1", "w"), (B, "5", "x"), (C, "5", "x"), ("bad", "5", "x"), (None, "1", "n"), (D, None, "n")], CAPS)
    log = spark.createDataFrame([(D, C, 1), (D, B, 2), (D, "bad", 3), (D, None, 4), (A, B, 1)], LOG)
    targets = spark.createDataFrame([(A,), (D,), ("none",), (A,)], "digest string")
    out = archive.resolve(targets, caps, log)
    least = min((B, C), key=lambda x: __import__("base64").b32decode(x))
    assert rows(out) == sorted([(A, "1", "v", None, 2), (D, "5", "x", least, 2)], key=str)
    assert rows(archive.missing(targets, caps, log)) == [("none",)]
    unused = rows(archive.unused_captures(targets, caps, log))
    assert len(unused) == 4 and (A, None, "1", "w") in unused and (D, None, "5", "x") not in unused and not any(r[1] == least for r in unused)
    big = {r.digest: (r.n, r.captures is None) for r in archive.captures_by_digest(caps, most=2).collect()}
    assert big == {A: (3, True), B: (1, False), C: (1, False), "bad": (1, False)}
    assert archive.resolve(targets, caps.limit(0), log).count() == 0 and archive.resolve(targets.limit(0), caps, log).count() == 0
    assert [[tuple(x) for x in r.captures] for r in archive.captures_by_digest(caps).where(F.col("digest") == A).collect()] == [[("1", "v"), ("1", "w"), ("2", "u")]]


def test_enhance(spark):
    snaps = spark.createDataFrame([(1, A, B, None, None), (2, D, B, None, None), (3, D, None, None, "own"), (4, "X", "y", None, None), (5, A, None, "9", "u")], "snap_id int, digest string, expected_digest string, ts string, url string")
    caps = spark.createDataFrame([(A, "1", "a"), (B, "2", "b"), (C, "3", "c")], CAPS)
    log = spark.createDataFrame([(D, A, 1), (D, C, 2), (D, "bad", 3)], LOG)
    assert rows(archive.enhance(snaps, caps, log)) == [(1, A, None, "1", "a", "enhanced"), (2, D, B, "2", "b", "enhanced"), (3, D, C, "3", "c", "enhanced"), (4, "X", "y", None, None, "unmatched"), (5, A, None, "9", "u", "already")]


def test_merges(spark):
    f = spark.createDataFrame([(A, "same"), (B, "short"), (C, "é"), ("F", "first")], "digest string, line string")
    s = spark.createDataFrame([(A, "same"), (B, "longer"), (C, "ab"), ("S", "second")], "digest string, line string")
    assert rows(archive.merge_pair(f, s)) == sorted([(A, "match", "same"), (B, "collision", "short"), (C, "collision", "ab"), ("F", "first", "first"), ("S", "second", "second")], key=str)
    new = spark.createDataFrame([("N1", "first"), ("N2", "second"), ("N3", "skip"), (A, "first")], "digest string, to string")
    got = rows(archive.dual_merge(f, s, new, F.col("to")))
    assert [r for r in got if r[2] == "new"] == [("first", "N1", "new"), ("second", "N2", "new"), ("skip", "N3", "new")] and len(got) == 11


@pytest.mark.parametrize("block", [2, 3, 100_000])
def test_orders(spark, monkeypatch, block):
    monkeypatch.setattr(archive, "BLOCK", block)
    keys = [A, A, C, B, None, D, B]
    df = spark.createDataFrame([("f", i, k, k != D) for i, k in enumerate(keys)], "file string, n int, name string, good boolean")
    ok = lambda prev, k: "ok" if prev is None or digest_order(k) > digest_order(prev) else "duplicate" if k == prev else "out_of_order"
    digest_order = lambda k: __import__("base64").b32decode(k)
    want, prev = [], None
    for k in keys:
        want.append("invalid" if k is None else ok(prev, k))
        prev = k or prev
    assert [r.status for r in archive.order_report(df, "file", "n", "name").orderBy("n").collect()] == want
    want, prev = [], None
    for k in keys:
        status = "invalid" if k is None or k == D else ok(prev, k)
        want.append(status)
        prev = k if status == "ok" else prev
    assert [r.status for r in archive.accepted_order_report(df, "file", "n", "name", F.col("good")).orderBy("n").collect()] == want
    assert archive.order_report(df.limit(0), "file", "n", "name").count() == 0


@pytest.mark.parametrize("block", [2, 100_000])
def test_merge_errors(spark, monkeypatch, block):
    monkeypatch.setattr(archive, "BLOCK", block)
    start = '{"digest":"%s","content":1}'
    lines = [start % A, ' {"digest":"%s"}' % B, start % A, start % D, start % C, start % B, "", None, '{"digest": "%s"}' % D, '{"digest":"%s"}' % D.lower()]
    first = spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "line_number bigint, line string")
    second = spark.createDataFrame([(1, start % A), (2, start % C), (3, start % C)], "line_number bigint, line string")
    got = rows(archive.merge_errors(first, second))
    invalid = [("first", i, "invalid_line", None, lines[i - 1]) for i in (2, 7, 8, 9, 10)]
    assert got == sorted([*invalid, ("first", 3, "duplicate", A, None), ("first", 5, "out_of_order", C, None), ("second", 3, "duplicate", C, None)], key=str)
    assert archive.merge_errors(second.limit(2), second.limit(0)).count() == 0


def test_check_report(spark):
    def line(content, extra="", name=None, space="\n"):
        made = __import__("base64").b32encode(__import__("hashlib").sha1((content + space).encode()).digest()).decode()
        return '{"digest":"%s",%s"content":%s}' % (name or made, extra.replace("SAME", made), content)

    time, flat = '"timestamp":"20200101000000",', '{"user":{"screen_name":"n"},"id_str":"7"}'
    data = '{"data":{"id":"5","author_id":"1"},"includes":{"users":[{"id":"2","username":"m"},{"id":"1","username":"n"}]}}'
    cases = [
        (line("1", time), "ok", []),
        (line("2"), "ok", ["missing_timestamp"]),
        (line("3", '"url":"http://u",'), "ok", ["missing_timestamp", "url_without_timestamp"]),
        (line("4", '"url":"",'), "ok", ["missing_timestamp", "url_without_timestamp"]),
        (line("5", '"format":{"url":"x"},'), "ok", ["missing_timestamp"]),
        (line("6", '"expected_digest":"SAME",' + time), "ok", ["redundant_expected_digest"]),
        (line("7", f'"expected_digest":"{A}",' + time), "ok", []),
        (line("8", f'"expected_digest":"{A}",' + time, name=A), "mismatch", ["redundant_expected_digest"]),
        (line(data, time + '"url":"https://twitter.com/n/status/5",'), "ok", ["redundant_url"]),
        (line(data, time + '"url":"https://twitter.com/m/status/5",'), "ok", []),
        (line(flat, '"url":"https://twitter.com/n/status/7",', name=B), "mismatch", ["missing_timestamp", "url_without_timestamp", "redundant_url"]),
        (line("9", '"format":{"type":"other"},'), "unsupported_format", ["missing_timestamp"]),
        (line("10", '"url":"u","format":{"closing_whitespace":"x"},'), "closing_whitespace", []),
        (line("11", '"timestamp":"20201301000000","url":"u",'), "invalid_line", []),
        ("no line", "invalid_line", []),
    ]
    df = spark.createDataFrame([("f", 2 * i, x) for i, (x, _, _) in enumerate(cases)] + [("f", 2 * i + 1, "") for i in range(3)], "file string, n int, line string")
    got = archive.check_report(df, "file", "n").orderBy("n").collect()
    kinds = ("missing_timestamp", "url_without_timestamp", "redundant_expected_digest", "redundant_url")
    assert [(r.n, r.state, [k for k in kinds if r[k]]) for r in got] == [(2 * i, state, found) for i, (_, state, found) in enumerate(cases)]
    bad = '{"digest":"%s","timestamp":"20201301000000","content":1}' % B  # its digest is the greatest, but it isn't read
    df = spark.createDataFrame([("f", 1, line("1", name=A)), ("f", 2, bad), ("f", 3, line("1", name=D)), ("f", 4, line("1", name=D)), ("f", 5, line("1", name=C))], "file string, n int, line string")
    assert [r.status for r in archive.check_report(df, "file", "n").orderBy("n").collect()] == ["ok", "invalid", "ok", "duplicate", "out_of_order"]


def test_nested_formats(spark):
    def line(form, content="{}", extra=""):
        return '{"digest":"%s",%s"format":%s,"content":%s}' % (A, extra, form, content)

    deep = '{"type":"x","meta":' + '{"a":[' * 3000 + "1" + "]}" * 3000 + "}"
    tricky = '{"m":{"s":"},\\"content\\":{\\\\","url":"no"}, "n":[{}]}'
    good = [(tricky, '{"a":{},"content":{"content":1}}', ""), (deep, "1", ""), ('{"m":{}}', "", '"expected_digest":"%s","timestamp":"20200101000000","url":"",' % B), ('{"closing_whitespace":"\\r\\n","m":{"x":1}}', "1", '"url":"http://u",')]
    bad = [line('{"m":{"x":1}'), line('{"m":{"x":01}}'), line('{"m":{}}}'), line('{"m":{}},"extra":1'), line('{"type":{"x":1}}'), line('{"m":{}}', "1")[:-1], '{"digest":"%s","format":{"m":{}}}' % A, None, ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([line(f, c, e) for f, c, e in good] + bad)], "n int, line string")
    got = [r.p for r in df.select("n", snapshot.parse(F.col("line")).alias("p")).orderBy("n").collect()]
    assert [(p.digest, p.format, p.content) for p in got[: len(good)]] == [(A, f, c) for f, c, _ in good] and got[len(good) :] == [None] * len(bad)
    assert [(p.expected_digest, p.timestamp, p.url) for p in got[: len(good)]] == [(None, None, None), (None, None, None), (B, "20200101000000", ""), (None, None, "http://u")]
    files = spark.createDataFrame([("f", 1, line(good[0][0])), ("f", 2, line('{"type":"x","m":{}}'))], "file string, n int, line string")
    assert [(r.state, r.status) for r in archive.check_report(files, "file", "n").orderBy("n").collect()] == [("mismatch", "ok"), ("unsupported_format", "duplicate")]


def test_state(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 1, "b"), ("l", 1, None, None)], "key string, seen int, id int, value string").withColumn("o", F.col("seen"))
    assert rows(archive.upsert(df, ["key"], [F.col("o")]).select("key", "value")) == [("k", "b"), ("l", None)]
    status = spark.createDataFrame([(True, 5), (False, 5), (None, 3), (None, None)], "done boolean, timeout int")
    assert [r[0] for r in status.select(archive.lease_status(F.col("done"), F.col("timeout"), F.lit(4))).collect()] == ["done", "in_progress", "available", "available"]
    log = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "key string, observed int")
    assert rows(archive.log_merge(log, log, key=["key"], observed="observed")) == [("a", 3), ("b", 1)]
    assert rows(archive.log_import(log.where("observed = 5"), log, ["key"], "observed")) == [("a", 5), ("b", 1)]
    files = spark.createDataFrame([("new", 0, "x"), ("mid", 1, "x"), ("old", 2, "y"), ("old", 2, "x"), ("none", 3, None)], "file string, rank int, name string")
    assert rows(archive.unused_files(files, "file", "rank", "name")) == [("mid", "-"), ("new", "+"), ("none", "0"), ("old", "+")]
    assert digest.PATTERN
