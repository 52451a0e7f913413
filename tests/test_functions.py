import base64
import datetime
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import cdx, digest, snapshot, surt, times, urls

c = F.col


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(c("v"))).first()[0]


def many(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(c("v")).alias("o")).collect())] if not values else [r.o for r in df.select("i", f(c("v")).alias("o")).orderBy("i").collect()]


def test_digests(spark):
    texts = ["", "a", "é", "x" * 10_000, None] + [str(i) for i in range(200)]
    want = [None if t is None else base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
    assert many(spark, texts, digest.sha1_base32) == want
    back = many(spark, want, digest.digest_bytes)
    assert [b and base64.b32encode(bytes(b)).decode() for b in back] == want
    good = sorted((w for w in want if w), key=base64.b32decode)
    assert sorted(good, key=dict(zip(good, many(spark, good, digest.order_key))).get) == good
    odd = ["a" * 32, "A" * 31, "A" * 33, "1" * 32, "", None, "A" * 32 + "\n"]
    assert many(spark, odd, digest.digest_bytes) == [None] * 7 and many(spark, odd, digest.is_digest) == [False] * 7
    assert many(spark, [" sha1:" + "a" * 32 + " ", "-", "", None, "SHA1:x"], digest.clean_digest) == ["A" * 32, None, None, None, None]


def test_times(spark):
    values = ["20200229235959", "20190229000000", "20200101006000", "20200101000060", "09991231235959", "10000101000000", "99991231235959", "2020010100000", " 20200101000000", "", None, "2020010100000O"]
    seconds = many(spark, values, lambda v: times.to_unix(times.parse(v)))
    assert [x is not None for x in seconds] == [True, False, False, False, False, True, True, False, False, False, False, False]
    assert seconds[5] == times.LEAST and seconds[6] == times.MOST and many(spark, values, times.is_real) == [x is not None for x in seconds]
    assert many(spark, [times.LEAST - 1, times.MOST + 1, 0, None], lambda v: times.text_of(times.from_unix(v)), "bigint") == [None, None, "19700101000000", None]
    assert many(spark, [datetime.datetime(1969, 12, 31, 23, 59, 59, 1), datetime.datetime(1970, 1, 1, 0, 0, 0, 999_999)], times.observed_second, "timestamp") == [-1, 0]


SURTS = {
    "https://www.Example.com./A//b///": "com,example)/a/b", "http://example.com:80/": "com,example)", "https://example.com:443/x?b=2&a=1&a=0": "com,example)/x?a=1&a=0&b=2",
    "http://a.www.b.org?k": "org,b,a)?k=", "https://e.com/a%7Bb%7d%2F": "com,e)/a{b}%2f", "https://e.com/x?a=1%262&b=3#f": "com,e)/x?a=1%262&b=3", "https://e.com/x?q=a+b%20c": "com,e)/x?q=a+b+c",
    "https://e.com/x?q=50%": "com,e)/x?q=50%", "https://e.com:8080/": None, "ftp://e.com/": None, "https://www/path": None, "https://1.2.3.4/": None, "https://e.com/a/../b": None, "https://u@e.com/": None, "mailto:x": None, "": None,
    "https://" + "a" * 300 + ".com/": None, "https://e.com/?": "com,e)", "https://e.com/x?q=a%2Bb": "com,e)/x?q=a%20b",
}


def test_surts(spark):
    assert dict(zip(SURTS, many(spark, list(SURTS), surt.from_url))) == SURTS
    keys = ["com,example:8080)/p?q)r", "localhost:8080)/x", "com)/path", "com", "com,)/x", ",com)/x", ")/x", "a" * 255 + ")", "a" * 256 + ")", "", None]
    assert many(spark, keys, surt.is_key) == [True, True, True, False, False, False, False, True, False, False, False]
    assert many(spark, keys, surt.canonical_url)[:4] == ["https://example.com:8080/p?q)r", "https://localhost:8080/x", "https://com/path", None]


def test_urls(spark):
    pages = many(spark, ["http://a/", 'x"y', "", None], lambda v: urls.redirect_target(urls.redirect_page(v)))
    assert pages == ["http://a/", None, None, None] and one(spark, "x<html>", urls.redirect_target) is None
    base = "https://web.archive.org/web/20200101000000"
    told = many(spark, [base + "id_/http://a", base.replace("https", "http") + "/b?c", base + "idx/http://a", base + "/", base + "/a\nb", "x" + base + "/a", base.replace("0101", "0230") + "/a", None], urls.replay_target)
    assert told == ["http://a", "b?c", None, None, None, None, None, None]
    assert many(spark, ["a b\n\nkey+1%2C", "a\nb", "k", "", "a\n\n"], urls.resume_key) == ["key 1,", None, None, None, None]
    assert one(spark, 1, lambda v: urls.retry_bounds(60_000, 600_000, 7), "int") == [60_000, 120_000, 240_000, 480_000, 600_000, 600_000, 600_000]
    assert one(spark, "ABCDEF", lambda v: urls.store_path(v, (2, 2), ".zst")) == "AB/CD/ABCDEF.zst" and one(spark, "ABC", lambda v: urls.store_path(v, ())) == "ABC"


def test_record_fields(spark):
    assert many(spark, ["-", "200", "299", "530", "", None], cdx.status_value) == [0, 200, None, 530, None, None]
    assert many(spark, ["-", "200", "530", "404"], cdx.status_logical) == [200, 200, 500, 404]
    assert many(spark, ["-", "12", "-3", "x", "9" * 30, None], cdx.length_value) == [None, 12, -3, None, None, None]
    assert many(spark, ["-", "12", "x", "9" * 30, None], cdx.length_fault) == [False, False, True, True, False]
    long = lambda v: cdx.item_fault(F.lit("k"), F.lit(0), v, F.lit(None).cast("string"), F.lit("x"), F.lit(False))
    assert many(spark, ["é" * 32_767, "é" * 32_768], long) == [None, "url_too_long"]


LINE = '{"digest":"%s","expected_digest":"%s","timestamp":"20200101000000","url":"http://a","format":{"type":"x","n":"}{\\""},"content":{"url":"no"}}' % ("A" * 32, "b" * 32)


def test_snapshot_lines(spark):
    p = one(spark, LINE, snapshot.parse)
    assert (p.expected_digest, p.timestamp, p.url, p.format, p.content) == ("b" * 32, "20200101000000", "http://a", '{"type":"x","n":"}{\\""}', '{"url":"no"}')
    short = one(spark, '{"digest":"%s","content":{"url":"no","x":1}}' % ("A" * 32), snapshot.parse)
    assert short.url is None and short.content == '{"url":"no","x":1}'
    assert many(spark, [LINE[:-2], " " + LINE, "", None, LINE.replace("A" * 32, "a" * 32)] + [LINE[:i] for i in range(0, len(LINE), 7)], snapshot.parse) == [None] * (5 + len(range(0, len(LINE), 7)))
    assert one(spark, LINE, lambda v: snapshot.render(*[snapshot.parse(v)[f] for f in snapshot.PARTS])) == LINE
    assert one(spark, 'a"b', lambda v: snapshot.render(F.lit("A"), v, F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("1"))) is None
    u = many(spark, ["{}\r\r\n", "a\nb", " \n", ""], snapshot.unprocessed)
    assert [(x.content, x.space, x.fault) for x in u] == [("{}", "\r\r\n", None), ("a\nb", "", "internal_line_break"), ("", " \n", None), ("", "", None)]
    assert many(spark, ["{}\n", "{}\r\n", "{}"], lambda v: snapshot.closing_whitespace(v, "\n")) == [None, "\r\n", ""]
    posts = ['{"data":{"id":"1","author_id":"2"},"includes":{"users":[{"id":"2","username":"u"}]}}', '{"data":{"id":1,"author_id":"2"},"includes":{"users":[{"id":"2","username":"u"}]}}', '{"id_str":"5","user":{"screen_name":"s"}}', "{", None, '{"data":{}}']
    assert many(spark, posts, snapshot.inferred_url) == ["https://twitter.com/u/status/1", None, "https://twitter.com/s/status/5", None, None, None]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet='ab{}",:\\ \n', max_size=30), min_size=1, max_size=20))
def test_parse_never_breaks(spark, parts):
    lines = ['{"digest":"' + "A" * 32 + '",' + p for p in parts]
    for got, line in zip(many(spark, lines, snapshot.parse), lines):
        assert got is None or line.endswith("}")


@pytest.mark.parametrize("n", [0, 1])
def test_small_lists(spark, n):
    assert len(many(spark, ["x"] * n or ["y"], digest.clean)) == 1
