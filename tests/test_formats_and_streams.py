import base64
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import gzipformat as g
from cairn.functions import registry, urlrule
from cairn.streaming import index


@pytest.mark.parametrize("p", [g.Params("zlib", 5, 1234567890, 3), g.Params("zlib", 9), g.Params("zlib", 1, flushes=(10, 500)), g.Params("zlib", 6, extra_flushes=2), g.Params("zlib", 4, flushes=(7,), no_final_flush=True)])
def test_gzip_round_trip(p):
    content = ('{"n":7,"words":["lorem","ipsum"]}' * 40).encode()
    archive = g.reproduce(p, content)
    assert gzip.decompress(archive) == content
    found = g.infer(archive)
    assert g.reproduce(found, content) == archive and g.Params.of(found.metadata()) == found
    assert (found.mtime, found.os, found.flushes, found.extra_flushes, found.no_final_flush) == (p.mtime, p.os, p.flushes, p.extra_flushes, p.no_final_flush)


def test_gzip_unfit():
    good = g.reproduce(g.Params("zlib", 6), b"abc")
    for bad in (None, b"", b"abc", good[:-1], good + good, good[:-4] + b"\0\0\0\0", g.reproduce(g.Params("zlib", 6), b"\xff")):
        assert g.decompress(bad) is None and g.infer(bad) is None
    for text in ('{"compressor":"go","level":5}', '{"compressor":"zlib","level":12}', '{"compressor":"zlib","level":5,"flushes":[99]}', '{"compressor":"zlib"}', "x", None):
        assert g.encode("abc", text) == b"abc"
    assert g.encode(None, None) is None and g.Params.of({"compressor": "zlib", "level": 1, "os": 7}) is None and g.Params.of({"compressor": "zlib", "level": 1, "other": 1}) == g.Params("zlib", 1)
    rng = random.Random(1)
    for _ in range(200):
        g.infer(b"\x1f\x8b\x08\x00" + rng.randbytes(40))


def test_codec_columns(spark, tmp_path):
    (tmp_path / "c.toml").write_text('closing_whitespace = "\\r\\n"\nurl_query = "\'https://t.test/\' + content.id"\n')
    context = registry.Context.load(str(tmp_path / "c.toml"))
    archive = g.reproduce(g.Params("zlib", 5, 7, 3), b'{"id":"1"}')
    df = spark.createDataFrame([(archive, '{"id":"1"}', None), (b"x", '{"id":1}', '{"type":"brotli"}')], "data binary, content string, form string")
    rows = df.select(g.detected(F.col("data")).alias("found"), g.decompressed(F.col("data")).alias("text"), context.encoded(F.col("content"), F.col("form")).alias("bytes"), context.infer_url(F.col("content")).alias("url")).collect()
    assert json.loads(rows[0].found) == {"type": "gzip", "compressor": "zlib", "level": 2, "mtime": 7, "os": 3}  # the first level that gives these bytes
    assert rows[0].text == '{"id":"1"}' and bytes(rows[0]["bytes"]) == b'{"id":"1"}\r\n' and rows[0].url == "https://t.test/1"
    assert rows[1].found is None and rows[1].text is None and rows[1]["bytes"] is None and rows[1].url is None
    again = spark.createDataFrame([('{"id":"1"}', rows[0].found)], "content string, form string").select(context.encoded(F.col("content"), F.col("form")).alias("b")).first().b
    assert bytes(again) == archive and base64.b32encode(hashlib.sha1(again).digest())


THREAD = "'https://t.test/' + (has(content.thread) ? content.members.filter(m, m.key == content.thread.owner)[0].name + '#' + content.thread.no : content.author.label)"


def test_url_rules(spark):
    def told(rule, *contents):
        df = spark.createDataFrame(list(enumerate(contents)), "i int, v string").orderBy("i")
        return [r[0] for r in df.select(urlrule.compiled(rule)(F.col("v"))).collect()]

    threads = ['{"thread":{"no":"8","owner":"k"},"members":[{"key":"j"},{"key":"k","name":"kim"}]}', '{"thread":{"no":8,"owner":"k"},"members":[{"key":"k","name":"kim"}]}', '{"author":{"label":"lee"}}', '{"thread":{}}', "{", None, "[]"]
    assert told(THREAD, *threads) == ["https://t.test/kim#8", None, "https://t.test/lee", None, None, None, None]
    assert told("'a' + content.id", '{"id":"1"}', '{"id":1}', '{"id":null}', "{}") == ["a1", None, None, None]
    assert told("content.a[1].b", '{"a":[1,{"b":"x"}]}', '{"a":[1]}') == ["x", None]
    assert told("(content.n == 3 && !(content.t != 'x') || false) ? \"yes\" : 'no'", '{"n":3,"t":"x"}', '{"n":"3","t":"x"}', "{}") == ["yes", "no", "no"]
    for bad in ("", "content.", "content.a ? 'x'", "other.a", "content.a & 1", "content.a content.b", "content[x]"):
        with pytest.raises(ValueError):
            urlrule.compiled(bad)(F.col("v"))


def test_fill_index(spark, tmp_path):
    schema = "key string, value int, seen int"
    rows = [("a", 1, 1), ("b", 2, 1), ("a", 3, 2), ("a", 4, 1)]
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        index.fill_index(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["key"], ["seen"]).awaitTermination()
        assert i or index.index_version(spark, str(tmp_path / "t")).count() == 2
    assert sorted(map(tuple, index.index_version(spark, str(tmp_path / "t")).select("key", "value", "seen").collect())) == [("a", 3, 2), ("b", 2, 1)]
    assert index.index_version(spark, str(tmp_path / "none")) is None and index.index_version(spark, str(tmp_path / "t"), 0).count() == 2
    folders = sorted((p.parent.name, p.name) for p in (tmp_path / "t/data").glob("*/bucket=*"))
    assert len(folders) == 3 and [f[0] for f in folders] == ["0", "0", "1"]  # the second batch left b's bucket alone


def run(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_leases(spark, tmp_path):
    schema = "key string, at bigint, action string, seconds bigint"
    spark.createDataFrame([("a", 10, "claim", 5), ("b", 10, "claim", 5), ("b", 20, "done", 0), ("c", 10, "claim", 5), ("c", 11, "release", 0), ("d", 10, "claim", 0)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    got = run(spark, index.leases(spark.readStream.schema(schema).json(str(tmp_path / "in"))), "leases", "update")
    assert sorted(map(tuple, got)) == [("a", "in_progress", 15), ("b", "done", None), ("c", "available", None), ("d", "available", None)]


def test_first_observations_and_windows(spark, tmp_path):
    schema = "key string, at timestamp"
    spark.sql("select * from values ('a', timestamp'2020-01-01 00:00:01'), ('a', timestamp'2020-01-01 00:00:02'), ('b', timestamp'2020-01-01 00:10:00') t(key, at)").coalesce(1).write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).json(str(tmp_path / "in"))
    assert len(run(spark, index.first_observations(stream(), ["key"]), "firsts", "append")) == 2
    got = run(spark, index.windowed_counts(stream(), "at", "5 minutes", "1 minute", "key"), "windows", "complete")
    assert sorted((r.key, r.n) for r in got) == [("a", 2), ("b", 1)]
