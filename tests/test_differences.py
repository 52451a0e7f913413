import json

import pandas as pd

from cairn.operators.differences import compare_copies, copies_of_lines, found_differences
from cairn.plans import problems


def clean(d):
    return d.strip().upper().removeprefix("SHA1:")


def test_against_brute_force(spark, folder):
    def load(name, column):
        d = pd.read_parquet(f"{folder}/{name}.parquet")
        return {clean(k): json.loads(v) for k, v in zip(d.digest, d[column])}

    a, b = load("merge_first", "first_value"), load("merge_second", "second_value")
    want = {(k, "first", "") for k in a.keys() - b.keys()} | {(k, "second", "") for k in b.keys() - a.keys()}
    want |= {(k, "both", f) for k in a.keys() & b.keys() for f in problems.FIELDS if a[k].get(f) != b[k].get(f)}
    got = [tuple(r) for r in problems.p2_found(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {s for _, s, _ in got} == {"first", "second", "both"}


def lines(spark, rows):
    return spark.createDataFrame([(d, v, "extra") for d, v in rows], "digest string, line string, timestamp string")


def compared(spark, first, second):
    from pyspark.sql import functions as F

    copies = copies_of_lines(lines(spark, first), lines(spark, second), F.col("digest"), {"first": "line", "second": "line"}, problems.FIELDS)
    return compare_copies(*copies, "digest", problems.FIELDS)


def test_ways_of_writing_and_nulls(spark):
    first = [("A", '{"url":"u","content":{"a":1,"b":null}}'), ("A", '{"url":"u","content":{"a":1.0}}'), (None, '{"content":1}'), ("B", "broken"), ("C", None), ("D", '{"content":"1"}'), ("E", '{"url":"é"}')]
    second = [("A", '{ "content": {"a": 1}, "url": "\\u0075", "format": null }'), (None, '{"content":2}'), ("B", "broken"), ("C", "{}"), ("D", '{"content":1}'), ("E", '{"url":"e"}')]
    got = {(r.digest, r.side): {d.field: (d.first, d.second) for d in r.differences} for r in compared(spark, first, second).collect()}
    assert got == {(None, "both"): {"content": ("1e0", "2e0")}, ("D", "both"): {"content": ('"1"', "1e0")}, ("E", "both"): {"url": ('"\\u00e9"', '"e"')}}


def test_empty_copies_and_disagreeing_rows(spark):
    some = [("A", '{"url":"a"}'), ("A", '{"url":"b"}')]
    assert compared(spark, [], []).count() == 0
    assert [tuple(r) for r in found_differences(compared(spark, some, []), "digest").collect()] == [("A", "first", "")]
    assert compared(spark, some, some[::-1]).count() == 0
    got = compared(spark, some, some[:1]).collect()
    assert [(d.field, d.first, d.second) for d in got[0].differences] == [("url", '"b"', '"a"')]


def test_sets_of_rows(spark):
    def row(url, content):
        return ("A", json.dumps({"url": url, "content": content}))

    def told(first, second):
        return [[tuple(d) for d in r.differences] for r in compared(spark, first, second).collect()]

    a, b, c = row("a", 1), row("b", 1), row("c", 1)
    assert told([a, b, c], [a, c, a]) == [[("url", '"b"', '"a"')]] and told([a, c], [a, b, c]) == [[("url", '"a"', '"b"')]]
    crossed = told([row("x", 1), row("y", 2)], [row("x", 2), row("y", 1)])
    assert [[d[0] for d in ds] for ds in crossed] == [["url", "content"]]
    assert told([row("x", 1), row("y", 2), b], [b, row("y", 2), row("x", 1), b]) == []
    assert told([row("x", 1), row(None, 1)], [row("x", 1)]) == [[("url", None, '"x"')]]
    many = [row(f"{i:03}", i % 7) for i in range(300)]
    assert told(many, many[::-1]) == [] and told(many, many[:150] + many[151:]) == [[("url", '"150"', '"000"')]]
