import json

import pandas as pd

from cairn.operators import nested
from cairn.plans import problems

ABSENT = object()


def items(v):
    if v is ABSENT or v is None:
        return
    for i, x in enumerate(v if isinstance(v, list) else [v]):
        if x is not None:
            yield i, x


def member(v, name):
    return v.get(name, ABSENT) if isinstance(v, dict) else ABSENT


def text(v):
    return "" if v is None or v is ABSENT else str(v)


def cases(content):
    """Brute force: the table of TESTDATA.md, read literally."""
    try:
        v = json.loads(content)
        v = json.loads(v) if isinstance(v, str) else v
    except (ValueError, TypeError):
        return
    for i, post in items(member(v, "data")):
        yield "post", -1, -1, i, text(member(post, "id"))
        if text(member(post, "text")) or member(post, "text") == "":
            yield "text", -1, i, 0, text(member(post, "text"))
        for j, x in items(member(post, "edit_history_tweet_ids")):
            yield "edit", -1, i, j, text(x)
        for j, x in items(member(post, "referenced_tweets")):
            yield "ref", -1, i, j, text(member(x, "id"))
        for j, url in items(member(member(post, "entities"), "urls")):
            yield "url", -1, i, j, text(member(url, "url"))
            for k, x in items(member(url, "images")):
                yield "image", i, j, k, text(member(x, "url"))
    for i, x in items(member(v, "errors")):
        yield "error", -1, -1, i, text(member(x, "detail"))
    for i, x in items(member(member(v, "includes"), "users")):
        yield "user", -1, -1, i, text(member(x, "id"))
    for i, m in items(member(member(v, "includes"), "media")):
        yield "media", -1, -1, i, text(member(m, "media_key"))
        for j, x in items(member(m, "variants")):
            yield "variant", -1, i, j, text(member(x, "url"))


def test_against_brute_force(spark, folder):
    rows = pd.read_parquet(f"{folder}/snapshots.parquet", columns=["snap_id", "content"])
    want = sorted((s, *c) for s, t in zip(rows.snap_id, rows.content) for c in cases(t))
    got = sorted(tuple(r) for r in problems.p1_found(spark, folder).collect())
    assert got == want and len(got) > 100


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "{"), (4, "7"), (5, '"{\\"data\\": {\\"id\\": 12345678901234567890}}"'), (6, '{"data": [null, {"id": null}, "x", []]}'), (None, '{"errors": {"detail": true}}'), (7, "[" * 50_000 + "]" * 50_000), (8, '{"data":{"id":"\\ud800"}}'), (5, '{"data":[]}')]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "id bigint, doc string, label string, path string")
    nodes = nested.dewey_nodes(df, "id", "doc", nested.paths_of(problems.ANSWER))
    got = {(r.id, r.rel, tuple(r.places), r.child_key) for r in nested.kinds_of_records(nodes, "id", problems.ANSWER, problems.CHILD_KEY).collect()}
    assert got == {(5, "post", (0,), "12345678901234567890"), (6, "post", (1,), ""), (6, "post", (2,), ""), (6, "post", (3,), ""), (None, "error", (0,), "true"), (8, "post", (0,), "�")}
    assert nested.dewey_nodes(df.limit(0), "id", "doc").count() == 0


def test_tables_link_child_to_parent(spark):
    df = spark.createDataFrame([(1, '{"data":[{"id":"a"},{"id":"b","entities":{"urls":[null,{"url":"u","images":{"url":"i"}}]}}]}')], "id int, doc string")
    t = nested.tables(nested.dewey_nodes(df, "id", "doc"), "id", problems.ANSWER)
    post, url, image = (t[n].collect() for n in ("post", "url", "image"))
    parent = {tuple(r.label): r for r in post}[tuple(url[0].parent)]
    assert parent.id == "b" or parent["id"] == 1
    assert parent.fields["id"] == "b" and image[0].parent == url[0].label and image[0].places == [0, 1, 1]


def test_all_nodes_have_labels(spark):
    df = spark.createDataFrame([(1, '{"a/b":{"*":[1,{"~":null}]}}')], "id int, doc string")
    got = [(r.label, r.path, r.kind, r.value) for r in nested.dewey_nodes(df, "id", "doc").collect()]
    assert got == [([], "", "object", None), ([0], "/a~1b", "object", None), ([0, 0], "/a~1b/~2", "array", None), ([0, 0, 0], "/a~1b/~2/*", "number", "1"), ([0, 0, 1], "/a~1b/~2/*", "object", None), ([0, 0, 1, 0], "/a~1b/~2/*/~0", "null", None)]
