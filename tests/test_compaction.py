import json
import uuid

import pandas as pd

from cairn.operators import compaction
from cairn.plans import problems

SCHEMA = "file_id bigint, path string, size_bytes bigint, body string, record string"


def brute(rows):
    seen, out = set(), []
    for file_id, body in sorted(rows, key=lambda r: r[0]):
        for no, line in enumerate((body or "").split("\n"), 1):
            line = line.removesuffix("\r")
            try:
                v = json.loads(line)
            except ValueError:
                continue
            if isinstance(v, dict) and "digest" in v and "content" in v:
                key = (v["digest"].strip().upper().removeprefix("SHA1:"), json.dumps(v["content"], sort_keys=True))
                if key not in seen:
                    seen.add(key)
                    out.append((file_id, no))
    return out


def test_against_brute_force(spark, folder):
    d = pd.read_parquet(f"{folder}/small_files.parquet")
    assert sorted(tuple(r) for r in problems.p4_found(spark, folder).collect()) == brute(zip(d.file_id, d.body))


def line(n, **more):
    return json.dumps({"digest": f"{n:032d}", "content": {"n": n}} | more)


def files(spark, rows):
    return spark.createDataFrame([(i, f"f{i}", None if b is None else len(b), b, "x") for i, b in rows], SCHEMA)


def store():
    return f"file:///tmp/cairn-test-{uuid.uuid4().hex}"


def places(df):
    got = [(r.file_id, r.line_no) for r in df.collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def test_incremental_and_idempotent(spark):
    at = store()
    rows = [(i, "\r\n".join(line(n) for n in range(i, i + 3)) + "\n") for i in range(1, 12)]
    half = compaction.compact(files(spark, rows[:5]), at, fanout=2)
    assert places(half) == brute(rows[:5])
    entries = compaction.Journal(spark, at).entries()
    again = compaction.compact(files(spark, rows[:5]), at, fanout=2)
    assert compaction.Journal(spark, at).entries() == entries and places(again) == brute(rows[:5])
    late = [(0, line(3, url="first")), *rows]
    for part in (late[:1], late, late[3:8]):  # late files with smaller ids, files that come again
        got = compaction.compact(files(spark, part), at, fanout=2)
    assert places(got) == brute(late) and '"first"' in got.where("file_id = 0").first().line
    assert compaction.clean_up(spark, at) and places(compaction.compact(files(spark, late), at, fanout=2)) == brute(late)
    assert compaction.clean_up(spark, at) == [] and len(compaction.Journal(spark, at)._files()) == 1
    more = [*late, (99, line(3) + "\n" + line(100)), (-1, line(100))]
    assert places(compaction.compact(files(spark, more), at, fanout=2)) == brute(more)


def test_small_calls_leave_a_large_store_alone(spark):
    at = store()
    rows = [(i, "".join(line(5 * i + n, pad=f"{(5 * i + n) ** 9}") + "\n" for n in range(5))) for i in range(1000)]
    compaction.compact(files(spark, rows), at)
    size = sum(e.size for e in compaction.Journal(spark, at).live())
    first = set(compaction.Journal(spark, at).entries())
    for call in range(10):
        new = [(1000 + 10 * call + i, line(5000 + 10 * call + i) + "\n" + line(call * 7)) for i in range(10)]
        if call == 4:
            new.append((-5, line(4999)))  # an earlier place of a record that the store has
        rows += new
        got = compaction.compact(files(spark, new), at)
    entries = compaction.Journal(spark, at).entries()
    assert places(got) == brute(rows)
    assert sum(e.size for n, e in entries.items() if n not in first) < size / 2 and sum(e.level > 0 for e in entries.values()) >= 1
    live = compaction.Journal(spark, at).live()
    assert sum(e.rows for e in live) == got.count() and sum(e.moved for e in live) == 1 and first & {e.run for e in live}
    merged = compaction.merge_runs(spark, at, live, compaction.Journal(spark, at))
    assert (merged.rows, merged.moved) == (got.count(), 0) and places(compaction.compact(files(spark, rows[:50]), at)) == brute(rows)


def test_broken_off_transaction_is_done_again(spark):
    at = store()
    rows = [(1, line(1)), (2, line(1) + "\n" + line(2)), (3, line(2) + " " * 3000)]
    spark.range(3).selectExpr("'x' record", "1L file_id", "1 line_no", "'' line").write.parquet(f"{at}/data/0-left-over")
    assert compaction.compact(files(spark, rows), at).count() == 2
    journal = compaction.Journal(spark, at)
    last = journal.live()[0]
    fs, entry = compaction.file_system(spark, f"{journal.folder}/{last.txn}.json")
    fs.delete(entry, False)  # as if the run had been written but not committed
    assert places(compaction.compact(files(spark, rows), at)) == [(1, 1), (2, 2)]
    compaction.clean_up(spark, at)
    fs, left = compaction.file_system(spark, f"{at}/data/0-left-over")
    assert not fs.exists(left) and places(compaction.compact(files(spark, rows), at)) == [(1, 1), (2, 2)]


def test_odd_bodies(spark):
    deep = '{"digest":"D","content":' + "[" * 30_000 + "]" * 30_000 + "}"
    rows = [(1, None), (2, ""), (3, "\n\r\n"), (4, '{"digest":"a"'), (5, '{"digest":"sha1:a ","content":1.0}\n{"content":10e-1,"digest":"A"}'), (6, "[1]"), (7, deep + "\n" + deep), (8, '{"digest":"A","content":"1"}'), (9, '{"digest":"A","content":NaN}')]
    got = compaction.compact(files(spark, rows), store())
    assert sorted((r.file_id, r.line_no) for r in got.collect()) == [(5, 1), (7, 1), (8, 1)]
    assert compaction.compact(files(spark, []), store()).count() == 0


def test_well_sized_output(spark):
    at = store()
    rows = [(i, line(i, pad="x" * 200)) for i in range(400)]
    compaction.compact(files(spark, rows), at, target_bytes=20_000)
    runs = compaction.Journal(spark, at).live()
    sizes = [len(p.content) for p in spark.read.format("binaryFile").load([f"{e.output}/*.parquet" for e in runs if e.rows]).collect()]
    assert len(runs) == 1 and 1 <= len(sizes) <= 6 and sum(e.files for e in runs) == 400
